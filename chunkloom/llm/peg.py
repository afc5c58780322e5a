"""A packrat parser for parsing-expression grammars given as text.

Rules are ``Name <- expression``, one or more lines each; ``#`` begins a comment line.  Expressions have
``'literal'``, ``~'regular expression'``, rule names, ``( )``, ``/`` (ordered choice), ``* + ?`` and the
predicates ``&`` and ``!``.  Every rule is tried at most once per offset (memo table), so parsing is linear
in the text for a fixed grammar.  Rule nodes keep their source offsets: ``(name, start, end, children)``.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Callable
from typing import NamedTuple


class Node(NamedTuple):
    name: str
    start: int
    end: int
    children: list


#: Calls that one character of a text can add to the stack at most.
CALLS = 64

Matcher = Callable[[str, int, dict], "tuple[int, list] | None"]

_LEX = re.compile(r"""\s+|(?P<name>[A-Za-z_]\w*)|(?P<regex>~(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"))|(?P<lit>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<op>[()/*+?&!])""", re.S)


class Grammar:
    def __init__(self, text: str):
        rules: dict[str, str] = {}
        last = None
        for line in text.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if m := re.match(r"(\w+)\s*<-\s*(.*)", line):
                last = m[1]
                rules[last] = m[2]
            elif last:
                rules[last] += "\n" + line
        self.start = next(iter(rules))
        self.rules: dict[str, Matcher] = {}
        for name, body in rules.items():
            toks = [m for m in _LEX.finditer(body) if m.lastgroup]
            expr, at = self._choice(toks, 0)
            if at != len(toks):
                raise ValueError(f"rule {name}: unexpected {toks[at][0]!r}")
            self.rules[name] = self._rule(name, expr)

    def parse(self, text: str, start: str | None = None) -> Node | None:
        """The tree of the prefix that the start rule matches, or None.

        A rule is entered at most once more per character of nesting, through a few calls each; where the
        interpreter's limit is below that, it is raised for this text.
        """
        rule = self.rules[start or self.start]
        try:
            got = rule(text, 0, {})
        except RecursionError:
            limit = sys.getrecursionlimit()
            sys.setrecursionlimit(max(limit, CALLS * len(text)))
            try:
                got = rule(text, 0, {})
            finally:
                sys.setrecursionlimit(limit)
        return got[1][0] if got else None

    def _rule(self, name: str, expr: Matcher) -> Matcher:
        def match(s, at, memo):
            key = (name, at)
            if key in memo:
                return memo[key]
            got = expr(s, at, memo)
            memo[key] = got = None if got is None else (got[0], [Node(name, at, got[0], got[1])])
            return got

        return match

    def _choice(self, toks, at):
        options = []
        while True:
            seq, at = self._sequence(toks, at)
            options.append(seq)
            if at >= len(toks) or toks[at][0] != "/" or toks[at].lastgroup != "op":
                break
            at += 1
        if len(options) == 1:
            return options[0], at

        def match(s, p, memo):
            for o in options:
                got = o(s, p, memo)
                if got is not None:
                    return got
            return None

        return match, at

    def _sequence(self, toks, at):
        items = []
        while at < len(toks) and not (toks[at].lastgroup == "op" and toks[at][0] in "/)"):
            item, at = self._item(toks, at)
            items.append(item)
        if len(items) == 1:
            return items[0], at

        def match(s, p, memo):
            out: list = []
            for i in items:
                got = i(s, p, memo)
                if got is None:
                    return None
                p = got[0]
                out += got[1]
            return p, out

        return match, at

    def _item(self, toks, at):
        t = toks[at]
        if t.lastgroup == "op" and t[0] in "&!":
            inner, at = self._item(toks, at + 1)
            want = t[0] == "&"
            return (lambda s, p, memo: (p, []) if (inner(s, p, memo) is not None) == want else None), at
        if t.lastgroup == "op" and t[0] == "(":
            inner, at = self._choice(toks, at + 1)
            at += 1
        elif t.lastgroup == "name":
            inner, at = self._call(t[0]), at + 1
        elif t.lastgroup == "regex":
            inner, at = self._regex(ast.literal_eval("r" + t[0][1:])), at + 1
        elif t.lastgroup == "lit":
            inner, at = self._literal(ast.literal_eval(t[0])), at + 1
        else:
            raise ValueError(f"unexpected {t[0]!r}")
        if at < len(toks) and toks[at].lastgroup == "op" and toks[at][0] in "*+?":
            inner, at = self._repeat(inner, toks[at][0]), at + 1
        return inner, at

    def _call(self, name):
        return lambda s, p, memo: self.rules[name](s, p, memo)

    def _regex(self, pattern):
        rx = re.compile(pattern, re.S)

        def match(s, p, memo):
            m = rx.match(s, p)
            return (m.end(), []) if m else None

        return match

    def _literal(self, text):
        return lambda s, p, memo: (p + len(text), []) if s.startswith(text, p) else None

    def _repeat(self, inner, op):
        def match(s, p, memo):
            out: list = []
            n = 0
            while True:
                got = inner(s, p, memo)
                if got is None or (got[0] == p and n):
                    break
                n += 1
                p = got[0]
                out += got[1]
                if op == "?":
                    break
            return None if op == "+" and not n else (p, out)

        return match


def find(node: Node, name: str) -> list[Node]:
    """Nodes of that rule below ``node`` in source order, not looking inside found ones."""
    out, todo = [], node.children[::-1]
    while todo:
        c = todo.pop()
        if c.name == name:
            out.append(c)
        else:
            todo.extend(reversed(c.children))
    return out
