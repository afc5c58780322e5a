"""A table-driven predictive parser: grammars in text form become one automaton per rule.

A grammar line is ``rule: expression``; continuation lines are indented.  Expressions have ``'token'`` for a
token whose text (or kind) is that string, bare upper-case names for token kinds, bare lower-case names for
rules, ``( )`` groups, ``[ ]`` options, ``|``, ``*`` and ``+``.  One token of look-ahead picks the way; where
two ways begin alike, the first in the grammar's order wins, and a token is always taken before a rule ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_LEX = re.compile(r"\s+|(?P<lit>'[^']+')|(?P<name>\w+)|(?P<op>[()\[\]|*+])")


class Table:
    """Rule automata: ``arcs[rule][state]`` maps a token label to ``(rules to enter, next states)``."""

    def __init__(self, text: str):
        bodies: dict[str, str] = {}
        for line in text.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if line[0].isspace():
                bodies[last] += " " + line
            else:
                last, body = line.split(":", 1)
                bodies[last] = body
        self.start = next(iter(bodies))
        self._rules = set(bodies)
        self._nfa: list[list[tuple[str | None, int]]] = []
        self._dfa: dict[str, list[tuple[dict[str, int], bool]]] = {}
        ends: dict[str, tuple[int, int]] = {}
        for rule, body in bodies.items():
            toks = [m[0] for m in _LEX.finditer(body) if m.lastgroup]
            a, z, n = self._alt(toks, 0)
            if n != len(toks):
                raise ValueError(f"rule {rule}: {toks[n:]}")
            ends[rule] = (a, z)
        self._nullable: set[str] = set()
        while True:
            more = {rule for rule, (a, z) in ends.items() if rule not in self._nullable and z in self._close([a])}
            if not more:
                break
            self._nullable |= more
        self._dfa = {rule: self._subset(a, z) for rule, (a, z) in ends.items()}
        self._first: dict[str, set[str]] = {}
        for rule in self._dfa:
            self._first_of(rule, ())
        #: rule -> state -> {token label: (rule to enter or None, next state)}, accepting?
        self.rules: dict[str, list[tuple[dict[str, tuple[str | None, int]], bool]]] = {}
        self.conflicts: list[tuple[str, int, str]] = []
        for rule, states in self._dfa.items():
            out = []
            for k, (arcs, final) in enumerate(states):
                table: dict[str, tuple[str | None, int]] = {}
                for label, to in arcs.items():
                    if label[0] == "&" and label[1:] in self._rules:
                        for tok in self._first[label[1:]]:
                            if tok in table:
                                self.conflicts.append((rule, k, tok))
                            table.setdefault(tok, (label[1:], to))
                    elif label in table and table[label][0] is None:
                        self.conflicts.append((rule, k, label))
                    else:
                        table[label] = (None, to)
                out.append((table, final))
            self.rules[rule] = out
        #: All states of all rules in one row, and per state the way of each label met so far (see :meth:`_way`).
        base, self._states = {}, []
        for rule, states in self.rules.items():
            base[rule] = len(self._states)
            self._states += [(rule, table, final) for table, final in states]
        self._base = base
        self._final = [final for _, _, final in self._states]
        self._ways: list[dict[str, tuple[tuple[int, ...], int] | bool]] = [{} for _ in self._states]

    def _way(self, at: int, label: str) -> tuple[tuple[int, ...], int] | bool:
        """States to come back to and the state behind a token at ``at``, or False; worked out once for each.

        A rule is entered only for a label that it can begin with, so the way in ends with the token.
        """
        back: list[int] = []
        start, known = at, self._ways[at]
        while True:
            rule, table, _ = self._states[at]
            step = table.get(label)
            if step is None:
                way: tuple[tuple[int, ...], int] | bool = False
                break
            inner, to = step
            if inner is None:
                way = (tuple(back), self._base[rule] + to)
                break
            back.append(self._base[rule] + to)
            at = self._base[inner]
        known[label] = way
        return way

    def _state(self) -> int:
        self._nfa.append([])
        return len(self._nfa) - 1

    def _alt(self, toks, n):
        a, z = self._state(), self._state()
        while True:
            x, y, n = self._seq(toks, n)
            self._nfa[a].append((None, x))
            self._nfa[y].append((None, z))
            if n >= len(toks) or toks[n] != "|":
                return a, z, n
            n += 1

    def _seq(self, toks, n):
        a = z = self._state()
        while n < len(toks) and toks[n] not in (")", "]", "|"):
            x, y, n = self._item(toks, n)
            self._nfa[z].append((None, x))
            z = y
        return a, z, n

    def _item(self, toks, n):
        t = toks[n]
        if t == "[":
            a, z, n = self._alt(toks, n + 1)
            self._nfa[a].append((None, z))
            return a, z, n + 1
        if t == "(":
            a, z, n = self._alt(toks, n + 1)
            n += 1
        else:
            a, z = self._state(), self._state()
            self._nfa[a].append(("&" + t if t in self._rules else t.strip("'"), z))
            n += 1
        if n < len(toks) and toks[n] in "*+":
            self._nfa[z].append((None, a))
            if toks[n] == "*":
                b = self._state()
                self._nfa[b].append((None, a))
                c = self._state()
                self._nfa[z].append((None, c))
                self._nfa[b].append((None, c))
                return b, c, n + 1
            return a, z, n + 1
        return a, z, n

    def _close(self, states: Iterable[int]) -> list[int]:
        """States reachable without a token, past rules that may be empty too, in grammar order."""
        out: list[int] = []
        todo = list(states)[::-1]
        while todo:
            s = todo.pop()
            if s not in out:
                out.append(s)
                todo.extend(t for label, t in reversed(self._nfa[s]) if label is None or label[0] == "&" and label[1:] in self._nullable)
        return out

    def _subset(self, a: int, z: int):
        keys = {}
        order = [self._close([a])]
        keys[frozenset(order[0])] = 0
        out = []
        k = 0
        while k < len(order):
            targets: dict[str, list[int]] = {}
            for s in order[k]:
                for label, t in self._nfa[s]:
                    if label is not None:
                        targets.setdefault(label, []).append(t)
            arcs = {}
            for label, ts in targets.items():
                c = self._close(ts)
                key = frozenset(c)
                if key not in keys:
                    keys[key] = len(order)
                    order.append(c)
                arcs[label] = keys[key]
            out.append((arcs, z in order[k]))
            k += 1
        return out

    def _first_of(self, rule: str, above: tuple[str, ...]) -> set[str]:
        if rule in above:
            raise ValueError(f"left recursion: {above + (rule,)}")
        if rule not in self._first:
            got: set[str] = set()
            for label in self._dfa[rule][0][0]:
                got |= self._first_of(label[1:], (*above, rule)) if label[0] == "&" and label[1:] in self._rules else {label}
            self._first[rule] = got
        return self._first[rule]

    def parse(self, labels: list[str]) -> int | None:
        """Index of the first token that no parse can go on with, or None if all tokens parse.

        ``labels`` are token labels; the last one is the end mark.  A label that no state knows at a place
        is an error there: the table has no recovery, so the first error is unrecoverable.
        """
        ways, final = self._ways, self._final
        stack: list[int] = []
        at = self._base[self.start]
        for n, label in enumerate(labels):
            while True:
                way = ways[at].get(label)
                if way is None:
                    way = self._way(at, label)
                if way:
                    back, at = way
                    stack += back
                    break
                if not (final[at] and stack):
                    return n
                at = stack.pop()
        while final[at]:
            if not stack:
                return None
            at = stack.pop()
        return len(labels) - 1
