"""C++ files to free function, method, class and struct chunks.

No parser library is available, so definitions are found from the token stream: scopes are followed by
their braces, and a declaration at namespace or class scope whose parameter list is followed by a body is
a function.  Names are the declared ones (``operator`` and destructor names included).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from chunkloom import config as C
from chunkloom.chunking.text import decode_bytes, strip_header, worth_chunking

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|^[ \t]*\#(?:\\\n|[^\n])*)
    |(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")
    |(?P<str>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?)
    |(?P<chr>(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?)
    |(?P<id>[^\W\d]\w*)
    |(?P<num>\.?\d(?:'?[\w.]|[eEpP][+-])*)
    |(?P<op>::|->\*?|<<=|<=>|>>=|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\||<<|\+\+|--|.)""",
    re.X | re.S | re.M,
)


class Tok(NamedTuple):
    kind: str
    text: str
    at: int
    end: int


def tokens(source: str) -> list[Tok]:
    return [Tok(m.lastgroup if m.lastgroup != "d" else "raw", m[0], m.start(), m.end()) for m in _TOKEN.finditer(source) if m.lastgroup != "skip"]


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NOT_CALLS = frozenset("if for while switch return sizeof alignof catch decltype throw new delete else do case and or not typeid static_assert noexcept alignas".split())


class _Scan:
    def __init__(self, source: str):
        self.source = source
        self.toks = tokens(source)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in _PAIRS:
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                if stack and _PAIRS[self.toks[stack[-1]].text] == t.text:
                    self.match[stack.pop()] = i
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.toks) - 1)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def text(self, i: int, j: int) -> str:
        return self.source[self.toks[i].at : self.toks[j].end]

    def calls(self, i: int, j: int) -> list[str]:
        """Sorted distinct call targets between tokens ``i`` and ``j``, without their qualification."""
        found = set()
        for k in range(i + 1, j + 1):
            if self.toks[k].text != "(" or self.toks[k - 1].kind != "id" or self.toks[k - 1].text in _NOT_CALLS:
                continue
            a = k - 1
            while a - 2 >= i and self.toks[a - 1].text in ("::", ".", "->") and (self.toks[a - 2].kind == "id" or self.toks[a - 2].text in ")]"):
                if self.toks[a - 2].kind != "id":
                    break
                a -= 2
            before = self.toks[a - 1] if a > i else None
            if before is not None and before.kind == "id" and before.text not in _NOT_CALLS:
                continue  # a declaration such as ``Type name(...)``
            found.add(self.text(a, k - 1).split("::")[-1])
        return sorted(found)


class _Def(NamedTuple):
    kind: str
    name: str
    first: int
    last: int
    body: int
    scope: tuple[str, ...]


def _definitions(s: _Scan, i: int, end: int, scope: tuple[str, ...]) -> Iterator[_Def]:
    """Definitions between tokens ``i`` and ``end`` (not included), outer ones before inner ones."""
    T = s.toks
    while i < end:
        first = i
        if T[i].text in (";", ":") or T[i].text in ("public", "private", "protected") and i + 1 < end and T[i + 1].text == ":":
            i += 1
            continue
        if T[i].text == "template" and i + 1 < end and T[i + 1].text == "<":
            depth, i = 0, i + 1
            while i < end:
                depth += T[i].text.count("<") - (T[i].text.count(">") if T[i].text in (">", ">>") else 0)
                i += 1
                if depth <= 0:
                    break
            first = i
            continue
        j, params, kind, name, is_init = i, -1, "", "", False
        while j < end and T[j].text not in (";", "{", "}"):
            x = T[j]
            if x.text == "(":
                if params < 0 and not is_init and j > first:
                    params = j
                j = s.close(j)
            elif x.text == "[":
                j = s.close(j)
            elif x.text == "=" and params < 0 and T[j - 1].text != "operator":
                is_init = True
            elif x.text == ":" and params >= 0:
                j += 1  # member initialisers up to the body
                while j < end and T[j].text not in ("{", ";"):
                    if T[j].text == "(":
                        j = s.close(j)
                    elif T[j].kind == "id" and j + 1 < end and T[j + 1].text == "{":
                        j = s.close(j + 1)
                    j += 1
                continue
            elif x.text in ("namespace", "class", "struct", "union", "enum", "extern") and params < 0 and not kind:
                kind = x.text
            elif x.text == "operator":
                j += 1
                while j + 1 < end and T[j + 1].text != "(":
                    j += 1
                if T[j].text == "(" and j + 1 < end and T[j + 1].text == ")":
                    j += 1
            j += 1
        if j >= end or T[j].text == "}":
            i = j + 1
            continue
        if T[j].text == ";":
            i = j + 1
            continue
        close = s.close(j)
        if params >= 0 and not is_init:
            yield _Def("function", _declared_name(s, first, params), first, close, j, scope)
            i = close + 1
        elif kind == "namespace" or kind == "extern":
            names = tuple(T[k].text for k in range(first, j) if T[k].kind == "id" and T[k].text not in ("namespace", "inline", "extern"))
            yield from _definitions(s, j + 1, close, scope + names)
            i = close + 1
        elif kind in ("class", "struct"):
            head = next((k for k in range(first, j) if T[k].text == kind), first)
            names = []
            for k in range(head + 1, j):
                if T[k].text == ":":
                    break
                if T[k].kind == "id" and T[k].text not in ("final", "alignas"):
                    names.append(T[k].text)
            name = names[-1] if names else "unknown"
            yield _Def(kind, name, head, close, j, scope)
            yield from _definitions(s, j + 1, close, scope + ((name,) if names else ()))
            i = close + 1
            while i < end and T[i].text != ";":
                i += 1
        else:
            i = close + 1  # enum, union, initialiser list


def _declared_name(s: _Scan, first: int, params: int) -> str:
    T, k = s.toks, params - 1
    op = next((n for n in range(params - 1, max(first, params - 5) - 1, -1) if T[n].text == "operator"), -1)
    if op >= 0:
        k, name = op, s.text(op, params - 1)
    elif T[k].kind == "id":
        name = T[k].text
        if k > first and T[k - 1].text == "~":
            k, name = k - 1, "~" + name
    else:
        return "unknown"
    while k - 2 >= first and T[k - 1].text == "::" and T[k - 2].kind == "id":
        k, name = k - 2, T[k - 2].text + "::" + name
    return name


def _class_skeleton(s: _Scan, d: _Def) -> str:
    """Declaration and members, one to a line, method bodies as ``{...}``."""
    T, out, i = s.toks, [s.text(d.first, d.body - 1)], d.body + 1
    out.append("  {")
    bodies = {x.first: x for x in _definitions(s, d.body + 1, d.last, ()) if x.kind == "function" and not x.scope}
    while i < d.last:
        if T[i].text in ("public", "private", "protected") and T[i + 1].text == ":":
            out += [f"  {T[i].text}", "  :"]
            i += 2
            continue
        if x := bodies.get(i):
            out.append(f"  {s.text(i, x.body - 1)} {{...}}")
            i = x.last + 1
            continue
        j = i
        while j < d.last and T[j].text != ";":
            j = s.close(j) if T[j].text in _PAIRS and T[j].kind == "op" else j
            j += 1
        out.append("  " + s.text(i, min(j, d.last - 1)))
        i = j + 1
    out.append("  }")
    return "\n".join(out)


def chunk_cpp(data: bytes, relative_path: str) -> Iterator[dict]:
    """Chunks of one C++ file in source order; only classes and structs over the size limit are shortened."""
    source, dropped = strip_header(decode_bytes(data), "cpp")
    if not worth_chunking(source):
        return
    s = _Scan(source)
    header = f"// File: {relative_path}\n\n"
    for d in _definitions(s, 0, len(s.toks), ()):
        body = s.text(d.first, d.last)
        if d.kind != "function" and len(body) > C.MAX_CHUNK_CHARS:
            body = _class_skeleton(s, d)
        line = s.line(s.toks[d.first].at)
        yield {
            "content": header + body,
            "language": "cpp",
            "chunk_type": d.kind if d.kind != "function" else ("method" if d.scope else "free_function"),
            "symbol_name": "::".join([*d.scope, d.name]),
            "start_line": line,
            "end_line": s.line(s.toks[d.last].at),
            "file_start_line": line + dropped,
            "symbols_referenced": s.calls(d.first if d.kind != "function" else d.body, d.last),
        }
