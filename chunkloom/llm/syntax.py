"""Source files that do not parse: lexers and bundled grammars for Python, C++ and proto3.

Each file's token stream is parsed in full by a table-driven predictive parser (``lltable``); the first
token that no parse can go on with is reported.  The text is read as the indexer reads it: UTF-8, byte order
mark dropped, bad bytes replaced.
"""

from __future__ import annotations

import functools
import io
import re
import sys
import tokenize as pytokens
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.columns import extension
from chunkloom.llm import grammars
from chunkloom.llm.lltable import Table
from chunkloom.session import spread

LANGUAGES = {".py": "python", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".proto": "proto"}


class Error(NamedTuple):
    line: int
    message: str


class LexError(Exception):
    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.error = Error(line, message)


@functools.lru_cache(maxsize=3)
def table(language: str) -> Table:
    """The parse table, built once per worker."""
    return Table({"python": grammars.PYTHON, "cpp": grammars.CPP, "proto": grammars.PROTO}[language])


# ---------------------------------------------------------------- Python

# The reserved words.
PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_OP = frozenset("// % @ & | ^ << >>".split())
_PY_AUG = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_labels(source: str) -> tuple[list[str], list[int]]:
    """Token labels and their lines; raises :class:`LexError`."""
    if "\0" in source:
        raise LexError(source[: source.index("\0")].count("\n") + 1, "null character")
    toks = []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t in pytokens.generate_tokens(io.StringIO(source).readline):
                if t.type not in (pytokens.COMMENT, pytokens.NL, pytokens.ENCODING):
                    toks.append(t)
    except pytokens.TokenError as e:
        raise LexError(e.args[1][0] if len(e.args) > 1 else 0, str(e.args[0])) from e
    except SyntaxError as e:
        raise LexError(e.lineno or 0, str(e.msg)) from e
    labels: list[str] = []
    for k, t in enumerate(toks):
        s = t.string
        if (flaw := _py_token_flaw(toks[k - 1] if k else None, t)) is not None:
            raise LexError(t.start[0], flaw)
        if t.type == pytokens.NAME:
            labels.append(s if s in PY_KEYWORDS else "NAME")
        elif t.type == pytokens.OP:
            labels.append("AUG" if s in _PY_AUG else "OP" if s in _PY_OP and s != "@" else "SIGN" if s in "+-" else s)
        elif t.type == pytokens.ERRORTOKEN:
            raise LexError(t.start[0], f"invalid token {s!r}")
        elif t.type == pytokens.ENDMARKER:
            labels.append("END")
        else:
            labels.append({"FSTRING_START": "FSTART", "FSTRING_MIDDLE": "FMIDDLE", "FSTRING_END": "FEND"}.get(pytokens.tok_name[t.type], pytokens.tok_name[t.type]))
    _soft_words(labels, [t.string for t in toks])
    return labels, [t.start[0] for t in toks]


def _py_token_flaw(before: pytokens.TokenInfo | None, t: pytokens.TokenInfo) -> str | None:
    """What is wrong with a token or with its place behind another, which labels do not show."""
    texts = (pytokens.STRING, pytokens.FSTRING_START)
    if t.type == pytokens.NUMBER and re.fullmatch(r"0[\d_]*[1-9][\d_]*", t.string):
        return "leading zeros"
    if before is not None and before.string == "!" and before.type == pytokens.OP and (t.string not in ("s", "r", "a") or before.end != t.start):
        return "invalid conversion"
    if before is not None and t.type in texts and before.type in (pytokens.STRING, pytokens.FSTRING_END):
        of_bytes = [x.type == pytokens.STRING and "b" in x.string[: re.search("['\"]", x.string).start()].lower() for x in (before, t)]
        if of_bytes[0] != of_bytes[1]:
            return "bytes and text literals mixed"
    return None


def _soft_words(labels: list[str], texts: list[str]) -> None:
    """Marks what depends on the rest of its line: match, case, type, parenthesised with items, matrix products."""
    begin = True
    for i, label in enumerate(labels):
        if label == "@" and not begin:
            labels[i] = "OP"
        if begin and label == "NAME" and texts[i] in ("match", "case", "type") or label == "with":
            end, depth = i + 1, 0
            while labels[end] not in ("NEWLINE", "END") and (labels[end] != ":" or depth):
                depth += (texts[end] in "([{") - (texts[end] in ")]}") if texts[end] else 0
                end += 1
            if label == "with":
                _with_group(labels, i + 1, end)
            elif texts[i] == "type":
                if labels[i + 1] == "NAME" and labels[i + 2] in ("=", "["):
                    labels[i] = "TYPE"
            elif labels[end] == ":" and end > i + 1 and labels[i + 1] not in ("=", "AUG", ".", ",", ")"):
                if texts[i] == "match" and labels[end + 1 : end + 3] == ["NEWLINE", "INDENT"] and texts[end + 3] == "case":
                    labels[i] = "MATCH"
                elif texts[i] == "case":
                    labels[i] = "CASE"
                    depth, guard = 0, False
                    for k in range(i + 1, end):
                        depth += (labels[k] in ("(", "[", "{")) - (labels[k] in (")", "]", "}"))
                        if not guard and (labels[k] == "as" or texts[k] == "|"):
                            labels[k] = "AS" if labels[k] == "as" else "BAR"
                        elif labels[k] == "if" and not depth and not guard:
                            labels[k], guard = "GUARD", True
        elif label == "except" and labels[i + 1] == "*":
            labels[i] = "EXCEPTS"
        begin = label in ("NEWLINE", "INDENT", "DEDENT")


def _with_group(labels: list[str], at: int, end: int) -> None:
    if labels[at] != "(":
        return
    depth, named = 0, False
    for k in range(at, end):
        depth += (labels[k] in ("(", "[", "{")) - (labels[k] in (")", "]", "}"))
        named |= labels[k] == "as" and depth == 1
        if not depth:
            if named and k == end - 1 and labels[k] == ")":
                labels[at], labels[k] = "WOPEN", "WCLOSE"
            return


#: Labels that a call's or subscript's bracket can follow.
_PY_OPERAND = frozenset("NAME NUMBER STRING FEND ) ] } ... None True False".split())
#: What stands before the name of a ``:=``; a comma only inside brackets or in the subject of ``match``.
_PY_BEFORE_WALRUS = frozenset("( [ { , if elif while @ MATCH GUARD".split())
_PY_COMPOUND = frozenset("if elif else while for try except EXCEPTS finally with async def class MATCH CASE".split())


class _PythonRules:
    """What one token of look-ahead cannot tell in an accepted token stream: targets of assignments, the order
    of parameters and arguments, places of ``:=`` and stars, displays that mix sets and mappings."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.bad: list[int] = []
        #: Opening token -> closing one: brackets, f-strings, and ``lambda`` with its colon.
        self.close: dict[int, int] = {}
        holes: set[int] = set()
        spec: set[int] = set()
        inside: list[bool] = []
        stack: list[int] = []
        depth = 0
        for i, label in enumerate(labels):
            inside.append(depth > 0)
            if label in ("(", "[", "{", "WOPEN", "FSTART", "lambda"):
                if label == "{" and stack and (labels[stack[-1]] == "FSTART" or stack[-1] in spec):
                    holes.add(i)
                stack.append(i)
                depth += label != "lambda"
            elif label in (")", "]", "}", "WCLOSE", "FEND"):
                self.close[stack.pop()] = i
                depth -= 1
            elif label == ":" and stack:
                if labels[stack[-1]] == "lambda":
                    self.close[stack.pop()] = i
                elif stack[-1] in holes:
                    spec.add(stack[-1])
        self.inside = inside
        self._statements()
        for i, end in self.close.items():
            if labels[i] == "lambda":
                self._parameters(i + 1, end)
            elif labels[i] in ("(", "[", "{") and i not in holes:
                self._group(i, end)

    def _level(self, lo: int, hi: int) -> Iterator[int]:
        """Tokens of a span that no bracket inside it encloses."""
        while lo < hi:
            yield lo
            lo = self.close.get(lo, lo) + 1

    def _find(self, lo: int, hi: int, *want: str) -> int:
        return next((i for i in self._level(lo, hi) if self.labels[i] in want), -1)

    def _parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Spans between commas; without the empty one behind a last comma."""
        out = []
        for i in self._level(lo, hi):
            if self.labels[i] == ",":
                out.append((lo, i))
                lo = i + 1
        return [*out, (lo, hi)] if lo < hi else out

    def _statements(self) -> None:
        labels = self.labels
        start, match, header = 0, False, False
        for i in self._level(0, len(labels)):
            label = labels[i]
            if i == start:
                match, header = label == "MATCH", label in _PY_COMPOUND
            if label in ("NEWLINE", "INDENT", "DEDENT", ";", "END") or header and label == ":":
                (self._header if header else self._simple)(start, i)
                start = i + 1
        for i, label in enumerate(labels):
            if label == "MATCH":
                match = True
            elif label == "NEWLINE":
                match = False
            elif label == ":=" and (labels[i - 1] != "NAME" or i < 2 or labels[i - 2] not in _PY_BEFORE_WALRUS or labels[i - 2] == "," and not (self.inside[i] or match)):
                self.bad.append(i)

    def _header(self, lo: int, hi: int) -> None:
        labels = self.labels
        lo += labels[lo] == "async"
        if labels[lo] == "for":
            self._target(lo + 1, self._find(lo, hi, "in"))
        elif labels[lo] == "with":
            a, b = (lo + 2, hi - 1) if labels[lo + 1] == "WOPEN" else (lo + 1, hi)
            for x, y in self._parts(a, b):
                if (at := self._find(x, y, "as")) >= 0:
                    self._target(at + 1, y)
        elif labels[lo : lo + 2] == ["MATCH", "*"] and self._find(lo, hi, ",") < 0:
            self.bad.append(lo + 1)
        elif labels[lo] == "def":
            at = lo + 2 if labels[lo + 2] == "(" else self.close[lo + 2] + 1
            self._parameters(at + 1, self.close[at])

    def _simple(self, lo: int, hi: int) -> None:
        labels = self.labels
        if lo == hi or labels[lo] == "TYPE":
            return
        if labels[lo] == "del":
            self._target(lo + 1, hi, star=False)
        elif (at := self._find(lo, hi, "AUG", ":")) >= 0:
            self._target(lo, at, one=True, star=False)
        else:
            while (at := self._find(lo, hi, "=")) >= 0:
                self._target(lo, at)
                lo = at + 1

    def _target(self, lo: int, hi: int, one: bool = False, star: bool = True) -> None:
        """Names, attributes and subscripts, also in brackets; ``one``: no list of them."""
        labels = self.labels
        parts = self._parts(lo, hi)
        if one and (len(parts) != 1 or self._find(lo, hi, ",") >= 0):
            self.bad.append(lo)
            return
        for a, b in parts:
            if labels[a] == "*":
                if not star:
                    self.bad.append(a)
                a += 1
            if labels[a] in ("(", "[") and self.close[a] == b - 1:
                if one and labels[a] == "[":
                    self.bad.append(a)
                single = labels[a] == "(" and self._find(a + 1, b - 1, ",") < 0 and b - a > 2
                self._target(a + 1, b - 1, one, star and not single)
                continue
            last, k = labels[a], a
            if last not in ("NAME", "(", "[", "{", "FSTART", "STRING", "NUMBER", "...", "None", "True", "False"):
                self.bad.append(a)
                continue
            if last in ("FSTART", "STRING"):
                while k < b and labels[k] in ("FSTART", "STRING"):
                    k = self.close.get(k, k) + 1
            else:
                k = self.close.get(k, k) + 1
            last = "NAME" if last == "NAME" else ""
            while k < b and labels[k] in ("(", "[", "."):
                last = labels[k]
                k = k + 2 if last == "." else self.close[k] + 1
            if k < b or last not in ("NAME", "[", "."):
                self.bad.append(a)

    def _parameters(self, lo: int, hi: int) -> None:
        labels = self.labels
        default = star = slash = twice = bare = False
        for a, b in self._parts(lo, hi):
            label = labels[a]
            wrong = twice
            if label == "/":
                wrong |= slash or star or a == lo
                slash = True
            elif label == "*":
                wrong |= star
                star, bare = True, b == a + 1
            elif label == "**":
                wrong |= bare
                twice = True
            else:
                has = self._find(a, b, "=") >= 0
                wrong |= default and not has and not star
                default |= has and not star
                bare = False
            if wrong:
                self.bad.append(a)
        if bare:
            self.bad.append(hi)

    def _group(self, at: int, end: int) -> None:
        labels = self.labels
        parts = self._parts(at + 1, end)
        before = labels[at - 1] if at else ""
        each = self._find(at + 1, end, "for")
        if each >= 0:
            if labels[at + 1] in ("*", "**"):
                self.bad.append(at + 1)
            for i in self._level(at + 1, end):
                if labels[i] == "for":
                    self._target(i + 1, self._find(i, end, "in"))
        params = before == "NAME" and at > 1 and labels[at - 2] == "def" or before == "]" and self._type_parameters(at - 1)
        if labels[at] == "(" and not params and before in _PY_OPERAND:
            self._arguments(parts, at, end, each >= 0)
        elif labels[at] == "(" and not params and len(parts) == 1 and labels[at + 1] == "*" and labels[end - 1] != ",":
            self.bad.append(at + 1)
        elif labels[at] in ("{", "["):
            kinds = set()
            for a, b in parts:
                pair = self._find(a, b, ":") >= 0
                if pair and self._find(a, b, ":=") >= 0:
                    self.bad.append(a)
                kinds.add(pair or labels[a] == "**")
            if labels[at] == "{" and each < 0 and len(kinds) > 1:
                self.bad.append(at)

    def _type_parameters(self, end: int) -> bool:
        """Whether the bracket that closes at ``end`` holds the type parameters of a function."""
        depth = 0
        for k in range(end, -1, -1):
            depth += (self.labels[k] == "]") - (self.labels[k] == "[")
            if not depth:
                return k > 1 and self.labels[k - 2] == "def"
        return False

    def _arguments(self, parts: list[tuple[int, int]], at: int, end: int, each: bool) -> None:
        labels = self.labels
        keyword = twice = False
        if each:
            heads = [(i, self._find(i, end, "in")) for i in self._level(at + 1, end) if labels[i] == "for"]
            alone = all(labels[i] != "," or any(a < i < b for a, b in heads) for i in self._level(at + 1, end))
            if not alone or labels[at - 2] == "class":
                self.bad.append(at + 1)
            return
        for a, b in parts:
            wrong = False
            equals = self._find(a, b, "=")
            if labels[a] == "**":
                twice = True
            elif labels[a] == "*":
                wrong = twice
            elif equals >= 0:
                wrong = labels[a] != "NAME" or equals != a + 1
                keyword = True
            else:
                wrong = keyword or twice
            if wrong:
                self.bad.append(a)


def python_flaw(labels: list[str]) -> int | None:
    """The first token of an accepted stream at which the language has an error all the same, or None."""
    return min(_PythonRules(labels).bad, default=None)


# ---------------------------------------------------------------- C++

# The words of the language that the grammar tells apart.
CPP_WORDS = frozenset(
    "namespace extern template using class struct union enum static_assert public private protected typedef friend concept try catch if else while do for switch case default return break continue goto new delete throw sizeof this co_await co_return co_yield requires".split()
)
CPP_SPEC = frozenset(
    "int char bool float double void long short signed unsigned auto const volatile static inline constexpr consteval constinit virtual explicit mutable register thread_local typename override final noexcept wchar_t char8_t char16_t char32_t decltype".split()
)
_CPP_CALLS = frozenset("alignas __attribute__ __declspec decltype".split())
_CPP_LEX = re.compile(
    r"""(?P<skip>[ \t\r\f\v]+|\\\r?\n|//(?:[^\n\\]|\\.|\\\n)*|/\*.*?\*/)
    |(?P<nl>\n)
    |(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"\w*)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*"\w*)
    |(?P<chr>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'\w*)
    |(?P<id>[^\W\d]\w*)
    |(?P<num>\.?\d(?:'(?=\w)|[eEpP][+-]|[\w.])*)
    |(?P<op>\.\.\.|::|->\*?|\.\*|<=>|<<=|>>=|[-+*/%&|^=!<>]=|&&|\|\||<<|>>|\+\+|--|\#\#?|[-+*/%&|^!~=<>?:;,.()\[\]{}])""",
    re.X | re.S,
)


def cpp_tokens(source: str) -> list[tuple[str, str, int]]:
    """``(kind, text, line)`` of what the preprocessor leaves; raises :class:`LexError`."""
    out: list[tuple[str, str, int]] = []
    at, line, fresh = 0, 1, True
    macros: dict[str, str | None] = {"__cplusplus": "201703L"}
    groups: list[tuple[bool, bool, bool]] = []  # (parent active, active, some branch taken)
    n = len(source)
    while at < n:
        active = not groups or groups[-1][1]
        if fresh:
            m = re.compile(r"[ \t\r\f\v]*(?:/\*.*?\*/[ \t]*)?#", re.S).match(source, at)
            if m:
                end = at
                while True:
                    stop = source.find("\n", end)
                    stop = n if stop < 0 else stop
                    if source[at:stop].rstrip("\r").endswith("\\") and stop < n:
                        end = stop + 1
                        continue
                    break
                text = re.sub(r"\\\r?\n", " ", source[m.end() : stop])
                open_comment = text.rfind("/*")
                if open_comment > text.rfind("*/") and "//" not in text[:open_comment]:
                    close = source.find("*/", stop)
                    if close < 0:
                        raise LexError(line, "unterminated comment")
                    stop = close + 2
                _directive(text, line, groups, macros)
                line += source.count("\n", at, stop)
                at = stop
                fresh = False
                continue
            if not active:
                stop = source.find("\n", at)
                stop = n if stop < 0 else stop
                line += 1
                at = stop + 1
                continue
        m = _CPP_LEX.match(source, at)
        if not m:
            raise LexError(line, f"stray or unterminated {source[at : at + 10]!r}")
        kind, text = m.lastgroup, m[0]
        if m.lastgroup == "d":
            kind = "raw"
        at = m.end()
        if kind == "nl":
            fresh = True
            line += 1
            continue
        if kind != "skip":
            if kind == "op" and text in ("#", "##"):
                raise LexError(line, "stray #")
            fresh = False
            if kind == "id" and macros.get(text) is not None and text != "__cplusplus":
                for x in _CPP_LEX.finditer(macros[text] or ""):
                    if x.lastgroup not in ("skip", "nl"):
                        out.append((x.lastgroup or "op", x[0], line))
            else:
                out.append((kind or "op", text, line))
        line += text.count("\n")
    if groups:
        raise LexError(line, "unterminated conditional directive")
    return out


def _directive(text: str, line: int, groups: list, macros: dict) -> None:
    m = re.match(r"\s*(\w*)\s*(.*)", text, re.S)
    word, rest = m[1], re.sub(r"//.*|/\*.*?(\*/|$)", " ", m[2], flags=re.S).strip()
    active = not groups or groups[-1][1]
    if word in ("if", "ifdef", "ifndef"):
        value = False
        if active:
            value = _condition(rest, macros) if word == "if" else (rest.split(" ")[0] in macros) == (word == "ifdef")
        groups.append((active, active and value, value))
    elif word in ("elif", "elifdef", "elifndef", "else"):
        if not groups:
            raise LexError(line, f"#{word} without #if")
        parent, _, taken = groups.pop()
        value = parent and not taken and (word == "else" or (_condition(rest, macros) if word == "elif" else (rest.split(" ")[0] in macros) == (word == "elifdef")))
        groups.append((parent, value, taken or value))
    elif word == "endif":
        if not groups:
            raise LexError(line, "#endif without #if")
        groups.pop()
    elif active and word == "define":
        if d := re.match(r"(\w+)(\(?)(.*)", rest, re.S):
            macros[d[1]] = None if d[2] else d[3].strip()
    elif active and word == "undef":
        macros.pop(rest, None)
    elif active and word == "error":
        return


_COND_LEX = re.compile(r"\s+|(?P<num>(?:0[xX][\da-fA-F']+|0[bB][01']+|\d[\d']*)[uUlLzZ]*(?![\w.]))|(?P<chr>'(?:[^'\\]|\\.)+')|(?P<id>[^\W\d]\w*)|(?P<op>\|\||&&|<<|>>|[=!<>]=|[-+*/%&|^!~<>?:(),])")
#: Operators of conditions by how tightly they bind.
_COND_LEVELS = {op: n for n, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")) for op in ops.split()}
_WORD_MASK = (1 << 64) - 1


class _Unreadable(Exception):
    pass


class _Condition:
    """Value of an ``#if`` condition: 64-bit integers, unknown names are 0, macros are values of their own.

    A macro's value is worked out once; a name within its own value is 0.
    """

    def __init__(self, macros: dict):
        self.macros = macros
        self.values: dict[str, int | None] = {}

    def value(self, text: str) -> int:
        toks = []
        at = 0
        while at < len(text):
            m = _COND_LEX.match(text, at)
            if not m:
                raise _Unreadable
            if m.lastgroup:
                toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.toks, self.at, saved = toks, 0, (getattr(self, "toks", []), getattr(self, "at", 0))
        try:
            got = self._choice()
            if self.at != len(toks):
                raise _Unreadable
        finally:
            self.toks, self.at = saved
        return got

    def _next(self) -> str:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] == "op" else ""

    def _choice(self) -> int:
        test = self._binary(0)
        if self._next() != "?":
            return test
        self.at += 1
        one = self._choice()
        if self._next() != ":":
            raise _Unreadable
        self.at += 1
        two = self._choice()
        return one if test else two

    def _binary(self, level: int) -> int:
        left = self._unary()
        while _COND_LEVELS.get(op := self._next(), -1) >= level:
            self.at += 1
            left = self._apply(op, left, self._binary(_COND_LEVELS[op] + 1))
        return left

    def _unary(self) -> int:
        if self.at >= len(self.toks):
            raise _Unreadable
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "num":
            digits = text.rstrip("uUlLzZ").replace("'", "") if not text.lower().startswith("0x") else re.sub(r"[uUlLzZ]+$", "", text).replace("'", "")
            octal = len(digits) > 1 and digits[0] == "0" and digits.isdigit()
            try:
                return int(digits, 8 if octal else 0) & _WORD_MASK
            except ValueError as e:
                raise _Unreadable from e
        if kind == "chr":
            return ord(text[-2])
        if kind == "id":
            return self._name(text)
        if text == "(":
            got = self._choice()
            if self._next() != ")":
                raise _Unreadable
            self.at += 1
            return got
        if text in ("!", "-", "+", "~"):
            x = self._unary()
            return {"!": int(not x), "-": -x, "+": x, "~": ~x}[text]
        raise _Unreadable

    def _name(self, name: str) -> int:
        if name in ("true", "false"):
            return int(name == "true")
        if self._next() == "(":  # a macro with arguments
            raise _Unreadable
        if name not in self.values:
            self.values[name] = 0
            if self.macros.get(name):
                self.values[name] = self.value(self.macros[name])
        return self.values[name]

    @staticmethod
    def _apply(op: str, a: int, b: int) -> int:
        if op in ("/", "%"):
            if not b:
                return 0
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if op == "/" else a - b * q
        if op in ("<<", ">>"):
            b = min(max(b, 0), 64)
        got = {"||": lambda: bool(a or b), "&&": lambda: bool(a and b), "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "<<": lambda: a << b, ">>": lambda: a >> b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
        return (int(got) + (1 << 63)) % (1 << 64) - (1 << 63)


def _condition(text: str, macros: dict) -> bool:
    """Whether an ``#if`` condition holds; unknown names are 0, a condition that cannot be read is true."""
    text = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: str(int((m[1] or m[2]) in macros)), text)
    text = re.sub(r"__has_\w+\s*\([^()]*\)", "0", text)
    text = re.sub(r"\b(?:and|or|not)\b", lambda m: {"and": "&&", "or": "||", "not": "!"}[m[0]], text)
    limit = sys.getrecursionlimit()
    try:
        return bool(_Condition(macros).value(text))
    except _Unreadable:
        return True
    except RecursionError:
        sys.setrecursionlimit(max(limit, 16 * (len(text) + sum(len(x or "") for x in macros.values()))))
    try:
        return bool(_Condition(macros).value(text))
    except _Unreadable:
        return True
    finally:
        sys.setrecursionlimit(limit)


_SIGNS = frozenset("+ -".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_PTR = frozenset("* & &&".split())
_KEEP = frozenset("( ) [ ] { } ; , : :: . -> ++ -- ~ ! ? ...".split())


_HEADS = frozenset("class struct union enum namespace".split())
_HEAD_ENDS = frozenset("; { } ( ) ASSIGN return BRACED".split())


def cpp_labels(source: str) -> tuple[list[str], list[int]]:
    labels, lines, _ = cpp_stream(source)
    return labels, lines


def cpp_stream(source: str) -> tuple[list[str], list[int], list[str]]:
    """Token labels, their lines and texts; raises :class:`LexError`."""
    toks = cpp_tokens(source)
    labels: list[str] = []
    lines: list[int] = []
    texts: list[str] = []
    i, n, brackets = 0, len(toks), 0
    templates: list[int] = []  # brackets open around each template argument list
    squares: list[str] = []  # labels of the open square brackets
    lambda_end = -1

    def skip_group(k: int) -> int:
        """Index behind the bracket group that opens at ``k``."""
        depth = 0
        while k < n:
            depth += (toks[k][1] in ("(", "[", "{")) - (toks[k][1] in (")", "]", "}"))
            k += 1
            if depth <= 0:
                break
        return k

    ends: dict[int, int] = {}
    groups = _groups(toks)
    head = False  # whether a class, enum or namespace has been named and not begun
    heads: list[bool] = []  # the same around open template arguments

    def add(label: str, text: str, line: int) -> None:
        nonlocal head
        if label in _HEADS:
            head = True
        elif label in _HEAD_ENDS:
            head = False
            if label in (";", "{", "}"):
                heads.clear()
        elif label == "TLT":
            heads.append(head)
        elif label == "TGT" and heads:
            head = heads.pop()
        labels.append(label)
        texts.append(text)
        lines.append(line)

    while i < n:
        kind, text, line = toks[i]
        if kind in ("str", "raw"):
            add("STR", text, line)
        elif kind == "chr":
            add("CHR", text, line)
        elif kind == "num":
            add("NUM", text, line)
        elif kind == "id":
            if text in _CPP_CALLS and i + 1 < n and toks[i + 1][1] == "(":
                i = skip_group(i + 1)
                if text == "decltype":
                    add("SPEC", text, line)
                continue
            if text == "requires" and labels and labels[-1] == "TGT" and (end := _constraint(toks, i + 1, groups, ends)):
                i = end
                continue
            if text == "inline" and i + 1 < n and toks[i + 1][1] == "namespace":
                i += 1
                continue
            if text == "operator":
                j = i + 1
                if j < n and toks[j][1] == "(" and j + 1 < n and toks[j + 1][1] == ")":
                    j += 2
                elif j < n and toks[j][1] == "[" and j + 1 < n and toks[j + 1][1] == "]":
                    j += 2
                elif j < n and (toks[j][0] == "op" or toks[j][1] in ("new", "delete")):
                    j += 1
                    if j + 1 < n and toks[j][1] == "[" and toks[j + 1][1] == "]":
                        j += 2
                add("ID", "operator", line)
                i = j
                continue
            if text in ("and", "or", "xor", "bitand", "bitor", "not_eq"):
                add("OP", text, line)
            elif text in ("not", "compl"):
                add("!", text, line)
            elif text in ("true", "false", "nullptr"):
                add("NUM", text, line)
            else:
                add(text if text in CPP_WORDS else "SPEC" if text in CPP_SPEC else "ID", text, line)
        elif text == "[" and i + 1 < n and toks[i + 1][1] == "[":
            end = skip_group(i)
            if end - 2 > i and toks[end - 1][1] == "]" and toks[end - 2][1] == "]" and (not texts or texts[-1] not in ("delete",)):
                i = end  # an attribute
                continue
            add("LAMBDA", text, line)
        elif text == "<" and (lambda_end == i - 1 or _opens_template(toks, i, groups, ends)):
            add("TLT", text, line)
            templates.append(brackets)
        elif text in (">", ">>") and templates and templates[-1] >= brackets:
            for _ in text:
                add("TGT" if templates else "OP", ">", line)
                if templates:
                    templates.pop()
        elif text in ("&", "&&") and labels and labels[-1] in (")", "SPEC") and i + 1 < n and (toks[i + 1][1] == "{" and (labels[-1] == ")" or texts[-1] in ("const", "volatile")) or toks[i + 1][1] in ("noexcept", "override", "final")):
            i += 1  # says which objects a member function is for
            continue
        elif text == "[":
            prev = labels[-1] if labels else ""
            squares.append("[" if prev in ("ID", ")", "]", "TGT", "NUM", "STR", "SPEC", "delete", "this", "}", "PTR") and not (prev == "SPEC" and texts[-1] in ("return",)) else "LAMBDA")
            add(squares[-1], text, line)
        elif text == "{":
            value = labels and (labels[-1] in ("ID", "TGT") or labels[-1] == "SPEC" and texts[-1] in _CPP_TYPES)
            add("BRACED" if value and not head else "{", text, line)
        elif text == "->" and labels and labels[-1] in (")", "SPEC") and (end := _trailing_type(toks, i + 1, groups)):
            i = end
            continue
        elif text in _KEEP:
            add(text, text, line)
        elif text in _SIGNS:
            add("SIGN", text, line)
        elif text in _ASSIGN:
            add("ASSIGN", text, line)
        elif text in _PTR:
            add("PTR", text, line)
        else:
            add("OP", text, line)
        brackets += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
        if text == "]" and squares and squares.pop() == "LAMBDA":
            lambda_end = i
        if text in ("{", "}", ";"):
            templates.clear()
        i += 1
    add("END", "", toks[-1][2] if toks else 1)
    _conditions(labels)
    return labels, lines, texts


def _conditions(labels: list[str]) -> None:
    """Marks the brackets of conditions that declare nothing, and those of pointers to functions without a name."""
    open_: list[int] = []
    declares: list[bool] = []
    heads: list[int] = []
    for i, label in enumerate(labels):
        if label in ("(", "[", "{", "BRACED", "LAMBDA"):
            if label == "BRACED" and declares:
                declares[-1] = True
            open_.append(i)
            declares.append(False)
        elif label in ("ASSIGN", ";") and declares:
            declares[-1] = True
        elif label in (")", "]", "}") and open_:
            at, has = open_.pop(), declares.pop()
            if labels[at] != "(":
                continue
            before = labels[at - 1] if at else ""
            if before in ("if", "while", "switch") or before == "SPEC" and at > 1 and labels[at - 2] == "if":
                if not has:
                    heads.append(at)
            elif i > at + 1 and labels[at + 1] == "PTR" and all(x in ("PTR", "SPEC") for x in labels[at + 1 : i]) and labels[i + 1 : i + 2] == ["("]:
                labels[at] = "FPTR"
    for at in heads:
        labels[at] = "XP"


#: Words that are a type by themselves.
_CPP_TYPES = frozenset("int char bool float double void long short signed unsigned auto wchar_t char8_t char16_t char32_t".split())
_CPP_BEFORE_DOT = frozenset("ID ) ] TGT } STR NUM CHR this ++ -- { , BRACED".split())
_CPP_OPERAND_ENDS = frozenset("NUM CHR ]".split())


class _CppRules:
    """What the grammar leaves open because it cannot tell types from values: operands without an operator between
    them, operators without one behind them, declarations without a name, parameters that are no declarations."""

    def __init__(self, labels: list[str], texts: list[str]):
        self.labels, self.texts = labels, texts
        self.bad: list[int] = []
        self.close: dict[int, int] = {}
        open_: list[int] = []
        depth: list[int] = []  # brackets and template arguments around each token in its braces, for heads left out
        inner = [0]
        for i, label in enumerate(labels):
            depth.append(inner[-1])
            if label in ("(", "[", "{", "BRACED", "LAMBDA", "XP", "FPTR", "TLT"):
                open_.append(i)
                if label in ("{", "BRACED"):
                    inner.append(0)
                else:
                    inner[-1] += label != "(" or not i or labels[i - 1] != "for"
            elif label in (")", "]", "}", "TGT") and open_:
                at = open_.pop()
                self.close[at] = i
                if labels[at] in ("{", "BRACED"):
                    inner.pop()
                else:
                    inner[-1] -= labels[at] != "(" or not at or labels[at - 1] != "for"
        for i in range(1, len(labels)):
            self._pair(i, depth[i])
        self._declarations()

    def _type(self, i: int) -> bool:
        return self.labels[i] == "SPEC" and self.texts[i] in _CPP_TYPES

    def _pair(self, i: int, depth: int) -> None:
        """Two tokens that cannot stand side by side."""
        labels = self.labels
        before, label = labels[i - 1], labels[i]
        wrong = False
        if label in ("NUM", "CHR"):
            wrong = before in ("ID", "TGT", "STR") or before in _CPP_OPERAND_ENDS or self._type(i - 1)
        elif label == "SPEC":
            if self._type(i):
                wrong = before in _CPP_OPERAND_ENDS or before == "ID" and i > 1 and (labels[i - 2] in ("return", "PTR", "TGT") or self._type(i - 2)) and self.texts[i - 1] != "operator"
            else:
                wrong = before in ("NUM", "CHR") and self.texts[i] in ("const", "static", "inline", "volatile")
        elif label in ("SIGN", "OP", "?"):
            wrong = self._type(i - 1) and not (label == "OP" and self.texts[i] in (">", ">>", "<"))
        elif label == ".":
            wrong = before not in _CPP_BEFORE_DOT
        elif label == "->":
            wrong = self._type(i - 1) or before in ("SIGN", "OP", "PTR", "ASSIGN", "(", ",", ";", "{", "}")
        elif label == "ASSIGN" and self.texts[i] == "=" and not depth:
            wrong = self._type(i - 1) or before == "PTR"
        elif label in (";", ")", ",", "]"):
            wrong = before in ("SIGN", "OP", "?") or before == "PTR" and i > 1 and labels[i - 2] in ("NUM", "CHR")
        if wrong:
            self.bad.append(i)

    def _declarations(self) -> None:
        """Function definitions outside of functions, and statements that end in an open operator."""
        labels = self.labels
        outside = [True]  # whether each open brace holds declarations
        start, i = 0, 0
        while i < len(labels):
            label = labels[i]
            if label == ";" and labels[i - 1] == "PTR" and labels[start] not in ("using", "typedef", "template", "extern", "friend") and "new" not in labels[start:i]:
                self.bad.append(i)
            if label in ("{", "BRACED"):
                head = labels[start:i]
                outside.append(outside[-1] and "(" not in head and "ASSIGN" not in head and any(x in ("namespace", "class", "struct", "union", "extern") for x in head))
                if outside[-2] and "(" in head and not outside[-1]:
                    self._function(start, i)
                start = i + 1
            elif label == "}" and len(outside) > 1:
                outside.pop()
                start = i + 1
            elif label == ";" or label == ":" and labels[i - 1] in ("public", "private", "protected"):
                start = i + 1
            i += 1

    def _function(self, lo: int, hi: int) -> None:
        """The head of a function definition between ``lo`` and its body at ``hi``."""
        labels = self.labels
        k = lo
        while k < hi and labels[k] not in ("(", "FPTR", "XP"):
            if labels[k] in ("ASSIGN", "requires", "enum"):
                return
            k = self.close.get(k, k) + 1 if labels[k] in ("TLT", "[", "LAMBDA") else k + 1
        if k >= hi or labels[k] != "(" or k not in self.close:
            return
        named = labels[k - 1] in ("ID", "TGT") or any(self.texts[n] == "operator" for n in range(lo, k))
        if not named and k > lo and self._type(k - 1) and self.close[k] == hi - 1:
            self.bad.append(k)
        if not named or labels[k - 1] != "ID":
            return
        at, default = k + 1, False
        while at < self.close[k]:
            label = labels[at]
            if label == ",":
                default = False
            elif label == "ASSIGN":
                default = True
            elif not default and (label in ("OP", "SIGN", "?", ".", "->", "++", "--", "!", "NUM", "STR", "CHR", "this", "new") and self.texts[at] not in ("and",)):
                self.bad.append(at)
                return
            at = self.close.get(at, at) + 1 if label in ("(", "[", "{", "BRACED", "LAMBDA", "FPTR", "TLT") else at + 1


def cpp_flaw(labels: list[str], texts: list[str]) -> int | None:
    """The first token of an accepted stream at which the language has an error all the same, or None."""
    return min(_CppRules(labels, texts).bad, default=None)


def _groups(toks: list) -> dict[int, int]:
    """Opening round or square bracket -> the one that closes it."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for k, (_, text, _) in enumerate(toks):
        if text in ("(", "["):
            open_.append(k)
        elif text in (")", "]") and open_:
            out[open_.pop()] = k
    return out


def _opens_template(toks: list, i: int, groups: dict[int, int], ends: dict[int, int]) -> bool:
    """Whether the ``<`` at ``i`` opens template arguments: a name or ``template`` before it, only type-like
    tokens up to its ``>``, and something behind that can follow a type.

    ``ends`` keeps the ``>`` of each ``<`` that a scan has passed, or -1, so that no token is scanned again and again.
    """
    if i == 0:
        return False
    before = toks[i - 1]
    if before[1] == "template":
        return True
    if before[0] != "id" or before[1] in CPP_SPEC:
        return False
    if i not in ends:
        _scan_arguments(toks, i, groups, ends)
    if ends[i] < 0:
        return False
    after = toks[ends[i] + 1] if ends[i] + 1 < len(toks) else ("op", ";", 0)
    return after[0] == "id" or after[1] in ("::", "(", "{", "&", "&&", "*", ">", ">>", ",", ")", ";", "...", "[", "=", "|", "}")


def _scan_arguments(toks: list, i: int, groups: dict[int, int], ends: dict[int, int]) -> None:
    """Finds the ``>`` of the ``<`` at ``i`` and of those in between, as far as tokens can stand in arguments."""
    open_: list[int] = []
    k = i
    while k < len(toks):
        kind, text, _ = toks[k]
        if text == "<":
            open_.append(k)
        elif text in (">", ">>"):
            for _ in text:
                if open_:
                    ends[open_.pop()] = k
            if not open_:
                return
        elif text in ("(", "["):
            if k not in groups:
                break
            k = groups[k]
        elif not (kind in ("id", "num", "chr", "str") or text in ("::", ",", "*", "&", "...", "-", "+", "=") or text == "&&" and k + 1 < len(toks) and toks[k + 1][1] in (",", ">", ">>", "...")):
            break
        if kind == "id" and text in ("return", "if", "for", "while"):
            break
        k += 1
    ends.update(dict.fromkeys(open_, -1))


def _constraint(toks: list, k: int, groups: dict[int, int], ends: dict[int, int]) -> int:
    """Index behind the constraint of a template that begins at ``k``, or 0 if it is none."""
    while k < len(toks):
        if toks[k][1] == "!":
            k += 1
            continue
        if toks[k][1] == "(":
            k = groups.get(k, len(toks)) + 1
        elif toks[k][0] == "id":
            while k + 2 < len(toks) and toks[k + 1][1] == "::":
                k += 2
            k += 1
            if k < len(toks) and toks[k][1] == "<":
                if k not in ends:
                    _scan_arguments(toks, k, groups, ends)
                k = ends[k] + 1
                if not k:
                    return 0
        else:
            return 0
        if k < len(toks) and toks[k][1] in ("&&", "||"):
            k += 1
            continue
        return k
    return 0


def _trailing_type(toks: list, k: int, groups: dict[int, int]) -> int:
    """Index of the ``{`` that ends a trailing return type beginning at ``k``, or 0."""
    depth = 0
    while k < len(toks):
        kind, text, _ = toks[k]
        if text == "decltype" and k + 1 < len(toks) and toks[k + 1][1] == "(":
            k = groups.get(k + 1, k + 1) + 1
            continue
        if text == "<":
            depth += 1
        elif text in (">", ">>"):
            depth -= len(text)
        elif text == "{" and depth <= 0:
            return k
        elif not (kind in ("id", "num") or text in ("::", "*", "&", "&&", "...") or depth > 0 and text in (",", "(", ")")):
            return 0
        k += 1
    return 0


# ---------------------------------------------------------------- proto

PROTO_WORDS = frozenset(
    "syntax edition import weak public package option message enum extend service rpc returns stream oneof map repeated optional reserved extensions to max required group".split()
)
_PROTO_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<id>[A-Za-z_]\w*)|(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fF]?|\d+[eE][+-]?\d+[fF]?|\d+[fF])(?![\w.])
    |(?P<int>0[xX][\da-fA-F]+|\d+)(?![\w.])|(?P<str>"(?:[^"\\\n\0]|\\.)*"|'(?:[^'\\\n\0]|\\.)*')|(?P<op>[{}()\[\]<>;,=.:/+-])""",
    re.X | re.S | re.A,
)


def proto_labels(source: str) -> tuple[list[str], list[int]]:
    labels: list[str] = []
    lines: list[int] = []
    at, line = 0, 1
    while at < len(source):
        m = _PROTO_LEX.match(source, at)
        if not m:
            raise LexError(line, f"stray or unterminated {source[at : at + 10]!r}")
        kind, text = m.lastgroup, m[0]
        if kind != "skip":
            labels.append({"id": text if text in PROTO_WORDS else "NAME", "int": "INT", "float": "FLOAT", "str": "STRING"}.get(kind, text))
            lines.append(line)
        line += text.count("\n")
        at = m.end()
    labels.append("END")
    lines.append(line)
    return labels, lines


_LEXERS = {"python": python_labels, "proto": proto_labels}


def first_error(content: bytes | None, language: str) -> Error | None:
    """The first unrecoverable error of a file, or None if it parses; null and empty files parse."""
    text = bytes(content or b"").decode("utf-8", errors="replace").removeprefix("﻿")
    if language == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    texts: list[str] = []
    try:
        if language == "cpp":
            labels, lines, texts = cpp_stream(text)
        else:
            labels, lines = _LEXERS[language](text)
    except LexError as e:
        return e.error
    except RecursionError:
        return Error(0, "nested too deeply")
    n = table(language).parse(labels)
    if n is None and language == "python":
        n = python_flaw(labels)
    elif n is None and language == "cpp":
        n = cpp_flaw(labels, texts)
    return None if n is None else Error(lines[n], f"unexpected {labels[n]}")


def unparsable_files(files: DataFrame) -> DataFrame:
    """Files that do not parse: ``file_path, directory, language, line, message``, one row per path.

    A file's language follows from its path's extension in any letter case, whatever ``ext`` says; other
    files and null paths are left out.  Several scans of a path with different bytes count once each.
    """
    schema = "file_path string, directory string, language string, line int, message string"
    src = _sources(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                e = first_error(r["content"], r["language"])
                if e is not None:
                    rows.append({"file_path": r["path"], "directory": r["directory"], "language": r["language"], "line": e.line, "message": e.message})
            cols = ("file_path", "directory", "language", "line", "message")
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(cols, types, strict=True)], names=cols)

    return src.mapInArrow(run, schema).distinct()


def _sources(files: DataFrame) -> DataFrame:
    ext = extension(F.col("path"))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext]
    directory = F.col("directory") if "directory" in files.columns else F.lit(None).cast("string")
    return spread(files.where(F.col("path").isNotNull() & ext.isin(*LANGUAGES)).select("path", "content", directory.alias("directory"), language.alias("language")))


def parse_rates(files: DataFrame) -> DataFrame:
    """Per directory and language: ``n_files, n_failed, rate``; a path counts once, in the first of its directories."""
    paths = _sources(files).groupBy("path", "language").agg(F.min("directory").alias("directory"))
    failed = unparsable_files(files).select(F.col("file_path").alias("path")).distinct().withColumn("failed", F.lit(1))
    counts = paths.join(failed, "path", "left").groupBy("directory", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("failed").alias("n_failed"))
    return counts.select("directory", "language", "n_files", "n_failed", F.round(F.col("n_failed") / F.col("n_files"), 6).alias("rate"))
