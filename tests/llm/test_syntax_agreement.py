"""The bundled Python grammar against the interpreter's own parser, and conditions of the C++ preprocessor."""

import ast
import io
import random
import tokenize
import warnings
from pathlib import Path

import pytest

from chunkloom.llm import syntax

SOURCES = sorted((Path(__file__).resolve().parents[2] / "chunkloom").rglob("*.py"))
EXTRA = "( ) [ ] { } , : = == * ** . ; x 1 'a' f if else for in not lambda def class return yield await async with as := -> @ del pass import from None True + - % ... ! /".split()


def parses(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "f", "exec", ast.PyCF_ONLY_AST)
            return True
        except (SyntaxError, ValueError):
            return False


def statements():
    for p in SOURCES:
        text = p.read_text()
        lines = text.split("\n")
        for n in ast.parse(text).body:
            first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
            part = "\n".join(lines[first - 1 : n.end_lineno]) + "\n"
            if len(part) < 1500 and parses(part):
                yield part


def changed(text, rng):
    """``text`` with one token left out, put in or replaced."""
    toks = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.string.strip() and t.type != tokenize.COMMENT]
    lines = [x + "\n" for x in text.split("\n")]
    at = lambda p: sum(map(len, lines[: p[0] - 1])) + p[1]
    t = rng.choice(toks)
    a, b = at(t.start), at(t.end)
    how = rng.random()
    if how < 0.4:
        return text[:a] + text[b:]
    new = rng.choice(EXTRA) if how < 0.85 else rng.choice(toks).string
    return text[:a] + new + " " + text[a if how < 0.7 else b :]


def test_changed_tokens_of_valid_statements():
    rng = random.Random(7)
    parts = list(statements())
    broken = 0
    for _ in range(2500):
        text = changed(rng.choice(parts), rng)
        want = parses(text)
        broken += not want
        assert (syntax.first_error(text.encode(), "python") is None) == want, text
    assert broken > 1000


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: p.name)
def test_own_sources_parse(path):
    assert syntax.first_error(path.read_bytes(), "python") is None


BROKEN = """f() = 1|1 = x|None = 1|x + 1 = 2|f() += 1|(a, b) += 1|[a] : int = 1|a, b: int|def f(a=1, b): pass|f(a=1, 2)|f(**a, *b)|f(**a, b)|{1: 2, 3}|{1, 2: 3}|{**a, 1}|def f(*): pass
def f(*, **k): pass|def f(a, *, *b): pass|def f(/, a): pass|def f(a, /, b, /): pass|def f(**k, a): pass|lambda *: 1|lambda a=1, b: 1|for f() in x: pass|for 1 in x: pass|[x for f() in y]|del f()|del 1|del (a, 1)|del *a
try: pass|try: pass\\nexcept A, e: pass|x = 0777|x = 1__0|x = 1_|x = 0b2|x = 0o8|x = 0x|x = 1e|1a = 2|a b|print 'x'|exec 'x'|raise A, B|import|import a.|from a import|from . import|from a import (b|from a import *, b|import a as|import a as b.c
if x|if x: |if x = 1: pass|while x = 1: pass|elif x: pass|else: pass|class A(: pass|class A: |class: pass|class A(b for b in c): pass|def f(: pass|def f() pass|def f(a b): pass|def 1(): pass|def f(a, a=): pass|return return|yield = 1|await|async x|async def|async if x: pass
with a as 1: pass|with a as f(): pass|with (a as b, c as d: pass|with : pass|with a as b c: pass|assert|assert x,|global|global 1|nonlocal a.b|x = |= x|x == |x +|x *|* x|x ** |not|x not|x in|x is|x is not|x if y|x if y else|x if else y|lambda|lambda x|lambda: |(|)|[|]|{|}|(]|[)|{]|x[|x[]|x[:|x[1:2:3:4]
f(|f(,)|f(a,,b)|f(a b)|f(a=)|f(=a)|f(1=2)|f(a.b=1)|f(a for a in b, c)|f(c, a for a in b)|(a, *b for a in c)|[*a for a in b]|{**a for a in b}|{a: b for}|[a for]|[for a in b]|[a for a]|[a for a in]|[a if b for a in c]|(x := 1, y := )|x := 1|(x.y := 1)|(x[0] := 1)|[x for x := 1 in y]
match x: case 1: pass|match x:\\n  case: pass|match x:\\n  case 1 pass|match x:\\n  case a.b(): |@|@x|@x\\nx = 1|"a|'a|\"\"\"a|'a' b'b'|b'a' 'b'|f'{'|f'{}'|f'{a'|f'{a!x}'|f'{a b}'|f'{*}'|x = $|x = ?|x = a?b|x = `a`|x <> y|x++ |x--y++|!x|x && y|x \\|\\| y|x ! y|a -> b|a => b|a: b: c|a = b: c|a = = b|a =+ = b
 x = 1|if x:\\npass|if x:\\n  a\\n b|def f():\\nreturn 1|for x in y:\\npass|while x:\\n|try:\\n  a\\nb|try:\\n  a\\nfinally:\\nb|class A:\\nx = 1|else|pass pass|break 1|continue x|del|del ,|raise from x|raise x from|import a, |import a b|from a.b.c|from ..|from a import b as|from a import b,|from a import (b,,c)|from a import ()
x = yield from|x = await|x: |x: = 1|x: int = |(x, y): int = 1|x, = |, x|x,, y|[,]|{,}|(,)|{:}|{a:}|{:a}|{a: b: c}|{a, b c}|[a b]|(a b)|a[b c]|a[b,,c]|a.1|a.|.a|a..b|...a|a...|1.a|1..a b|0x1.2p|'a'.'b'|a(b)(|a[b](|-|~|+ -|not not|and|or|a and|a or|and b|or b|a and or b""".replace("\n", "|")


def test_broken_snippets():
    snippets = [s.replace("\\n", "\n").replace("\0", "|") for s in BROKEN.replace("\\|", "\0").split("|")]
    assert len(snippets) > 200
    for s in snippets:
        assert (syntax.first_error(s.encode(), "python") is None) == parses(s.strip(" ") + "\n" if not s.startswith(" ") else s), s


CONDITIONS = [("1 + 2 == 3", {}, True), ("A", {"A": "B", "B": "A + 1"}, True), ("!defined(X) && (0 ? 1 : 2)", {}, True), ("010 == 8 and 0x10 == 16", {}, True), ("V >= 2", {"V": "2"}, True), ("1 / 0", {}, False), ("(1", {}, True), ("F(1)", {"F": None}, True), ("X", {}, False)]


@pytest.mark.parametrize("text,macros,want", CONDITIONS)
def test_conditions(text, macros, want):
    assert syntax._condition(text, macros) is want


def test_conditions_that_grow_end():
    assert syntax._condition("9*9*9*9 << 70", {}) is False
    assert syntax._condition("A0", {f"A{i}": f"A{i + 1} + A{i + 1}" for i in range(200)} | {"A200": "0"}) is False
    assert syntax._condition("A0", {f"A{i}": f"A{i + 1}" for i in range(30)} | {"A30": "1"}) is True


def test_rates_count_a_path_once(spark):
    rows = [("/a.py", b"x = ", "d1"), ("/a.py", b"x = ", "d2"), ("/b.py", b"x = 1", "d1"), ("/c.h", b"int x;", None)]
    df = spark.createDataFrame([(p, bytearray(c), d) for p, c, d in rows], "path string, content binary, directory string")
    got = {(r.directory, r.language): (r.n_files, r.n_failed, r.rate) for r in syntax.parse_rates(df).collect()}
    assert got == {("d1", "python"): (2, 1, 0.5), (None, "cpp"): (1, 0, 0.0)}
