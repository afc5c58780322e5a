import ast
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm.lltable import Table
from chunkloom.llm.syntax import first_error, parse_rates, unparsable_files


def bad(text, language):
    return first_error(text.encode() if isinstance(text, str) else text, language) is not None


GOOD_PY = [
    "",
    "x = 1\n",
    "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a\n",
    "async def f():\n    async with a as b, c:\n        await d\n    return [x async for x in y if x]\n",
    "with (open(a) as b, open(c) as d,):\n    pass\n",
    "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': b, **c} | P(x=1) as q:\n        pass\n    case _:\n        pass\n",
    "match = 1\nmatch.x = case = type\nprint(match)\n",
    "type X[T: int, *U] = list[T]\nclass A[T](B, m=1):\n    x: int = 1\n",
    "@a.b(1)\n@c\nclass D: pass\n",
    "f'{x!r:>{w}} {y=} {{z}}' 'b'\n",
    "lambda *a, b=1, **c: (yield)\n",
    "if (n := 1) and not a is not b or c not in d: pass\nelif x: pass\nelse: y\n",
    "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n",
    "x[1:2, ::3, ...] = y @ z ** -1\n*a, b = c\ndel a[0], b\n",
    "from . import a\nfrom .b import (c as d, e,)\nimport f.g as h, i\n",
]
BAD_PY = ["print 'x'\n", "exec a in b\n", "def f(:\n  pass\n", "if x\n    pass\n", "x = (1\n", "x = 1)\n", "async = 1\n", "<<<<<<< HEAD\nx\n", "def f():\nreturn 1\n", "  x = 1\n", "if a:\n\tx\n        y\n", "x = 'abc\n", "a\0b\n", "x = = 1\n", "for x in y\n  pass\n", "class A\n  pass\n", "<html>\n", "f'{x'\n", "return = 1\n", "x = 5 y = 6\n", "match x:\n    pass\n"]


@pytest.mark.parametrize("text", GOOD_PY)
def test_good_python(text):
    ast.parse(text)
    assert not bad(text, "python")


@pytest.mark.parametrize("text", BAD_PY)
def test_bad_python(text):
    with pytest.raises((SyntaxError, ValueError)):
        ast.parse(text)
    assert bad(text, "python")


GOOD_CPP = [
    "",
    "#include <vector>\n#if 0\n}}} not code {{{\n#else\nint x;\n#endif\n",
    "template <typename T, int N = 3> class A : public B<T>, private C { public: A(int a) : b_(a), c_{1} {} virtual ~A() = default; int f() const override { return b_; } int b_ = 0; };",
    "namespace a::b { inline namespace c { enum class E : int { X = 1, Y, }; } using F = std::function<void(int)>; }",
    "int main() { for (auto& x : v) { if (a < b && c > d) { f<int>(x); } else return 1; } do { i++; } while (i < 3); switch (x) { case 1: break; default: { } } }",
    "auto f = [&, x = 1](int a) mutable -> std::vector<int> { return {a, x}; };",
    "static const unsigned t[] = {1, 0x2f, 'a', \"s\" \"t\"};\nint (*fp)(int) = nullptr;",
    "struct P { int x, y; } p = {1, 2}; bool operator==(const P& a, const P& b) { return a.x == b.x; }",
    'const char* s = R"x(" ) { ;)x"; char c = \'{\';',
    "void g() { try { throw E(1); } catch (const E& e) { } catch (...) { } int* p = new int[3]; delete[] p; x = static_cast<int>(y) * (int)z; goto end; end: return; }",
    "extern \"C\" { void h(void); }\ntypedef unsigned long ul;\nclass Q;\nfriend class R;",
    "[[nodiscard]] constexpr auto sq(auto x) noexcept(true) { return x * x; }",
    "#define N 3\n#ifdef N\nint a[N];\n#else\n{{{\n#endif\nstd::map<std::string, std::vector<int>> m{{\"a\", {1}}};",
]
BAD_CPP = ["int f( {", "int x = ;", "int f() { return 1;", "}", "int f() { g(x) }", "<<<<<<< HEAD\nint x;", "@@ -1 +1 @@", 'char* s = "open;\n', "int f() { a = 1 b = 2; }", "def f(x):\n    return x\n", "<!doctype html>", "int f() { if (x { } }", "int a\0;", "#if 1\nint x;\n", "class A { int x; ", "int f() { while (a > 3 { b(); } }", "int f() { std::sort(a, b)\n total += 1; }"]


@pytest.mark.parametrize("text", GOOD_CPP)
def test_good_cpp(text):
    assert first_error(text.encode(), "cpp") is None


@pytest.mark.parametrize("text", BAD_CPP)
def test_bad_cpp(text):
    assert bad(text, "cpp")


GOOD_PROTO = [
    "",
    'syntax = "proto3";\npackage a.b;\nimport public "x.proto";\noption java_package = "c";\nmessage M { reserved 1, 3 to max; map<string, .a.B> m = 4; oneof o { int32 x = 5 [deprecated = true]; } repeated Foo f = 6; message In {} enum E { A = 0; B = -1; } optional string message = 7; }\nservice S { rpc Go (stream Req) returns (a.Res) { option (x.y) = { a: 1 b { c: "d" } }; } }',
]
BAD_PROTO = ["message M { string x = ; }", "message M { string x = 1 }", "message M {", 'message M { string x = "open;\n }', "<<<<<<< HEAD", "service S { rpc Go Req returns (R); }", "int x;", "enum E { A; }"]


@pytest.mark.parametrize("text,want", [(x, False) for x in GOOD_PROTO] + [(x, True) for x in BAD_PROTO])
def test_proto(text, want):
    assert bad(text, "proto") is want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x", "1", "(", ")", "[", "]", "+", "=", ",", ":", "if", "else", "not", "in", "lambda", "*", "def f():", "\n", "\n    ", "pass", "'s'", ".", "return", "for", "await", "yield"]), max_size=12))
def test_python_agrees_with_the_interpreter_on_rejections(parts):
    text = " ".join(parts) + "\n"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
    if ok:
        assert not bad(text, "python"), text


def test_error_position():
    assert first_error(b"x = 1\ny = = 2\n", "python").line == 2
    assert first_error(b"int a;\nint b = ;\n", "cpp").line == 2


def test_table_reports_left_recursion():
    with pytest.raises(ValueError):
        Table("a: a 'x' | 'y'")


def test_files(spark):
    rows = [("/r/a.PY", b"x = (", "d"), ("/r/a.PY", b"x = (", "d"), ("/r/b.py", b"\xef\xbb\xbfx = 1", "d"), ("/r/c.cpp", None, None), ("/r/d.md", b"(((", "d"), (None, b"(", "d"), ("/r/e.proto", b"}", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None, d, 1) for p, c, d in rows], "path string, content binary, directory string, line int")
    assert sorted(r.file_path for r in unparsable_files(df).collect()) == ["/r/a.PY", "/r/e.proto"]
    rates = {(r.directory, r.language): (r.n_files, r.n_failed, r.rate) for r in parse_rates(df).collect()}
    assert rates == {("d", "python"): (2, 1, 0.5), (None, "cpp"): (1, 0, 0.0), (None, "proto"): (1, 1, 1.0)}
    assert unparsable_files(df.limit(0)).count() == 0
