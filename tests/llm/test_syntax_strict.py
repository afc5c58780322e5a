import ast
import random
import re
import warnings

import pytest

from chunkloom.llm.syntax import first_error


def bad(text, language):
    return first_error(text.encode(), language) is not None


BAD_PY = ["x + 1 = 2\n", "f() += 1\n", "def f(a=1, b): pass\n", "f(x=1, y)\n", "try: pass\nexcept ValueError, e: pass\n", "(a, b) += 1\n", "del f()\n", "for f() in y: pass\n", "with a as f(): pass\n", "[x for f() in y]\n", "f(**a, *b)\n", "f(x for x in y, 1)\n", "lambda *, **k: 1\n", "{1: 2, 3}\n", "x.y := 1\n", "x = y := 1\n", "f(a.b=1)\n", "from import a\n", "match x:\n    case a * b: pass\n", "try: pass\nexcept A: pass\nexcept* B: pass\n", "x = 'a' b'b'\n", "(*a)\n"]
SEEDS = ["f(a, *b, c=1, **d)\n", "x = y = (a, *b)\n", "a.b[c] += 1\n(x): int = 3\n", "def f(a=1, *, b, **c) -> int: return {**a, 'b': 1}\n", "{1, *a}; [*a, b]; (*a, b)\n", "for (a, b), c in d: del a.x, b[0]\n", "[x for x, y in z if (q := x)]\n", "with a as (b, c), d as e.f: pass\n", "f(x for x in y)\n", "lambda a, /, b=1, *, c: a\n", "class A(B, metaclass=C, **k): x: int\n", "try: pass\nexcept A as e: pass\nexcept (B, C): pass\n", "f'{a:{b}}{c!r}{ {1: 2} }'\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c} | P(x=1) as q: pass\n"]


def parses(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
    return True


@pytest.mark.parametrize("text", BAD_PY)
def test_python_rejections(text):
    assert not parses(text) and bad(text, "python")


def test_damaged_python_agrees_with_the_interpreter_both_ways():
    rng, token = random.Random(1), re.compile(r"\s+|\w+|\*\*|:=|->|\+=|==|.", re.S)
    seen = {True: 0, False: 0}
    for _ in range(4000):
        t = token.findall(rng.choice(SEEDS))
        k, other = rng.randrange(len(t)), rng.choice(token.findall(rng.choice(SEEDS)))
        t[k : k + rng.randint(0, 1)] = rng.choice([[], [other]])
        text = "".join(t)
        ok = parses(text)
        seen[ok] += 1
        assert bad(text, "python") is not ok, text
    assert min(seen.values()) > 500


BAD_CPP = ["if (a == ) {}", "g(a b);", "x = (a + );", "f(1,,2);", "f(a,);", "while (a b) {}", "switch (a b) {}", "x = ();", "y = g(1, h(a b));", "return f(a b);", "int z(1,,2);", "o.m(a b);", "do {} while (a == );", "for (int i = 0; i < ; i++) {}", "if () {}", "v[a b] = 1;"]
GOOD_CPP = ["f((T*)p, (const U&)q, (unsigned)1, -1, !x, *y, &z);", "while (auto* p = next()) {}", "if (int n = f(); n > 0) {}", "for (const auto& [k, w] : m) f(k);", "auto [a, b] = f();", "f([=, &x] { return 1; }, [&](const A& a, B b) { return a < b; });", "x = sizeof(T*) + sizeof(struct s);", "return (args + ...);", "p = (void (*)(int))q;", "Foo x(a, b);", 'printf("%" PRId64 "\\n", n);', "x = a ? b : c; f(a ? b : c, {1, 2}, T{3});", "new (p) T(a);", "std::function<void(int, T)> f = nullptr;", "(*f)(a); (a->*b)(c);", "if ((n = read()) > 0) {}", "for (int i = 0, j = 1; i < j; ++i, --j) {}", "f(a * b, a & b, a && b, -c);", "void h(int a, const T& b = T(1), ...);"]


@pytest.mark.parametrize("text,want", [(x, True) for x in BAD_CPP] + [(x, False) for x in GOOD_CPP])
def test_cpp_brackets(text, want):
    assert bad("void fn() { " + text + " }", "cpp") is want


def test_proto3_has_no_required():
    assert bad('syntax = "proto3"; message M { required string x = 1; }', "proto")
    assert not bad('syntax = "proto3"; message M { string required = 1; optional int32 y = 2; }', "proto")


def test_long_heads_and_template_arguments():
    bases = ", ".join(f"public ns::B{k}<T>" for k in range(60))
    assert not bad(f"template <class T> class A : {bases} {{ int x; }};", "cpp")
    assert bad(f"template <class T> class A : {bases} {{ int x; ", "cpp")
    types = ", ".join(f"ns::T{k}<int, U{k}>" for k in range(200))
    assert not bad(f"std::variant<{types}> v{{1}}; void f() {{ g<{types}>(v); std::map<K, std::tuple<{types}>> m; }}", "cpp")
    assert not bad("template <class T> Box<T> box{1, 2};", "cpp")
    assert not bad("void f() { " + "x = a < b, " * 30_000 + "c; }", "cpp")


VALID_CPP = """template <typename T = int, class U = void*> struct A { T x{}; };
using P = int*; using Q = Foo&&; typedef int* R;
void f(int = 5, const Foo& = {}, char* s = nullptr);
template <class T> auto m(T&& t) noexcept -> decltype(t.x()) { return t.x(); }
struct B { operator bool() const { return true; } operator int*() { return p; } bool operator<(const B& o) const { return v < o.v; } int v = -1; int* p = nullptr; };
template <int N = (3 > 2), typename... Ts> struct C : public Base<N, Ts...>, private Other { C() : Base<N, Ts...>{}, a(1), b{2} {} };
template <Addable T> requires std::integral<T> && (sizeof(T) > 2) T sum(T a, T b) { return a + b; }
void nested() { while (int c = get()) { } for (auto& [k, v] : m) { } for (const auto x : {1, 2}) {} }
unsigned f2(unsigned a) { return unsigned(a) + int{3} + double(); }
auto gen = [] { return 1; }; auto g2 = []<typename T>(T x) { return x; };
int Foo::bar(int x) const & { return x; } Foo::Foo(int x) : x_(x), y_{} {} Foo::~Foo() {}
int a = b * 5, *c = &a, d(3), e{4}; void q() { x = y & 5; (void)x; *p++ = *q--; x = a < b && c > d; }
void lam() { auto l = [&, x = 1](auto a, int b = 2) mutable noexcept -> int { return a + b; }; }"""
BROKEN_CPP = """int total 11;|char c 'x';|void f() { 15: return; }|void f() { (limit) { } }|int f(std::vector<int& rows, int limit) { }|int f(std::vectorint>& rows, int b) { }|int f(int . limit) { }|int f(int -> limit) { }|int f(Foo& rows int limit) { }
int f(int a, + limit) { }|int + f(int a) { }|void f() { return total int; }|auto = g();|void f() { for (int = 0; i < 3; ++i) ; }|static int (int a, int b) { }|void f() { int total = 52 & ; }|void f() { switch (x) { case int 20: return; } }|void f() { total * = 5; }|void f() { & (g(1)) { } }|int x = a + ;|int y = (a -);|void f() { g(5 x); }""".replace("\n", "|").split("|")


@pytest.mark.parametrize("text", VALID_CPP.split("\n"))
def test_valid_cpp(text):
    assert first_error(text.encode(), "cpp") is None


@pytest.mark.parametrize("text", BROKEN_CPP)
def test_broken_cpp(text):
    assert first_error(text.encode(), "cpp") is not None
