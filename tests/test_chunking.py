import pytest

from chunkloom.chunking.cpp import chunk_cpp
from chunkloom.chunking.dispatch import chunk_file, chunk_files
from chunkloom.chunking.documents import chunk_markdown, chunk_pdf, title_chapter
from chunkloom.chunking.proto import chunk_proto, references
from chunkloom.chunking.python import chunk_python
from chunkloom.chunking.text import decode_text, fixed_split, pack_paragraphs, worth_chunking
from chunkloom.schema import FILES

PY = b'''# License header
import os

class A:
    """Doc."""
    x = 1
    def f(self):
        a = g()
        b = os.getcwd()
        return a
    def tiny(self):
        return 1

def g():
    y = 1
    z = 2
    return helper(y)

def outer():
    def inner():
        p = 1
        q = 2
        return p
    return inner
'''


def test_python_chunks():
    got = [(c["symbol_name"], c["chunk_type"], c["start_line"], c["end_line"], c["symbols_referenced"]) for c in chunk_python(PY, "m.py")]
    assert got == [
        ("A", "class", 3, 11, ["g", "getcwd"]),
        ("A::f", "method", 6, 9, ["g", "getcwd"]),
        ("g", "function", 13, 16, ["helper"]),
        ("outer", "function", 18, 23, []),
        ("inner", "function", 19, 22, []),
    ]
    assert all(c["content"].startswith("# File: m.py\nimport os\n\n") for c in chunk_python(PY, "m.py"))
    assert next(iter(chunk_python(PY, "m.py")))["file_start_line"] == 4


def test_python_skeletons():
    body = "\n".join(f"    x{i} = call_{i}()" for i in range(120))
    src = f'def big(a):\n    """Says what."""\n{body}\n    return 1\n'.encode()
    (c,) = chunk_python(src, "m.py")
    assert c["content"].endswith('def big(a):\n    """Says what."""\n    ...')


def test_python_syntax_error_is_reported(spark):
    files = spark.createDataFrame([("/r/a.py", "a.py", ".py", bytearray(b"x = 1\ny = 2\ndef f(:\n    pass\n"), "h"), ("/r/b.txt", "b.txt", ".txt", bytearray(b"hi"), "h"), (None, "c.py", ".py", None, "h"), ("/r/e.py", "e.py", None, None, "h")], FILES)
    rows = chunk_files(files).collect()
    assert [(r.file_path, r.error.split(":")[0]) for r in rows] == [("/r/a.py", "SyntaxError")]


CPP = b"""// header
#include <vector>
namespace ns {
template <typename T>
class Box : public Base<T> {
public:
    Box(int a) : a_(a) { init(a); }
    int get() const { return a_; }
private:
    int a_ = 0;
};
static int run(std::vector<int>& v) {
    v.push_back(1);
    return std::max(1, helper(v));
}
}
int Outer::method(int x) { return x; }
struct Plain;
int declared(int);
"""


def test_cpp_chunks():
    got = [(c["symbol_name"], c["chunk_type"], c["symbols_referenced"]) for c in chunk_cpp(CPP, "m.cpp")]
    assert got == [
        ("ns::Box", "class", got[0][2]),
        ("ns::Box::Box", "method", ["init"]),
        ("ns::Box::get", "method", []),
        ("ns::run", "method", ["helper", "max", "v.push_back"]),
        ("Outer::method", "free_function", []),
    ]


def test_cpp_class_skeleton():
    members = "\n".join(f"    int f{i}(int a) {{ return a + {i}; }}" for i in range(80))
    (first, *_) = chunk_cpp(f"int a;\nint b;\nclass Big {{\npublic:\n{members}\n    int x_;\n}};\n".encode(), "b.h")
    assert "int f0(int a) {...}" in first["content"] and "int x_;" in first["content"] and "return" not in first["content"]


def test_markdown_sections():
    text = "x" * 120 + "\n## 1.2 Setup\n" + "y" * 120 + "\n# Chapitre 3\n" + "z" * 50 + "\n### Tail\n" + "w" * 150
    got = [(c["symbol_name"], c["chapter"], c["level"], c["page_start"]) for c in chunk_markdown(text.encode(), "guide.md")]
    assert got == [("guide", "", 2, 1), ("1.2 Setup", "1.2", 1, 2), ("Tail", "", 1, 3)]


@pytest.mark.parametrize("title,want", [("1.2. Intro", "1.2"), ("Chapitre 3", "3"), ("chapitre2: x", "2"), ("2024 report", "2024"), ("3D view", ""), ("Chapter 3", ""), ("IV Intro", "")])
def test_title_chapter(title, want):
    assert title_chapter(title) == want


def test_proto():
    body = "myType x = 1; map<string, Foo> m = 2; google.Timestamp t = 3; repeated Bar b = 4; optional Baz z = 5;"
    assert references(body, "message") == ["Bar", "Baz", "Timestamp", "Type"]
    src = b'syntax = "proto3";\nmessage A {}\nmessage Outer {\n  message In {\n    int32 x = 1;\n  }\n}\nservice S {\n  rpc Go (Req) returns (Res);\n}\nmessage Open {\n  int32 y = 1;\n'
    got = [(c["symbol_name"], c["start_line"], c["end_line"], c["symbols_referenced"]) for c in chunk_proto(src, "a.proto")]
    assert got == [("Outer", 3, 7, []), ("S", 8, 10, ["Req", "Res"]), ("Open", 11, 13, [])]


def test_pdf_ranges():
    pages = [f"{n} " + "p" * 120 for n in range(1, 11)]
    toc = [(1, "1 Intro", 1), (1, "2 Design", 4), (2, "2.1 API", 4)]
    got = [(c["symbol_name"], c["page_start"], c["page_end"], c["chapter"]) for c in chunk_pdf(pages, toc, "d.pdf")]
    assert got == [("1 Intro", 1, 3, "1"), ("2.1 API", 4, 10, "2.1")]
    assert [c["symbol_name"] for c in chunk_pdf(["short", "q" * 100], [], "d.pdf")] == ["Page 2"]


def test_splitting():
    assert [len(x) for x in pack_paragraphs("a" * 1700)] == [1700]
    assert [len(x) for x in pack_paragraphs("\n\n".join(["a" * 800] * 3))] == [1602, 800]
    assert [len(x) for x in pack_paragraphs("a" * 50 + "\n\n" + "b" * 3500)] == [1700, 1700, 100]
    assert [len(x) for x in pack_paragraphs("a" * 3450)] == [1700, 1700]
    assert fixed_split("") == []


def test_text_rules():
    assert decode_text(b"\xef\xbb\xbfa\r\nb\rc\xff") == "a\nb\nc�"
    assert decode_text(None) == ""
    assert not worth_chunking("a\nb") and worth_chunking("a\nb\nc") and not worth_chunking("# a\n" * 30 + "x\n")


def test_dispatch_by_extension():
    assert list(chunk_file("/a.txt", "a.txt", ".txt", b"x")) == [] and list(chunk_file("/a", "a", None, None)) == []
    assert len(list(chunk_file("/a.PY", "a.PY", ".PY", PY))) == 5


def test_proto_without_context_and_short_types():
    from chunkloom.chunking.proto import chunk_proto, references

    (c,) = chunk_proto(b"message M {\n  A a = 1;\n  myT y = 2;\n}\n", "a.proto")
    assert c["content"].startswith("// File: a.proto\n\nmessage M {")
    assert references("A a = 1; myT y = 2; repeated Bar b = 3; myType z = 4;", "message") == ["Bar", "Type"]


def test_proto_block_that_closes_too_often_is_open():
    from chunkloom.chunking.proto import blocks

    assert list(blocks(["message A {", "  x", "}}", "y"])) == [("message", "A", 1, 5)]
