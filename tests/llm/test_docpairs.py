import pytest

from chunkloom.llm.docpairs import documented_functions, extract, is_informative
from chunkloom.llm.peg import Grammar

PY = "# File: a.py\nimport os\n\n"


def informative(content, symbol="walk_ledger", language="python"):
    p = extract(content, language)
    return bool(p.doc) and is_informative(p.doc, symbol, p.signature, language)


@pytest.mark.parametrize(
    "body,want",
    [
        ('def walk_ledger(rows):\n    """Drops rows that expired before the cutoff."""\n    return 1\n', True),
        ("# Drops rows that expired before the cutoff.\n@traced\ndef walk_ledger(rows):\n    return 1\n", True),
        ("# Drops rows that expired before the cutoff.\n\ndef walk_ledger(rows):\n    return 1\n", False),
        ("def walk_ledger(rows):\n    # Drops rows that expired before the cutoff.\n    return 1\n", False),
        ('def walk_ledger(rows):\n    """Walk ledger."""\n', False),
        ('def walk_ledger(rows):\n    """This function will walk the ledger rows."""\n', False),
        ('def walk_ledger(rows):\n    """TODO: document"""\n', False),
        ('def walk_ledger(rows):\n    """\n    :param rows:\n    :return:\n    """\n', False),
        ('def walk_ledger(rows):\n    """"""\n', False),
        ("# noqa\ndef walk_ledger(rows):\n    return 1\n", False),
        ("# rows = load(rows)\ndef walk_ledger(rows):\n    return 1\n", False),
        ("# -----------\ndef walk_ledger(rows):\n    return 1\n", False),
        ('def walk_ledger(rows):\n    x = """Drops rows that expired before the cutoff."""\n', False),
        ("async def walk_ledger(a: dict[str, int] = {'x': 1}, *b) -> list[int]:\n    r'''Schreibt veraltete Einträge, ohne die Platte zu berühren.'''\n", True),
        ('def walk_ledger(rows):\n    """统计所有过期的行并写入日志"""\n', True),
        ("    @x\n    def walk_ledger(self):\n        'Idempotent; safe to call twice.'\n", True),
    ],
)
def test_python(body, want):
    assert informative(PY + body) is want


@pytest.mark.parametrize(
    "body,want",
    [
        ("/// @brief Drops rows that expired.\n/// @return stale count\nint walk_ledger(int limit) {\n", True),
        ("/**\n * @param limit\n * @return\n */\nint walk_ledger(int limit) {\n", False),
        ("// rows.clear();\nint walk_ledger(std::vector<int>& rows) {\n", False),
        ("// NOLINTNEXTLINE(x)\nint walk_ledger(int limit) {\n", False),
        ("/* Blocks until the peer answers. */\nint walk_ledger(int limit) {\n", True),
        ("int walk_ledger(int limit) {\n    // Blocks until the peer answers.\n", False),
    ],
)
def test_cpp(body, want):
    assert informative("// File: a.h\n\n" + body, language="cpp") is want


def test_offsets():
    content = PY + "# Says what it does.\ndef f(x):\n    return 1\n"
    p = extract(content, "python")
    assert content[p.doc_start : p.doc_end] == "# Says what it does.\n" and content[p.def_start :].startswith("def f(x)")


def test_packrat_is_linear():
    g = Grammar("A <- B 'x' / B 'y'\nB <- '(' A ')' / ''")
    assert g.parse("(" * 60 + "y" + ")y" * 60) is not None
    assert g.parse("(" * 5000 + "y" + ")y" * 5000).end == 15001


def test_frame(spark):
    good = PY + 'def f(x):\n    """Drops rows that expired."""\n'
    rows = [("a", "function", "f", "python", good), ("a", "function", "f", "python", good), ("b", "method", None, None, good), ("c", "class", "f", "python", good), (None, "function", "f", "python", good), ("d", "function", "f", "python", None), ("e", "function", "f", "python", ""), ("f", "function", "f", "python", "not code" * 1000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, chunk_type string, symbol_name string, language string, content string, doc_start int")
    got = documented_functions(df).collect()
    assert sorted(r.chunk_id for r in got) == ["a", "b"] and got[0].description == "Drops rows that expired."
    assert documented_functions(df.limit(0)).count() == 0


def test_deeply_nested_signature():
    deep = "(" * 3000 + "1" + ")" * 3000
    pair = extract(f'# File: a.py\n\ndef f(x={deep}):\n    """Merges the remaining intervals of two ledgers."""\n    return x\n', "python")
    assert pair is not None and pair.doc.startswith("Merges")
