import random

from chunkloom.llm.handwritten import composition, inspected, not_handwritten, vendored


def functions(seed, n=6, name="own"):
    r = random.Random(seed)
    return "\n\n".join(f"def {r.choice(['load', 'trim', 'rank'])}_{name}_{k}(rows, limit={r.randint(0, 999)}):\n    total_{r.randint(0, 999)} = sum(rows[{r.randint(0, 9999)}:])\n    return limit * {r.randint(0, 9999)}" for k in range(n)) + "\n"


def test_rules():
    own = functions(1)
    assert composition(own) is None
    for banner in ("# Code generated by toolgen. DO NOT EDIT.", "# @generated", "# AUTO-GENERATED FILE - regenerate with make x", "# Fichier produit automatiquement par x, ne pas modifier.", "import os\n# This file was automatically created from a.schema; changes will be lost."):
        assert composition(banner + "\n" + own) == "generated"
    for talk in ("# Not generated: edit freely.", "# Scaffold was generated once, since then maintained by hand.", "# Writes the files that carry the DO NOT EDIT banner.", "BANNER = '# Code generated by tool. DO NOT EDIT.'"):
        assert composition(talk + "\n" + own) is None
    for head in ("# Part of the foo library, release 1.2.3", "# Copyright (c) 2024 The Acme Authors", "# This check is part of the Foo library", "# Please do not modify the order of the imports below."):
        assert composition(head + "\n" + own) is None, head
    assert composition("x=" + ";".join(f"a{i}=lambda b,c:b*{i}+c if b>{i} else c-{i}" for i in range(20))) == "minified"
    assert composition("T = [\n" + "\n".join("    " + ", ".join(str(random.Random(i * 9 + j).randint(0, 99999)) for j in range(12)) + "," for i in range(30)) + "\n]\n") == "data"
    assert composition("T = {'a': 1, 'b': 2}\n" + own) is None
    assert composition("def f(x):\n" + "".join(f"    elif x == {i}:\n        return {i * 3}\n" for i in range(40))) == "generated"
    assert composition("<!doctype html>\n<p>Code generated by x. DO NOT EDIT.") is None and composition("") is None


def test_vendored_copies(spark):
    lib = functions(2, 12, "lib")
    rows = [(f"/r{k}/lib/x.py", lib.replace("limit *", "limit +", k), f"r{k}") for k in range(6)]
    rows += [(f"/r{k}/own{j}.py", functions(100 * k + j), f"r{k}") for k in range(6) for j in range(5)]
    rows += [("/r0/lib/x.py", lib, "r0"), ("/r1/twin.py", functions(77), "r1"), ("/r1/twin2.py", functions(77), "r1"), ("/r9/e.py", "", "r9"), ("/r9/n.py", None, None), (None, lib, "r9"), ("/r9/x.md", lib, "r9")]
    df = spark.createDataFrame([(p, None if t is None else bytearray(t.encode()), d, "x") for p, t, d in rows], "path string, content binary, directory string, reason string")
    got = {r.file_path: r.reason for r in not_handwritten(df).collect()}
    assert got == {f"/r{k}/lib/x.py": "vendored" for k in range(6)}
    assert not_handwritten(df.limit(0)).count() == 0


def test_amalgamations_whose_lines_have_earlier_owners(spark):
    """Ten split headers in two repositories first in path order; the joined file in others, each with its own head."""
    parts = [functions(500 + k, 4, f"part{k}") for k in range(10)]
    rows = [(f"/a{r}/h{k}.py", parts[k], f"a{r}") for r in range(2) for k in range(10)]
    rows += [(f"/z{r}/all.py", "".join(parts) + functions(900 + r, 2, f"edit{r}"), f"z{r}") for r in range(3)]
    rows += [(f"/y{r}/same.py", "".join(parts[:7]) + functions(950, 1, "same"), f"y{r}") for r in range(2)]
    rows += [(f"/z{r}/own{j}.py", functions(3000 + 100 * r + j), f"z{r}") for r in range(3) for j in range(5)]
    df = spark.createDataFrame([(p, bytearray(t.encode()), d) for p, t, d in rows], "path string, content binary, directory string")
    got = {r.path for r in vendored(inspected(df)).collect()}
    assert got == {p for p, _, _ in rows if "/own" not in p}


def test_banners_in_blocks_and_with_harmless_words():
    own = functions(1)
    for banner in ("// DO NOT EDIT BY HAND", "# Generated by protoc; changes are lost when regenerated", "# Do not modify; changes will be overwritten if the file is regenerated", "/*\n Generated by X. Do not edit.\n*/", '"""Tables.\n\nGenerated by mk.py from x.csv.\n"""', "/* This file is\n   generated by a tool that checks names */", "# Code generated by once-gen. DO NOT EDIT."):
        assert composition(banner + "\n" + own) == "generated", banner
    for talk in ("# Looks for files that are marked @generated.", "# This file is not generated by protoc.", "# No longer generated from a.idl, maintained by hand.", "/*\n Checks whether a file is auto-generated.\n*/", '"""Writes files that carry the DO NOT EDIT banner."""', "# Do not edit this table unless you know the format.", "# Generated by x.py in 2019, since then maintained by hand.", "/* Own work. */ int x; /*\n Generated by X.\n*/", "def f():\n    'Generated by X. DO NOT EDIT.'"):
        assert composition(talk + "\n" + own) is None, talk


def test_another_partys_name_needs_a_copy(spark):
    """Half-changed copies count if their head names another party; a project's own header alone does not."""
    lib, head = functions(700, 10, "lib"), "# Copyright (c) 2024 The Acme Authors\n"
    half = lib[: len(lib) // 2] + functions(701, 5, "new")
    rows = [("/a/lib.py", lib, "a"), ("/b/marked.py", head + half, "b"), ("/c/plain.py", half.replace("_new", "_own") + functions(702, 2, "more"), "c")]
    rows += [(f"/d/own{j}.py", head + functions(800 + j), "d") for j in range(8)]
    df = spark.createDataFrame([(p, bytearray(t.encode()), d) for p, t, d in rows], "path string, content binary, directory string")
    got = {r.file_path for r in not_handwritten(df).collect()}
    assert "/b/marked.py" in got and not any(p.startswith("/d/") for p in got)
