import pytest
from pyspark.sql import functions as F

from chunkloom.api import Engine
from chunkloom.config import EngineConfig
from chunkloom.embed import embed_batch, hashing_embedder
from chunkloom.sources.tree import read_text_file, scan_directories
from chunkloom.store import ChunkStore
from chunkloom.streaming.incremental import index_stream


def tree(root):
    for name in ("pkg/__init__.py", "pkg/mod.PY", "setup.py", "docs/Conf.py", "tests/a.py", "Build/a.cpp", "pkg/tests/a.py", "build/a.py", "pkg/.venv/a.py", "Node_Modules/a.py", "pkg/generated/a.py", "notes.txt", "a/b/c/d/deep.md"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("def f(a):\n    x = g(a)\n    y = 1\n    return x\n")


def test_scan(spark, tmp_path):
    tree(tmp_path)
    got = {r.relative_path for r in scan_directories(spark, [str(tmp_path)]).collect()}
    assert got == {"pkg/__init__.py", "pkg/mod.PY", "pkg/tests/a.py", "build/a.py", "pkg/generated/a.py", "a/b/c/d/deep.md"}
    assert {r.relative_path for r in scan_directories(spark, [str(tmp_path)], recursive=False, only_selected=False).collect()} == {"setup.py", "notes.txt"}
    with pytest.raises(ValueError, match="/nowhere"):
        scan_directories(spark, [str(tmp_path), "/nowhere"])
    assert read_text_file(spark, str(tmp_path / "none.log")).count() == 0


def test_index_query_cycle(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text('import os\n\ndef alpha(x):\n    """Doubles the ledger."""\n    y = beta(x)\n    return y\n')
    (src / "b.py").write_text("def beta(x):\n    z = x\n    z += 1\n    return z\n")
    (src / "bad.py").write_text("x = 1\ny = 2\ndef f(:\n")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.call_tool("query", {"question": "x"}) == "the index is empty"
    r = e.index_directory(str(src))
    assert (r.files_found, r.files_indexed, r.chunks_embedded, len(r.failed_files)) == (3, 2, 2, 1)
    assert e.index_directory(str(src)).chunks_embedded == 0
    (src / "b.py").write_text("def beta(x):\n    z = x\n    z += 2\n    return z\n")
    assert e.index_directory(str(src)).chunks_embedded == 1
    assert e.stats()["total_chunks"] == 2
    prompt, n = e.build_prompt("def alpha ledger", top_k=1)
    assert n == 2 and "beta" in prompt
    assert [r.symbol_name for r in e.get_chunks_by_symbol("beta").collect()] == ["beta"]
    assert "Fichier a.py" in e.build_file_prompt("a.py", "text", "explain")
    e.delete_file(str(src / "a.py"))
    assert e.stats()["total_chunks"] == 1
    assert e.store.vacuum() > 0
    e.clear()
    assert e.stats()["total_chunks"] == 0
    with pytest.raises(ValueError):
        e.call_tool("other", {})


def test_failed_file_keeps_its_old_rows(spark, tmp_path):
    (tmp_path / "e.py").write_text("def small(x):\n    a = 1\n    b = 2\n    return a\n")
    e = Engine(spark, str(tmp_path / "store"), config=EngineConfig(max_embed_chars=120, embed_retries=1))
    e.index_directory(str(tmp_path))
    before = e.store.chunks().select("file_hash").distinct().collect()
    (tmp_path / "e.py").write_text("def small(x):\n    a = '" + "x" * 300 + "'\n    b = 2\n    return a\n")
    assert e.index_directory(str(tmp_path)).chunks_embedded == 0
    assert e.store.chunks().select("file_hash").distinct().collect() == before


def test_embed_retries():
    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert embed_batch(["a"], flaky, 10, 3, waits.append) == [[1.0]] and waits == [1.0, 2.0]
    assert embed_batch(["a" * 11], flaky, 10, 3, waits.append) is None
    assert embed_batch(["a"], lambda t: [], 10, 2, waits.append) is None


def test_stream(spark, tmp_path):
    rows = [("/r/a.py", "a.py", ".py", bytearray(b"def f(a):\n    x = g(a)\n    y = 1\n    return x\n"), "h1")]
    src = tmp_path / "in"
    from chunkloom.schema import FILES

    spark.createDataFrame(rows, FILES).write.parquet(str(src))
    store = ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        index_stream(spark, str(src), store, hashing_embedder(8), str(tmp_path / "cp")).awaitTermination()
    assert store.chunks().count() == 1 and store.file_hashes().count() == 1
    assert store.chunks().where(F.size("embeddings") == 8).count() == 1


def test_an_oversize_chunk_fails_its_own_file_only(spark):
    from chunkloom.embed import embed_chunks

    rows = [(f"{f}{n}", f, "x" * (300 if (f, n) == ("b", 2) else 10)) for f in "abc" for n in range(5)]
    df = spark.createDataFrame(rows, "chunk_id string, file_path string, content string")
    for parts in (1, 7):
        done = embed_chunks(df.repartition(parts), hashing_embedder(4), max_chars=100, batch=2, retries=1).collect()
        assert sorted(r.chunk_id for r in done if r.embeddings is None) == ["b2", "b3", "b4"]
        assert len(done) == 15


def test_an_upsert_writes_what_changed(spark, tmp_path):
    def size():
        return sum(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet"))

    (tmp_path / "src").mkdir()
    for n in range(40):
        (tmp_path / "src" / f"f{n}.py").write_text("def f(a):\n" + "".join(f"    x{k} = '{n * k * 7919}'\n" for k in range(60)) + "    return a\n")
    e = Engine(spark, f"file://{tmp_path}/store", embedder=hashing_embedder(256))
    e.index_directory(str(tmp_path / "src"))
    first = size()
    (tmp_path / "src" / "f1.py").write_text("def f(a):\n    x = 1\n    y = 2\n    return a\n")
    assert e.index_directory(str(tmp_path / "src")).chunks_embedded == 1
    assert size() - first < 0.6 * first
    assert e.store.chunks().count() == 40 and e.store.file_hashes().count() == 40
    e.delete_file(str(tmp_path / "src" / "f2.py"))
    assert e.store.chunks().count() == 39
    e.store.vacuum()
    assert e.store.chunks().count() == 39 and e.store.file_hashes().count() == 39


def test_clear_on_other_directory(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "m.py").write_text("def f(a):\n    x = 1\n    y = 2\n    return a\n")
    e = Engine(spark, str(tmp_path / "store"), config=EngineConfig(clear_on_other_directory=True))
    e.index_directory(str(tmp_path / "a"))
    e.index_directory(str(tmp_path / "b"))
    assert e.stats()["total_chunks"] == 1


def test_flat_folder_is_split(tmp_path):
    from chunkloom.sources import tree as source

    for n in range(2500):
        (tmp_path / f"f{n}.py").touch()
    parts = source._TreeReader({"roots": str(tmp_path)}).partitions()
    assert [len(p.names) for p in parts] == [1000, 1000, 500]
