import datetime as dt

from pyspark.sql import functions as F

from chunkloom.operators import context, expand, orphans, search, upsert

T0 = dt.datetime(2024, 1, 31)
DAY = dt.timedelta(days=1)
CHUNK = "chunk_id string, file_path string, symbol_name string, symbols_referenced array<string>, indexed_at timestamp, language int"
EXT = "symbol_name string, language string"


def found(spark, chunks, deleted=(), external=()):
    c = spark.createDataFrame([(*r, 1) for r in chunks], CHUNK)
    d = spark.createDataFrame(list(deleted), "file_path string, deleted_at timestamp")
    e = spark.createDataFrame([(x, None) for x in external], EXT)
    return orphans.orphan_references(c, d, e)


def test_orphan_reasons(spark):
    chunks = [
        ("a", "/a", "fa", [" missing ", "fb", "late", None, "", "ext", "gone", "missing"], T0),
        ("a", "/a", "fa", [" missing ", "fb", "late", None, "", "ext", "gone", "missing"], T0 + DAY),
        ("b", "/b", "fb", None, T0),
        ("c", "/c", "late", [], T0 + 2 * DAY),
        ("d", "/d", "gone", ["missing"], T0),
        (None, "/x", "missing", ["q"], T0),
        ("n", None, None, ["fa"], None),
    ]
    got = found(spark, chunks, [("/d", T0), ("/d", T0 - DAY), (None, T0), ("/b", T0 - DAY)], ["ext", None])
    assert sorted((r.chunk_id, r.symbol, r.reason) for r in got.collect()) == [("a", "gone", "deleted"), ("a", "late", "late"), ("a", "missing", "missing")]
    months = orphans.orphans_by_period(got, "t").collect()
    assert {(r.month, r.reason, r.n_refs) for r in months} == {("2024-01", "missing", 1), ("2024-01", "late", 1), ("2024-01", "deleted", 1)}


def test_orphans_of_empty_tables(spark):
    assert found(spark, []).count() == 0


def test_hot_key_is_whole(spark):
    rows = [(f"c{i}", "/f", "self", ["hot"], T0) for i in range(3000)]
    assert found(spark, rows).count() == 3000


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, 0, 0.1, 8000), (1, 1, 0.2, 5000), (1, 2, 0.3, 3000), (1, 3, 0.5, 100), (2, 0, None, 10)], "question_id int, pos int, distance double, n int")
    blocks = hits.withColumn("header", F.lit("h" * 60)).withColumn("block", F.expr("repeat('x', n)"))
    got = [(r.question_id, r.pos, r.truncated, len(r.text)) for r in context.within_budget(blocks, 14000, "question_id").orderBy("question_id", "rank").collect()]
    assert got == [(1, 0, False, 8000), (1, 1, False, 5000), (1, 2, True, 1000 + len("\n[... tronqué ...]")), (2, 0, False, 10)]


def test_context_stops_at_first_overflow(spark):
    hits = spark.createDataFrame([(1, 0, 0.1, 90), (1, 1, 0.2, 50), (1, 2, 0.3, 5)], "question_id int, pos int, distance double, n int")
    blocks = hits.withColumn("header", F.lit("hh")).withColumn("block", F.expr("repeat('x', n)"))
    assert [r.pos for r in context.within_budget(blocks, 100, "question_id").collect()] == [0]


def store(spark):
    rows = [(f"g{i}", f"/g{i}", 1, "g", ["k"] if i == 1 else []) for i in range(1, 5)] + [("h1", "/h", 1, "h", []), ("k1", "/k", 1, "k", []), ("p", "/p", 1, "P", ["g", "h", ""])]
    return spark.createDataFrame(rows, "chunk_id string, file_path string, start_line int, symbol_name string, symbols_referenced array<string>")


def test_expansion_depths(spark):
    chunks = store(spark)
    seeds = chunks.where("chunk_id = 'p'").withColumn("distance", F.lit(0.1)).withColumn("pos", F.lit(0))
    ids = lambda d: [r.chunk_id for r in expand.expand_dependencies(chunks, seeds, d).orderBy("depth", "pos").collect()]
    assert ids(0) == ["p"]
    assert ids(1) == ["p", "g1", "g2", "g3", "h1"]
    assert ids(2) == ["p", "g1", "g2", "g3", "h1", "k1"]
    assert ids(5) == ids(2)


def test_expansion_limit_comes_before_duplicates(spark):
    chunks = store(spark).withColumn("file_path", F.when(F.col("chunk_id") == "p", F.lit("/g1")).otherwise(F.col("file_path")))
    seeds = chunks.where("chunk_id = 'p'").withColumn("distance", F.lit(0.1)).withColumn("pos", F.lit(0))
    got = [r.chunk_id for r in expand.expand_dependencies(chunks, seeds, 1).orderBy("depth", "pos").collect()]
    assert got == ["p", "g2", "g3", "h1"]


def test_upsert_plan(spark):
    files = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("c", "h3"), (None, "h")], "path string, file_hash string")
    stored = spark.createDataFrame([("x", "a", "h1"), ("x", "b", "h1"), ("x", "d", "h4")], "file_id string, file_path string, file_hash string")
    assert {(r.file_path, r.action) for r in upsert.upsert_plan(files, stored).collect()} == {("a", "cached"), ("b", "modified"), ("c", "new")}


def test_topk_edges(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0])], "id int, v array<float>")
    assert [r.id for r in search.topk(v, [1.0, 0.0], 3, "id", "v").collect()] == [1, 3, 2]
    assert search.topk(v, [], 3, "id", "v").count() == 0
    got = search.topk_batch(v, v.where("id in (1, 2, 4, 5)"), 2, "id", "v").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (1, 3), (2, 2), (2, 1)]
    assert search.topk_batch(v, v.where("id > 90"), 2, "id", "v").count() == 0


def test_topk_does_not_depend_on_partitions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    one = sorted(map(tuple, search.topk_batch(e.coalesce(1), q, 5, "vec_id", "embedding").collect()))
    assert one == sorted(map(tuple, search.topk_batch(e.repartition(7), q, 5, "vec_id", "embedding", block_rows=2).collect()))


def test_history_window(spark):
    t = spark.createDataFrame([(1, i, f"q{i}", f"a{i}") for i in range(8)], "c int, t int, q string, a string")
    last = context.history_window(t, "c", "t", "q", "a").orderBy("t").collect()[-1].history
    assert last.count("Q: ") == 5 and last.startswith("Q: q2\nR: a2\n\n")


def test_markdown_sections_of_any_type_and_line_end(spark, sf, tmp_path):
    from chunkloom.plans.core_queries import QUERIES

    text = "# One\n" + "a" * 120 + "\n\n## Two\n" + "b" * 130 + "\n"
    rows = [(k, kind, "T", text.replace("\n", end)) for k, (kind, end) in enumerate([("guide", "\n"), ("guide", "\r\n"), ("note", "\r"), (None, "\n")])]
    spark.createDataFrame(rows, "doc_id long, doc_type string, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in QUERIES["md_sections"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.section, r.n_chars))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(1, "One", 120), (2, "Two", 130)] for k in range(4)}


def sizes(df):
    return sorted(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())


def test_hot_key_is_split_by_its_count(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("key"), "id")
    small = big.select("key").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = orphans.salted_join(big, small, "key", "id", pieces=64, least=100)
        assert joined.count() == 60_000 and joined.select("id").distinct().count() == 60_000
        got = sizes(joined)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[-1] <= 2 * 60_000 / 4


def test_salted_left_join_keeps_null_keys(spark):
    big = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "key string, id int")
    small = spark.createDataFrame([("a", 9)], "key string, v int")
    assert sorted((r.id, r.v) for r in orphans.salted_join(big, small, "key", "id", "left").collect()) == [(1, 9), (2, None), (3, None)]


def test_long_conversation_is_split(spark):
    turns = spark.range(500).select(F.when(F.col("id") < 450, 1).otherwise(2).alias("c"), "id", F.col("id").cast("string").alias("q"), F.lit(None).cast("string").alias("a"))
    got = {r.id: r.history for r in context.history_window(turns, "c", "id", "q", "a", span=50).collect()}
    assert len(got) == 500
    for n, text in got.items():
        first = 0 if n < 450 else 450
        assert text == "".join(f"Q: {k}\nR: \n\n" for k in range(max(first, n - 5), n))


def test_budget_drops_rows_that_cannot_matter(spark):
    hits = spark.range(5000).select((F.col("id") % 1 + 1).alias("g"), F.col("id").alias("pos"), (F.col("id") / 5000).alias("distance"), F.lit("h" * 25).alias("header"), F.repeat(F.lit("x"), F.lit(30)).alias("block"))
    got = context.within_budget(hits, 1000, "g")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.pos for r in got.orderBy("rank").collect()] == list(range(33))
