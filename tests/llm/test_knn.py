import numpy as np
import pytest

from chunkloom.llm import knn


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], 1) for i, v in zip(ids, x, strict=True)], "id string, v array<float>, pid int")


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 24))).astype("f4")
    ids = np.array([f"c{i:05d}" for i in range(1500)])
    g = knn.build_graph(frame(spark, ids, x), "id", "v", 24, 5)
    got: dict = {}
    for r in knn.neighbours(g, 5).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = exact(ids, x, 5)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in ids]) > 0.97


def test_copies_ties_and_unusable(spark):
    ids = [f"a{i}" for i in range(30)] + ["z1", "z2", "n1", "n2", "n3", "n4", "n5", None]
    x = [[1.0, 0.0]] * 30 + [[0.9, 0.1], [0.0, 1.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [1.0], [1.0, 1.0]]
    df = frame(spark, ids, x)
    g = knn.build_graph(df.union(df), "id", "v", 2, 3)
    near: dict = {}
    for r in knn.neighbours(g, 3).orderBy("id", "rank").collect():
        near.setdefault(r.id, []).append(r.neighbour)
    assert len(near) == 32
    assert near["a0"] == ["a1", "a10", "a11"] and near["a5"] == ["a0", "a1", "a10"] and near["z1"] == ["a0", "a1", "a10"] and near["z2"][0] == "z1"


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    df = frame(spark, [f"c{i}" for i in range(n)], [[1.0, float(i)] for i in range(n)])
    assert knn.similar_pairs(df, "id", "v", 2, 10).count() == n // 2


def test_tree_parts_all_points(monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 32)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((512, 8)).astype("f4")
    sizes = np.bincount(knn.leaves(knn.fit_tree(x, 512, 1), x))
    assert sizes.sum() == 512 and sizes.max() <= 32
    large = knn.fit_tree(x, 1 << 20, 1)
    assert len(large.extra) == 9 and knn.leaves(knn.fit_tree(x[:1], 1, 1), x).max() == 0


def test_greedy_search_recall(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 800)] + 0.5 * rng.standard_normal((800, 16))).astype("f4")
    ids = np.array([f"c{i:05d}" for i in range(800)])
    df = frame(spark, ids, x)
    g = knn.build_graph(df, "id", "v", 16, 8)
    q = df.where("substr(id, 5, 2) = '00'").union(frame(spark, ["q1", "q2", None], [None, [0.0] * 16, [1.0] * 16]))
    got: dict = {}
    for r in knn.greedy_search(g, q, "id", "v", 16, 8).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i: set(ids[np.argsort(-(unit @ unit[n]))[:8]]) for n, i in enumerate(ids) if i in got}
    assert len(got) == 8 and np.mean([len(got[i] & want[i]) / 8 for i in got]) > 0.9


def test_recall_where_neighbours_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 2500)] + 1.2 * rng.standard_normal((2500, 24))).astype("f4")
    ids = np.array([f"c{i:05d}" for i in range(2500)])
    got: dict = {}
    for r in knn.neighbours(knn.build_graph(frame(spark, ids, x), "id", "v", 24, 10), 10).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = exact(ids, x, 10)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in ids]) > 0.98


def test_near_copies_rank_by_their_own_numbers(spark):
    """Similarities that differ by less than 16-bit vectors can show."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(96)
    base /= np.linalg.norm(base)
    away = rng.standard_normal(96)
    away -= base * (away @ base)
    away /= np.linalg.norm(away)
    steps = [0.0, *(0.002 + 0.0002 * k for k in range(40))]
    x = np.array([base + t * away for t in steps])
    ids = [f"m{(17 * k) % 41:02d}" for k in range(41)]
    got = [r.neighbour for r in knn.neighbours(knn.build_graph(frame(spark, ids, x), "id", "v", 96, 5), 5).where(f"id = '{ids[0]}'").orderBy("rank").collect()]
    assert got == ids[1:6]


def test_search_recall_on_the_embeddings(spark):
    """Every vector whose id is divisible by 100 against brute force."""
    from chunkloom.llm import queries

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], "f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    got: dict = {}
    for r in queries.p1_search(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    at = {i: n for n, i in enumerate(ids)}
    hits = [len(got[q] & set(ids[np.argsort(-(x @ x[at[q]]))[:10]])) / 10 for q in got]
    assert len(got) == sum(ids % 100 == 0) and np.mean(hits) >= 0.95


def test_a_query_in_an_empty_block_starts_in_its_leaf(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    monkeypatch.setattr(knn, "SAMPLE", 16)
    monkeypatch.setattr(knn, "LEAST_RECALL", 0.5)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 4)).astype("f4")
    ids = [f"c{i:03d}" for i in range(200)]
    g = knn.build_graph(frame(spark, ids, x), "id", "v", 4, 5)
    far = rng.standard_normal((40, 4))
    found = knn.greedy_search(g, frame(spark, [f"q{i}" for i in range(40)], far), "id", "v", 4, 5).select("query_id").distinct().count()
    assert found == 40


def test_a_vector_that_a_third_of_the_rows_carry(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 8)).astype("f4")
    x[::3] = x[0]
    ids = [f"c{i:04d}" for i in range(900)]
    near: dict = {}
    for r in knn.neighbours(knn.build_graph(frame(spark, ids, x).repartition(6), "id", "v", 8, 5), 5).collect():
        near.setdefault(r.id, []).append(r.neighbour)
    assert len(near) == 900 and set(near["c0006"]) == {"c0000", "c0003", "c0009", "c0012", "c0015"}


def test_a_poor_graph_raises(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    monkeypatch.setattr(knn, "LEAST_RECALL", 1.01)
    with pytest.raises(RuntimeError, match="recall"):
        knn.build_graph(frame(spark, [f"c{i}" for i in range(60)], np.random.default_rng(1).standard_normal((60, 4))), "id", "v", 4, 3)
