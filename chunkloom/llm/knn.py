"""Most similar vectors for every vector, by NN-descent over blocks, and greedy graph search for queries.

Equal vectors are one class; the graph is built over classes.  Two trees of two-means splits, fitted on a
bounded sample, put every vector into one block each.  Brute force inside the blocks of the first tree and
then of the second gives the first neighbour lists.  NN-descent rounds join neighbours with their
neighbours: a block asks once for each neighbour of a neighbour of its members (and for their reverse
neighbours), so a vector travels once to every block that needs it instead of once for every pair.  As in
the method's own form a link is followed once, when it is new.  There is always one round, and rounds go on
until one changes less than ``CHANGED`` of all links; a probe by brute force then measures the recall.

A class is numbered ``block of the first tree << RANK_BITS | place in it``, so its home block can be read off
a link.  Vectors travel as 24-bit fixed point numbers, which is the precision of the floats they stand for.

Sizes: a task holds one block (about ``BLOCK`` vectors) and its asked-for vectors, compared in slices; the
driver holds the sample and the trees only.  Copies of a vector are dropped in every task that reads them, so
that a block receives at most one copy a task of it, however many rows carry it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from chunkloom.session import cut_bucketed, cut_lineage, release

#: Vectors of a block.
BLOCK = 2048
#: Classes of a bucket of the graph's tables.
BUCKET = 65_536
#: Vectors of the sample that the trees are fitted on; the index holds all rows.
SAMPLE = 16_384
#: Points of the sample that a leaf has at least, and points that one split looks at.
LEAF_SAMPLE = 8
SPLIT_SAMPLE = 2048
#: Starts of a two-means split, and its iterations.
TRIES = 3
ITERATIONS = 4
#: Neighbours kept in the graph beyond the k asked for.
SPARE = 2
#: Best links to a vector of which its block asks for the other end, beside all links from it.
REVERSE = 10
#: Share of the links that a round changes below which the graph is done.
CHANGED = 0.01
#: Recall that a graph must have by brute force on ``PROBES`` vectors; a graph under it raises.
LEAST_RECALL = 0.9
PROBES = 256
#: A class with more than one of so many members is joined by broadcast: there are at most so many of them.
HOT_SHARE = 4096
#: Rows and columns of one slice of a block's comparisons.
SLICE = 2048
#: Low bits of a class number, its place in its block; and bits of a block number below that of its leaf.
RANK_BITS = 20
PLANE_BITS = 24


class Tree(NamedTuple):
    """Split planes: node ``i`` sends vectors to ``children[i, 0]`` or ``children[i, 1]``, a leaf has -1 there.

    A leaf that stands for more than a block is cut by the first ``bits[i]`` of the random planes ``extra``
    through the middle of its points, ``middle[i]`` on each plane.
    """

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    extra: np.ndarray
    bits: np.ndarray
    middle: np.ndarray


def _two_means(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """``(direction, offset)`` between the means of two groups of points, the best of ``TRIES`` starts."""
    best, found = 0.0, None
    for _ in range(TRIES):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(ITERATIONS):
            right = x @ (b - a) > (b @ b - a @ a) / 2
            if right.all() or not right.any():
                break
            a, b = x[~right].mean(0), x[right].mean(0)
        d, offset = b - a, float(b @ b - a @ a) / 2
        share = float((x @ d > offset).mean())
        gain = share * (1 - share) * float(d @ d)
        if gain > best:
            best, found = gain, (d, offset)
    return found


def fit_tree(sample: np.ndarray, n: int, seed: int) -> Tree:
    """A tree over ``n`` vectors from a sample: nodes are split while they stand for more than ``BLOCK``."""
    rng = np.random.default_rng(seed)
    most = max(LEAF_SAMPLE, int(BLOCK * len(sample) / max(1, n)))
    dim = sample.shape[1]
    planes, offsets, children, bits, centres = [], [], [], [], []
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        mine, parent, side = todo.pop()
        me = len(children)
        children.append([-1, -1])
        planes.append(np.zeros(dim, "f4"))
        offsets.append(0.0)
        stands_for = len(mine) * n / max(1, len(sample))
        bits.append(int(np.clip(np.ceil(np.log2(max(1.0, stands_for / BLOCK))), 0, PLANE_BITS)))
        centres.append(sample[mine].mean(0) if len(mine) else np.zeros(dim, "f4"))
        if parent >= 0:
            children[parent][side] = me
        if len(mine) <= most:
            continue
        few = mine if len(mine) <= SPLIT_SAMPLE else rng.choice(mine, SPLIT_SAMPLE, replace=False)
        if (cut := _two_means(sample[few], rng)) is not None:
            planes[me], offsets[me] = cut
            right = sample[mine] @ planes[me] > offsets[me]
            if right.any() and not right.all():
                todo += [(mine[right], me, 1), (mine[~right], me, 0)]
    children = np.array(children)
    bits = np.where(children[:, 0] < 0, bits, 0)
    extra = rng.standard_normal((int(bits.max()), dim)).astype("f4")
    return Tree(np.array(planes, "f4"), np.array(offsets, "f4"), children, extra, bits, np.array(centres, "f4") @ extra.T)


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The block of each vector: number of its leaf ``<< PLANE_BITS``, and sides of the leaf's own planes."""
    node = np.zeros(len(x), "i8")
    open_ = np.arange(len(x)) if tree.children[0, 0] >= 0 else np.zeros(0, "i8")
    while len(open_):
        at = node[open_]
        side = (x[open_] * tree.planes[at]).sum(1) > tree.offsets[at]
        node[open_] = tree.children[at, side.astype("i8")]
        open_ = open_[tree.children[node[open_], 0] >= 0]
    low = np.zeros(len(x), "i8")
    for k, w in enumerate(tree.extra):
        low |= ((x @ w > tree.middle[node, k]) & (k < tree.bits[node])).astype("i8") << k
    return (node << PLANE_BITS) | low


def pack(x: np.ndarray) -> pa.Array:
    """Unit vectors as 24-bit fixed point numbers, high bytes first."""
    q = np.clip(np.rint(x.astype("f8") * (1 << 23)), 1 - (1 << 23), (1 << 23) - 1).astype("i4")
    planes = np.stack([(q >> 16).astype("u1"), (q >> 8).astype("u1"), q.astype("u1")], axis=1)
    return pa.array([v.tobytes() for v in planes], pa.binary())


def unpack(column) -> np.ndarray:
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    if not values:
        return np.zeros((0, 1), "f4")
    planes = np.frombuffer(b"".join(values), "u1").reshape(len(values), 3, -1)
    q = (planes[:, 0].view("i1").astype("i4") << 16) | (planes[:, 1].astype("i4") << 8) | planes[:, 2]
    return q.astype("f4") / np.float32(1 << 23)


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, key, vec``: packed unit vectors and a 128-bit key of their content.

    Rows with a null id or with a vector that is null, of another size, not finite or all zero are left out.
    """
    id_type = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.BinaryType()), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit, keys = _unit(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(keys, pa.binary()), pack(unit)], names=["id", "key", "vec"])

    return _fit_rows(rows, id_col, vec_col, dim).mapInArrow(run, schema)


def _fit_rows(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))


def _unit(lists, dim: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Which vectors are usable, these as unit vectors, and keys of their content."""
    x = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    unit = (x[good] / norm[good, None]).astype("f4")
    return good, unit, [xxhash.xxh3_128_digest(v.tobytes()) for v in unit]


def _top(own: np.ndarray, own_ids: np.ndarray, all_: np.ndarray, all_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each own vector its ``k`` most similar others: ids (-1 where fewer) and similarities; ties by id."""
    order = np.argsort(all_ids, kind="stable")
    all_, all_ids = all_[order], all_ids[order]
    parts = [_top_rows(own[at : at + SLICE], own_ids[at : at + SLICE], all_, all_ids, k) for at in range(0, max(1, len(own)), SLICE)]
    return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])


def _top_rows(own: np.ndarray, own_ids: np.ndarray, all_: np.ndarray, all_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best_s = np.full((len(own), 0), -2.0, "f4")
    best_i = np.full((len(own), 0), -1, "i8")
    for at in range(0, len(all_ids), SLICE):
        s = own @ all_[at : at + SLICE].T
        ids = all_ids[at : at + SLICE]
        same = np.searchsorted(ids, own_ids)
        here = np.flatnonzero((same < len(ids)) & (ids[np.minimum(same, len(ids) - 1)] == own_ids))
        s[here, same[here]] = -2.0
        if s.shape[1] > k:
            pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
            s, ids = np.take_along_axis(s, pick, 1), ids[pick]
        else:
            ids = np.broadcast_to(ids, s.shape)
        best_s, best_i = np.hstack([best_s, s]), np.hstack([best_i, ids])
        best_i, best_s = _best(best_i, best_s, k)
    return np.where(best_s <= -1.5, -1, best_i), best_s


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1)


def _union(ids: np.ndarray, sims: np.ndarray, more_ids: np.ndarray, more_sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of two lists a row, none twice; -1 where fewer."""
    ids, sims = np.hstack([ids, more_ids]), np.hstack([sims, more_sims])
    order = np.lexsort((-sims, ids), axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.0
    ids, sims = _best(ids, sims, k)
    return np.where(sims <= -1.5, -1, ids), sims


#: ``fresh`` has bit ``i`` set if link ``i`` is new since the last round and is to be followed.
_GRAPH = "home bigint, pid bigint, nbrs array<bigint>, sims array<float>, fresh int, vec binary"


def _lists(pids: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, vec, **more) -> pa.Table:
    keep = ids >= 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]).astype("i4"))
    mask = ((fresh & keep) << np.arange(ids.shape[1])).sum(1).astype("i4")
    return pa.table(
        {
            "home": pa.array(pids >> RANK_BITS, pa.int64()),
            "pid": pa.array(pids, pa.int64()),
            "nbrs": pa.ListArray.from_arrays(offsets, pa.array(ids[keep], pa.int64())),
            "sims": pa.ListArray.from_arrays(offsets, pa.array(sims[keep], pa.float32())),
            "fresh": pa.array(mask, pa.int32()),
            "vec": vec,
            **more,
        }
    )


def _padded(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of a graph table as matrices, -1 and -2 where a list is shorter."""
    ids, sims = np.full((len(table), width), -1, "i8"), np.full((len(table), width), -2.0, "f4")
    nbrs, s = table.column("nbrs").combine_chunks(), table.column("sims").combine_chunks()
    size = np.diff(np.asarray(nbrs.offsets))
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    ids[row, col], sims[row, col] = np.asarray(nbrs.flatten()), np.asarray(s.flatten())
    return ids, sims


class Graph(NamedTuple):
    """``edges``: ``pid, nbrs, sims, vec`` of each class; ``members``: ``id, pid``; ``recall`` as probed."""

    edges: DataFrame
    members: DataFrame
    trees: list[Tree]
    recall: float


def home_of(pid):
    return F.shiftright(pid, RANK_BITS)


def build_graph(rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int, seed: int = 7) -> Graph | None:
    """The neighbour graph with ``k + SPARE`` neighbours a class (28 at most); None if no row has a usable vector."""
    spark = rows.sparkSession
    width = k + SPARE
    if width > 30:
        raise ValueError("at most 28 neighbours")
    vectors = usable_vectors(rows, id_col, vec_col, dim)
    keys = cut_lineage(vectors.groupBy("id").agg(F.min("key").alias("key")))
    n = int(keys.agg(F.approx_count_distinct("key", 0.02)).first()[0])
    if not n:
        return None
    sample = _first_by_hash(vectors, SAMPLE, n)
    trees = [fit_tree(sample, n, seed + t) for t in range(2)]
    first = cut_lineage(_first_lists(_placed(rows, id_col, vec_col, dim, spark.sparkContext.broadcast(trees)), width))
    members = cut_lineage(keys.join(first.select("key", "pid"), "key").select("id", "pid"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET)
    edges = cut_bucketed(_second_lists(first, width).repartition(parts, "home"), "home", parts)
    release(first, keys)
    asked = None
    while True:
        wanted = cut_bucketed(_wanted(edges, asked), "home", parts)
        better = cut_bucketed(_round(edges, wanted, width), "home", parts)
        release(edges)
        edges, asked = better, wanted if asked is None else asked.unionByName(wanted)
        new, total = edges.select(F.sum(F.bit_count(F.col("fresh").bitwiseAND((1 << k) - 1))), F.sum(F.least(F.size("nbrs"), F.lit(k)))).first()
        if (new or 0) < CHANGED * (total or 0) or not new:
            break
    probes = _exact_probes(edges, n, k)
    recall = _recall(edges, probes, k)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the neighbour graph has a recall of {recall:.3f} only")
    return Graph(edges.select("pid", "nbrs", "sims", "vec"), members, trees, recall)


def _first_by_hash(vectors: DataFrame, count: int, n: int) -> np.ndarray:
    """Vectors of the ``count`` classes first by key, in that order; only about as many leave their tasks."""
    few = vectors.select("key", "vec")
    if n > 2 * count:
        few = few.where(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("bigint") < F.lit(int((1 << 32) * 1.5 * count / n)))
    return unpack([r.vec for r in few.groupBy("key").agg(F.first("vec").alias("vec")).orderBy("key").limit(count).select("vec").collect()])


def _placed(rows: DataFrame, id_col: str, vec_col: str, dim: int, shared) -> DataFrame:
    """``home, other, key, vec``: the blocks of each vector in both trees, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            _, unit, keys = _unit(batch.column(1), dim)
            new = {key: i for i, key in enumerate(keys) if key not in seen}
            seen.update(new)
            at = sorted(new.values())
            x = unit[at]
            home, other = (pa.array(leaves(t, x), pa.int64()) for t in shared.value)
            yield pa.RecordBatch.from_arrays([home, other, pa.array([keys[i] for i in at], pa.binary()), pack(x)], names=["home", "other", "key", "vec"])

    return _fit_rows(rows, id_col, vec_col, dim).mapInArrow(run, "home bigint, other bigint, key binary, vec binary")


def _first_lists(placed: DataFrame, width: int) -> DataFrame:
    """Numbers the classes of each home block by key and lists their neighbours in it."""

    def inside(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        at = {key: i for i, key in enumerate(keys)}
        order = [at[key] for key in sorted(at)]
        table = table.take(pa.array(order, pa.int64()))
        if len(order) >= 1 << RANK_BITS:
            raise RuntimeError("a block of the first tree is too large")
        pid = (table.column("home")[0].as_py() << RANK_BITS) + np.arange(len(order), dtype="i8")
        x = unpack(table.column("vec"))
        near, sims = _top(x, pid, x, pid, width)
        return _lists(pid, near, sims, np.zeros(near.shape, bool), table.column("vec"), other=table.column("other"), key=table.column("key"))

    return placed.groupBy("home").applyInArrow(inside, _GRAPH + ", other bigint, key binary")


def _second_lists(first: DataFrame, width: int) -> DataFrame:
    """Adds the neighbours in each class's block of the second tree; links that leave the home block are fresh."""

    def inside(table: pa.Table) -> pa.Table:
        x, pid = unpack(table.column("vec")), np.asarray(table.column("pid"))
        ids, sims = _union(*_padded(table, width), *_top(x, pid, x, pid, width), width)
        return _lists(pid, ids, sims, (ids >> RANK_BITS) != (pid >> RANK_BITS)[:, None], table.column("vec"))

    return first.select("pid", "nbrs", "sims", "fresh", "vec", "other").groupBy("other").applyInArrow(inside, _GRAPH)


def _again(edges: DataFrame, *columns: str) -> DataFrame:
    """Columns of a bucketed table as attributes of their own, so that it can meet itself."""
    return edges.sparkSession.table(edges._table).select(*columns)


def _places(pid: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``sought`` stands in ``pid``, and which do."""
    order = np.argsort(pid)
    at = order[np.minimum(np.searchsorted(pid[order], sought), len(pid) - 1)] if len(pid) else np.zeros(len(sought), "i8")
    return at, (pid[at] == sought) if len(pid) else np.zeros(len(sought), bool)


def _wanted(edges: DataFrame, asked: DataFrame | None) -> DataFrame:
    """``home, pid, target``: vectors of a home block that the block ``target`` must compare with its members.

    A new link out of a block brings its end and all neighbours of that; an old one brings the new neighbours
    of its end; the best ``REVERSE`` new links to a vector bring their starts.  Nothing is wanted twice over
    all rounds.  Questions go to the home block of what they ask about, which holds the lists.
    """
    links = _again(edges, "home", "pid", "fresh", "sims", F.posexplode("nbrs").alias("i", "u")).where(F.col("home") != home_of("u"))
    links = links.select("home", "pid", "u", F.get("sims", F.col("i")).alias("s"), F.getbit("fresh", F.col("i")).cast("boolean").alias("new"))
    out = links.groupBy(F.col("home").alias("target"), "u").agg(F.max("new").alias("new")).withColumn("at", home_of("u"))

    def ends(mine: pa.Table, questions: pa.Table) -> pa.Table:
        pid, width = np.asarray(mine.column("pid")), 1
        sizes = np.asarray(mine.column("nbrs").combine_chunks().value_lengths()) if len(mine) else np.zeros(0, "i8")
        width = max(1, int(sizes.max()) if len(sizes) else 1)
        ids, _ = _padded(mine, width) if len(mine) else (np.zeros((0, width), "i8"), None)
        fresh = (np.asarray(mine.column("fresh"))[:, None] >> np.arange(width)) & 1 > 0
        target, u, new = (np.asarray(questions.column(c)) for c in ("target", "u", "new"))
        at, known = _places(pid, u)
        target, u, new, at = target[known], u[known], new[known].astype(bool), at[known]
        take = (ids[at] >= 0) & (new[:, None] | fresh[at])
        found = np.concatenate([u[new], ids[at][take]])
        where = np.concatenate([target[new], np.repeat(target, take.sum(1))])
        away = found >> RANK_BITS != where
        pairs = np.unique(np.stack([where[away], found[away]], axis=1), axis=0)
        return pa.table({"home": pa.array(pairs[:, 1] >> RANK_BITS, pa.int64()), "pid": pa.array(pairs[:, 1], pa.int64()), "target": pa.array(pairs[:, 0], pa.int64())})

    form = "home bigint, pid bigint, target bigint"
    forward = _again(edges, "home", "pid", "nbrs", "sims", "fresh").groupBy("home").cogroup(out.groupBy("at")).applyInArrow(ends, form)
    best = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "pid"))
    backward = links.where("new").select("u", "home", "pid", "s").withColumn("n", best).where(F.col("n") <= REVERSE).select("home", "pid", home_of("u").alias("target"))
    wanted = forward.unionByName(backward).groupBy("home", "pid", "target").agg(F.lit(1).alias("n")).drop("n")
    return wanted if asked is None else wanted.join(asked, ["home", "pid", "target"], "left_anti")


def _round(edges: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One NN-descent round: every block compares its members with the vectors it wants."""

    def serve(mine: pa.Table, wishes: pa.Table) -> pa.Table:
        at, known = _places(np.asarray(mine.column("pid")), np.asarray(wishes.column("pid")))
        found = mine.take(pa.array(at[known], pa.int64())) if len(mine) else mine
        return pa.table({"target": wishes.column("target").filter(pa.array(known)), "pid": found.column("pid"), "vec": found.column("vec")})

    guests = _again(edges, "home", "pid", "vec").groupBy("home").cogroup(wanted.groupBy("home")).applyInArrow(serve, "target bigint, pid bigint, vec binary")

    def local(mine: pa.Table, others: pa.Table) -> pa.Table:
        old, old_sims = _padded(mine, width)
        pid = np.asarray(mine.column("pid"))
        if not len(others) or not len(mine):
            return _lists(pid, old, old_sims, np.zeros(old.shape, bool), mine.column("vec"))
        ids, sims = _union(old, old_sims, *_top(unpack(mine.column("vec")), pid, unpack(others.column("vec")), np.asarray(others.column("pid")), width), width)
        return _lists(pid, ids, sims, ~(ids[:, :, None] == old[:, None, :]).any(2), mine.column("vec"))

    return _again(edges, "home", "pid", "nbrs", "sims", "vec").groupBy("home").cogroup(guests.groupBy("target")).applyInArrow(local, _GRAPH)


def _exact_probes(edges: DataFrame, n: int, k: int) -> dict[int, list[int]]:
    """The true neighbours of ``PROBES`` classes, the first by hash; every task compares them with its vectors."""
    h = F.pmod(F.xxhash64("pid"), F.lit(1 << 30))
    few = edges.select("pid", "vec", h.alias("h"))
    if n > 4 * PROBES:
        few = few.where(F.col("h") < F.lit(int((1 << 30) * 2.0 * PROBES / n)))
    rows = few.orderBy("h", "pid").limit(PROBES).collect()
    pids, x = np.array([r.pid for r in rows]), unpack([r.vec for r in rows])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sims = np.full((len(pids), 0), -1, "i8"), np.full((len(pids), 0), -2.0, "f4")
        for batch in batches:
            i, s = _top(x, pids, unpack(batch.column(1)), np.asarray(batch.column(0)), k)
            ids, sims = _best(np.hstack([ids, i]), np.hstack([sims, s]), k)
        keep = ids >= 0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pids, keep.sum(1))), pa.array(ids[keep]), pa.array(sims[keep])], names=["pid", "nbr", "s"])

    best = edges.select("pid", "vec").mapInArrow(scan, "pid bigint, nbr bigint, s float").groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "nbr"))), 1, k).alias("p"))
    return {r.pid: [p.nbr for p in r.p] for r in best.collect()}


def _recall(edges: DataFrame, probes: dict[int, list[int]], k: int) -> float:
    found = edges.where(F.col("pid").isin(list(probes))).select("pid", F.slice("nbrs", 1, k).alias("nbrs")).collect()
    hits = sum(len(set(r.nbrs) & set(probes[r.pid])) for r in found)
    return hits / sum(map(len, probes.values())) if probes else 1.0


def _links(edges: DataFrame, k: int) -> DataFrame:
    e = edges.select("pid", F.explode(F.slice(F.arrays_zip("nbrs", "sims"), 1, k)).alias("e"))
    return e.select("pid", F.col("e.nbrs").alias("u"), F.col("e.sims").alias("s"))


def _ranked(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``id, pid, neighbour, u, similarity, rank`` of the members of the classes in ``edges``.

    Members of one class share their list, made of the ``k + 1`` smallest ids of the class itself and of each
    neighbouring class; a class that holds a third of all rows costs ``k + 1`` rows there, and its members
    fetch the list by a broadcast join: at most ``HOT_SHARE`` classes are that large.
    """
    few = members.withColumn("n", F.row_number().over(W.partitionBy("pid").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("pid").alias("u"), F.col("id").alias("other"))
    own = edges.select("pid", F.col("pid").alias("u"), F.lit(1.0).cast("float").alias("s"))
    entry = F.struct((-F.col("s")).alias("d"), F.col("other").alias("i"), "u")
    near = _links(edges, k).unionByName(own).join(few, "u").groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("near"))
    total = members.count()
    hot = members.groupBy("pid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(1000, total // HOT_SHARE)).select("pid", F.lit(True).alias("hot"))
    marked = members.join(F.broadcast(hot), "pid", "left")
    rest = marked.where("hot is null").drop("hot").join(near, "pid")
    listed = rest.unionByName(marked.where("hot").drop("hot").join(F.broadcast(near.join(F.broadcast(hot.select("pid")), "pid", "left_semi")), "pid"))
    mine = F.slice(F.filter("near", lambda x: x["i"] != F.col("id")), 1, k)
    return listed.select("id", "pid", F.posexplode(mine).alias("rank", "x")).select("id", "pid", F.col("x.i").alias("neighbour"), F.col("x.u").alias("u"), (-F.col("x.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def neighbours(graph: Graph, k: int) -> DataFrame:
    """``id, neighbour, similarity, rank``: for each member its ``k`` most similar others, ties by smaller id."""
    return _ranked(graph.edges, graph.members, k).select("id", "neighbour", "similarity", "rank")


def similar_pairs(rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int) -> DataFrame:
    """Distinct ``id_a, id_b`` (``id_a < id_b``) of which at least one is among the other's ``k`` nearest.

    Repeated rows count once; rows without a usable vector take no part (see :func:`usable_vectors`).
    Pairs of classes of one member each are made distinct by their numbers and named afterwards; only lists
    that touch a class of several members are worked out by name.
    """
    graph = build_graph(rows, id_col, vec_col, dim, k)
    if graph is None:
        return rows.select(F.col(id_col).alias("id_a"), F.col(id_col).alias("id_b")).limit(0)
    links = _links(graph.edges, k).select("pid", "u")
    several = cut_lineage(graph.members.groupBy("pid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("pid"))
    touched = cut_lineage(links.join(several.select(F.col("pid").alias("u")), "u", "left_semi").select("pid").unionByName(several).distinct())
    named = _ranked(graph.edges.join(touched, "pid", "left_semi"), graph.members, k)
    both = several.select(F.col("pid").alias("pid"), F.lit(True).alias("more"))
    named = cut_lineage(named.join(both, "pid", "left").join(both.select(F.col("pid").alias("u"), F.col("more").alias("u_more")), "u", "left"))
    single = F.col("more").isNull() & F.col("u_more").isNull()
    plain = links.join(touched, "pid", "left_anti").unionByName(named.where(single).select("pid", "u"))
    numbers = plain.select(F.least("pid", "u").alias("a"), F.greatest("pid", "u").alias("b")).distinct()
    names = graph.members
    pairs = numbers.join(names.select(F.col("pid").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("pid").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))
    return ordered(pairs, "x", "y").unionByName(ordered(named.where(~single), "id", "neighbour").distinct())


#: Points of a query's block that a search starts from, points kept while it runs, and its most rounds.
STARTS = 8
BEAM = 48
SEARCH_ROUNDS = 12


def greedy_search(graph: Graph, queries: DataFrame, id_col: str, vec_col: str, dim: int, k: int, starts: int = STARTS, beam: int = BEAM, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """``query_id, id, similarity, rank``: for each query the ``k`` most similar members that greedy search finds.

    A query starts at points of the block its vector falls into, or of that block's leaf if it has none; every
    round expands the best ``beam`` points seen so far along the graph's links, for all queries in one join,
    until no query has a new one among its best.  Queries without a usable vector have no rows; a query that is
    itself a member finds itself.
    """
    wanted = cut_lineage(usable_vectors(queries, id_col, vec_col, dim).groupBy("id").agg(F.min(F.struct("key", "vec")).alias("x")).select(F.col("id").alias("q"), F.col("x.vec").alias("qvec")))
    tree = graph.trees[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves(tree, unpack(batch.column(1))), pa.int64())], names=["q", "home"])

    id_type = dict(wanted.dtypes)["q"]
    points = graph.edges.select("pid", home_of("pid").alias("home"))
    leaf = F.shiftright("home", PLANE_BITS)
    first = lambda key: points.withColumn("at", key).withColumn("n", F.row_number().over(W.partitionBy("at").orderBy("pid"))).where(F.col("n") <= starts).select("at", "pid")
    placed = cut_lineage(wanted.mapInArrow(place, f"q {id_type}, home bigint"))
    here = placed.join(first(F.col("home")).withColumnRenamed("at", "home"), "home").select("q", "pid")
    stray = placed.join(here.select("q").distinct(), "q", "left_anti").select("q", leaf.alias("leaf"))
    new = here.unionByName(stray.join(first(leaf).withColumnRenamed("at", "leaf"), "leaf").select("q", "pid"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = (unpack(batch.column(2)) * unpack(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype("f4"))], names=["q", "pid", "s"])

    best = W.partitionBy("q").orderBy(F.desc("s"), "pid")
    seen = None
    for n in range(rounds):
        scored = new.join(graph.edges.select("pid", "vec"), "pid").join(wanted, "q").select("q", "pid", "qvec", "vec").mapInArrow(compare, f"q {id_type}, pid bigint, s float").withColumn("at", F.lit(n))
        seen = cut_lineage(scored if seen is None else seen.unionByName(scored))
        fresh = seen.withColumn("k", F.row_number().over(best)).where((F.col("k") <= beam) & (F.col("at") == n))
        steps = fresh.select("q", "pid").join(graph.edges.select("pid", "nbrs"), "pid").select("q", F.explode("nbrs").alias("pid")).distinct()
        new = cut_lineage(steps.join(seen.select("q", "pid"), ["q", "pid"], "left_anti"))
        if new.isEmpty():
            break
    top = seen.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("q", "pid", "s")
    few = graph.members.withColumn("n", F.row_number().over(W.partitionBy("pid").orderBy("id"))).where(F.col("n") <= k).select("pid", "id")
    order = W.partitionBy("q").orderBy(F.desc("s"), "id")
    found = top.join(few, "pid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias("query_id"), "id", F.col("s").alias("similarity"), "rank")
