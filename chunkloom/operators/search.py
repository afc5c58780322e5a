"""Vector search: exact top-k for one query or a query set, with filters and fallback."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.functions.columns import cosine_distance

#: Vectors per numpy block in :func:`topk_batch`; bounds the memory of one task.
SCAN_BLOCK = 4096


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one query by cosine distance, ties by id.

    The query is a literal, so the plan is scan, project, ``TakeOrderedAndProject``: each task keeps ``k``
    rows and no row is shuffled.  Rows whose vector is null, of another size or all zero are left out;
    an empty query or table gives no rows.
    """
    if not query or not all(map(math.isfinite, query)):
        return vectors.limit(0).withColumn("distance", F.lit(0.0))
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return (
        rows.withColumn("distance", F.round(cosine_distance(F.col(vec_col), q), 6))
        .where(F.col("distance").isNotNull() & ~F.isnan("distance"))
        .orderBy("distance", id_col)
        .limit(k)
    )


def topk_with_fallback(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str, where: Column) -> DataFrame:
    """Filtered top-k, or the unfiltered one if no row passes the filter; one lazy plan.

    Both lists hold at most ``k`` rows, so the choice between them is a window over ``2 k`` rows.
    """
    hit = topk(vectors, query, k, id_col, vec_col, where).withColumn("__pass", F.lit(0))
    all_ = topk(vectors, query, k, id_col, vec_col).withColumn("__pass", F.lit(1))
    both = hit.unionByName(all_)
    return both.withColumn("__first", F.min("__pass").over(W.partitionBy())).where("__pass = __first").drop("__pass", "__first")


def _usable(lists, dim: int):
    """Which vectors of an Arrow list column have ``dim`` finite numbers that are not all zero, and these as a matrix."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    fits = np.flatnonzero(size == dim)
    x = np.asarray(lists.take(pa.array(fits)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return fits[good], x[good] / norm[good, None]


def _nearest(d, rank, k: int):
    """Columns of the ``k`` smallest by distance, then rank, of every row."""
    import numpy as np

    width = 4 * k
    if d.shape[1] > width:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        if ((d <= edge).sum(1) <= width).all():
            few = np.argpartition(d, width - 1, axis=1)[:, :width]
            pick = np.lexsort((np.take_along_axis(rank, few, 1), np.take_along_axis(d, few, 1)), axis=1)[:, :k]
            return np.take_along_axis(few, pick, 1)
    return np.lexsort((rank, d), axis=1)[:, :k]


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, block_rows: int = 2_000) -> DataFrame:
    """For every query row its ``k`` nearest rows: ``query_id, <id>, distance, rank``; exact.

    The query set is taken in blocks of at most ``block_rows`` rows, each of which is held by every scan
    task as one matrix; a task multiplies it with its vectors and keeps ``k`` candidates per query, so
    ``queries x tasks x k`` small rows are shuffled and no pair list is ever built.  Vectors that are null,
    of another size, not finite or all zero take no part; a query that is itself a row finds itself.  The first
    usable query names the size.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, id_type), T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def scan(qid: pa.Array, unit: np.ndarray):
        def run(batches):
            best = np.zeros((len(qid), 0))
            at = np.zeros((len(qid), 0), "i8")  # places in names
            names = None
            for batch in batches:
                rows, x = _usable(batch.column(1), unit.shape[1])
                for lo in range(0, len(rows), SCAN_BLOCK):
                    ids = batch.column(0).take(pa.array(rows[lo : lo + SCAN_BLOCK]))
                    known = 0 if names is None else len(names)
                    names = ids if names is None else pa.concat_arrays([names, ids])
                    rank = np.empty(len(names), "i8")
                    rank[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
                    d = np.round(1.0 - unit @ x[lo : lo + SCAN_BLOCK].T, 6) + 0.0
                    new = np.broadcast_to(known + np.arange(d.shape[1]), d.shape)
                    best, at = np.hstack([best, d]), np.hstack([at, new])
                    pick = _nearest(best, rank[at], k)
                    best, at = np.take_along_axis(best, pick, 1), np.take_along_axis(at, pick, 1)
                    used, at = np.unique(at, return_inverse=True)
                    names, at = names.take(pa.array(used)), at.reshape(best.shape)
            if best.size:
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(np.repeat(np.arange(len(qid)), best.shape[1]))).cast(arrow.field(0).type), names.take(pa.array(at.ravel())).cast(arrow.field(1).type), pa.array(best.ravel())], schema=arrow)

        return run

    out, dim, ids, rows = None, None, [], []

    def flush():
        nonlocal out, ids, rows
        if ids:
            x = np.asarray(rows, "f8")
            part = vectors.select(id_col, vec_col).mapInArrow(scan(pa.array(ids, arrow.field(0).type), x / np.sqrt((x * x).sum(1))[:, None]), schema)
            out = part if out is None else out.unionByName(part)
        ids, rows = [], []

    for r in queries.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).toLocalIterator():
        v = np.asarray([np.nan if x is None else x for x in r[1]], "f8")
        if len(v) and (dim is None or len(v) == dim) and np.isfinite(v).all() and v.any():
            dim = dim or len(v)
            ids.append(r[0])
            rows.append(v)
        if len(ids) >= block_rows:
            flush()
    flush()
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    w = W.partitionBy("query_id").orderBy("distance", id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_vector(vectors: DataFrame, where: Column, vec_col: str) -> list[float]:
    """The vector of the one row that ``where`` selects, or an empty list."""
    r = vectors.where(where).select(vec_col).first()
    return [float(x) for x in r[0]] if r and r[0] else []
