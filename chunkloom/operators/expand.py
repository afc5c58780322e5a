"""Symbol lookup and dependency expansion: an edge join instead of one lookup per reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkloom import config as C
from chunkloom.session import cut_lineage

ORDER = ("file_path", "start_line", "chunk_id")
KEYS = ["file_path", "start_line"]


def symbol_table(chunks: DataFrame, limit: int = C.SYMBOL_LIMIT) -> DataFrame:
    """At most ``limit`` chunks per symbol name, ordered by path, line and id: ``..., lookup_rank``.

    The rank filter becomes a per-task group limit before the shuffle, so a name that a third of all
    chunks carry sends ``limit`` rows per task.
    """
    w = W.partitionBy("symbol_name").orderBy(*ORDER)
    return chunks.where(F.col("symbol_name").isNotNull()).withColumn("lookup_rank", F.row_number().over(w)).where(F.col("lookup_rank") <= limit)


def lookup_symbols(chunks: DataFrame, symbols: DataFrame, limit: int = C.SYMBOL_LIMIT) -> DataFrame:
    """Chunks of each wanted ``symbol_name``, at the fixed distance of a symbol hit."""
    wanted = symbols.select("symbol_name").distinct()
    return symbol_table(chunks.join(wanted, "symbol_name", "left_semi"), limit).withColumn("distance", F.lit(C.SYMBOL_DISTANCE))


def expand_dependencies(chunks: DataFrame, seeds: DataFrame, depth: int, limit: int = C.SYMBOL_LIMIT) -> DataFrame:
    """Breadth-first expansion along references; ``file_path, start_line, ..., distance, pos, depth``.

    ``seeds`` has the chunk columns, ``distance`` and ``pos`` (its order, a number or a text).  Every level resolves each
    reference to at most ``limit`` chunks (before duplicates go), drops what an earlier row of any level
    already has by ``(file_path, start_line)`` and appends the rest in order of parent position, reference
    position and lookup rank.  Only chunks that a level refers to are ranked.  Seeds themselves keep their duplicates.  An empty frontier ends it early.
    """
    cols = ["chunk_id", "file_path", "start_line", "symbol_name", "symbols_referenced"]
    pos = F.col("pos") if dict(seeds.dtypes)["pos"] == "string" else F.format_string("%08d", F.col("pos").cast("int"))
    result = seeds.select(*cols, "distance", pos.alias("pos"), F.lit(0).alias("depth"))
    frontier = result
    for level in range(1, depth + 1):
        edges = frontier.select(F.col("pos").alias("from_pos"), F.posexplode("symbols_referenced").alias("ref_pos", "symbol_name")).where("symbol_name <> ''")
        names = symbol_table(chunks.select(*cols).join(edges.select("symbol_name").distinct(), "symbol_name", "left_semi"), limit)
        found = edges.join(names, "symbol_name").withColumn("pos", F.format_string("%s.%05d.%d", "from_pos", "ref_pos", "lookup_rank"))
        first = W.partitionBy(*KEYS).orderBy("pos")
        fresh = (
            found.withColumn("__n", F.row_number().over(first))
            .where("__n = 1")
            .join(result.select(*KEYS).distinct(), KEYS, "left_anti")
            .select(*cols, F.lit(C.SYMBOL_DISTANCE).alias("distance"), "pos", F.lit(level).alias("depth"))
        )
        if level < depth:
            fresh = cut_lineage(fresh)
            if fresh.isEmpty():
                break
        result = result.unionByName(fresh)
        frontier = fresh
    return result
