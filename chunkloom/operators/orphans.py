"""References to records that do not exist.

Parent keys and child keys are brought into one long form ``(parent_table, key, role, ...)`` and
grouped once by ``(parent_table, key)``.  The aggregate is a handful of flags and minima, so it is
combined on the map side and a key that a third of all rows refers to costs one row per task.  Only
the few keys with a verdict travel back to their child rows, over a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import cut_lineage

#: Characters that count as blanks at the ends of a referenced name.
BLANKS = " \t\r\n\f\x0b\u00a0\u3000"
#: A key with more than one of so many rows is split: a piece of it holds at most that share of all rows.
PIECES = 4096
#: Rows of a piece at least, below which no key is split.
LEAST_PIECE = 10_000


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_by: str, how: str = "inner", pieces: int = PIECES, least: int = LEAST_PIECE) -> DataFrame:
    """Join with at most one ``small`` row per key so that no key's ``big`` rows go to one task.

    The rows of each key are counted first.  Keys with more than ``1 / pieces`` of all rows, of which there are
    fewer than ``pieces``, are split by the hash of ``salt_by`` into as many parts as they are times too large,
    and their ``small`` rows are repeated as often.  Rows with a null key stay for ``how='left'`` and are dropped
    for ``how='inner'``.
    """
    counts = cut_lineage(big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__c")))
    limit = max(least, (counts.agg(F.sum("__c")).first()[0] or 0) // pieces)
    hot = counts.where(F.col("__c") > limit).select(key, F.ceil(F.col("__c") / limit).cast("int").alias("__parts"))
    left = big.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def chunk_lifetimes(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row per ``chunk_id``: arrival, last arrival, live flag and the latest row's attributes.

    A chunk arrives at the earliest ``indexed_at`` of its rows and is deleted if its ``file_path`` was
    deleted at or after its last one.  Rows without ``chunk_id`` are left out; a chunk without any
    ``indexed_at`` counts as live.
    """
    merged = (
        chunks.where(F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(
            F.min("indexed_at").alias("arrived_at"),
            F.max("indexed_at").alias("last_at"),
            F.max(F.struct("indexed_at", "file_path", "symbol_name", "symbols_referenced")).alias("r"),
        )
        .select("chunk_id", "arrived_at", "last_at", "r.file_path", "r.symbol_name", "r.symbols_referenced")
    )
    gone = deleted.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max("deleted_at").alias("__deleted_at"))
    return (
        salted_join(merged, gone, "file_path", "chunk_id", "left")
        .withColumn("live", ~F.coalesce(F.col("__deleted_at") >= F.col("last_at"), F.lit(False)))
        .drop("__deleted_at")
    )


def key_verdicts(long: DataFrame) -> DataFrame:
    """Per ``(parent_table, key)`` of the long form: what is wrong with the references to it, if anything.

    Input columns: ``parent_table, key, role ('parent'|'child'|'external'), live boolean, at timestamp``.
    Output: keys with at least one child whose parent is ``missing``, ``deleted`` or (for some child) ``late``.
    """
    is_role = lambda r: F.col("role") == r
    return (
        long.groupBy("parent_table", "key")
        .agg(
            F.max(is_role("parent")).alias("has_parent"),
            F.max(is_role("external")).alias("external"),
            F.max(is_role("parent") & F.col("live")).alias("any_live"),
            F.min(F.when(is_role("parent") & F.col("live"), F.col("at"))).alias("first_live"),
            F.max(is_role("child")).alias("has_child"),
            F.min(F.when(is_role("child"), F.col("at"))).alias("first_child"),
        )
        .where(F.col("has_child") & ~F.col("external"))
        .withColumn(
            "verdict",
            F.when(~F.col("has_parent"), "missing").when(~F.col("any_live"), "deleted").when(F.col("first_live") > F.col("first_child"), "late"),
        )
        .where(F.col("verdict").isNotNull())
        .select("parent_table", "key", "verdict", "first_live")
    )


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def orphan_references(chunks: DataFrame, deleted: DataFrame, external: DataFrame) -> DataFrame:
    """References of live chunks to symbols that no live chunk carried when the reference arrived.

    Returns distinct ``chunk_id, symbol, reason, arrived_at``; ``reason`` is ``missing`` (no chunk has
    that name), ``deleted`` (only deleted chunks have it) or ``late`` (the earliest live one arrived
    after the referring chunk).  Null and blank entries and names in ``external`` are no cases; null or
    empty reference arrays give no rows; empty tables give an empty result.
    """
    chunks = chunks.select("chunk_id", "file_path", "symbol_name", "symbols_referenced", "indexed_at")
    life = cut_lineage(chunk_lifetimes(chunks, deleted.select("file_path", "deleted_at")))
    refs = (
        life.where("live")
        .select("chunk_id", "arrived_at", F.explode(F.array_distinct(F.transform("symbols_referenced", trimmed))).alias("key"))
        .where(F.length("key") > 0)
    )
    lit_ts = F.lit(None).cast(dict(life.dtypes)["arrived_at"])
    form = lambda df, role, key, live, at: df.select(F.lit("code_chunks").alias("parent_table"), F.col(key).alias("key"), F.lit(role).alias("role"), live.alias("live"), at.alias("at"))
    long = (
        form(life.where(F.col("symbol_name").isNotNull()), "parent", "symbol_name", F.col("live"), F.col("arrived_at"))
        .unionByName(form(refs, "child", "key", F.lit(False), F.col("arrived_at")))
        .unionByName(form(external.where(F.col("symbol_name").isNotNull()), "external", "symbol_name", F.lit(False), lit_ts))
    )
    verdicts = key_verdicts(long).drop("parent_table")
    return (
        salted_join(refs, verdicts, "key", "chunk_id")
        .where((F.col("verdict") != "late") | (F.col("first_live") > F.col("arrived_at")))
        .select("chunk_id", F.col("key").alias("symbol"), F.col("verdict").alias("reason"), "arrived_at")
    )


def orphans_by_period(orphans: DataFrame, table_name: str) -> DataFrame:
    """Counts per referring table, month of arrival and reason; an unknown arrival is month null."""
    return orphans.groupBy(
        F.lit(table_name).alias("table_name"), F.date_format("arrived_at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("symbol").alias("n_symbols"))
