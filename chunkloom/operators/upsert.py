"""Incremental upsert: classify files by hash, replace the rows of changed ones, save complete hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkloom.functions.columns import file_id


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first); rows with a null key are dropped.

    The row-number filter is applied per task before the shuffle (group limit), so a key with a third of
    all rows costs one row per task.
    """
    w = W.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_plan(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Each file's ``action``: ``cached`` (same hash), ``modified`` or ``new``; ``file_path, file_hash, action``.

    A file with several stored hashes is cached if any of them is equal.
    """
    now = files.select(F.col("path").alias("file_path"), "file_hash").where(F.col("file_path").isNotNull()).distinct()
    stored = hashes.where(F.col("file_path").isNotNull()).select("file_path", F.col("file_hash").alias("stored_hash")).distinct()
    same = F.max((F.col("stored_hash") == F.col("file_hash")).cast("int"))
    return (
        now.join(stored, "file_path", "left")
        .groupBy("file_path", "file_hash")
        .agg(same.alias("same"), F.count("stored_hash").alias("n"))
        .select("file_path", "file_hash", F.when(F.col("same") == 1, "cached").when(F.col("n") > 0, "modified").otherwise("new").alias("action"))
    )


def replace_files(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """``stored`` without the rows of ``changed`` files, plus ``fresh``."""
    return stored.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def complete_hashes(embedded: DataFrame, vec_col: str = "embeddings") -> DataFrame:
    """Hash rows of the files all of whose chunks have a vector: ``file_id, file_path, file_hash``."""
    return (
        embedded.where(F.col("file_path").isNotNull())
        .groupBy("file_path", "file_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(vec_col) > 0, 1)).alias("ok"))
        .where("n = ok")
        .select(file_id(F.col("file_path")).alias("file_id"), "file_path", "file_hash")
    )


def index_report(directory_of_files: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """Counters per directory: found, indexed (files with a chunk), failed, cached (the rest), chunks, embedded.

    ``directory_of_files`` has ``directory, path``; ``chunks`` has ``directory, file_path, embeddings``;
    ``failed`` has ``directory, failed_files``, whose distinct entries count, blank and null ones not.
    """
    found = directory_of_files.groupBy("directory").agg(F.count(F.lit(1)).alias("files_found"))
    made = chunks.groupBy("directory").agg(
        F.countDistinct("file_path").alias("files_indexed"),
        F.count(F.lit(1)).alias("chunks_generated"),
        F.count(F.when(F.size("embeddings") > 0, 1)).alias("chunks_embedded"),
    )
    named = failed.select("directory", F.explode("failed_files").alias("f")).where(F.trim("f") != "").groupBy("directory").agg(F.countDistinct("f").alias("files_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    cached = zero("files_found") - zero("files_indexed") - zero("files_failed")
    counters = ("files_found", "files_indexed", "files_failed", "chunks_generated", "chunks_embedded")
    return found.join(made, "directory", "left").join(named, "directory", "left").select("directory", *(zero(c).alias(c) for c in counters), cached.alias("files_cached"))
