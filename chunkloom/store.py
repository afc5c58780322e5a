"""The chunk store: Parquet batches that are only ever added to, and numbered commits that say which ones count.

A write adds one batch with the rows of the files it touches and names these files dead in all batches before
it; its cost follows the change, not the store.  A commit is a small file that must not exist yet, so of two
writers at once one fails.  Readers of an older commit are not disturbed; ``vacuum`` merges the batches.  All
access goes through Hadoop's file system, so the store can stand wherever Spark can read and write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.config import EngineConfig
from chunkloom.embed import Embedder, embed_chunks
from chunkloom.operators import upsert
from chunkloom.schema import CHUNKS, FILE_HASHES

STORED = T.StructType([*CHUNKS.fields, T.StructField("directory", T.StringType()), T.StructField("indexed_at", T.TimestampType()), T.StructField("embeddings", T.ArrayType(T.FloatType()))])
DEAD = T.StructType([T.StructField("file_path", T.StringType())])
PARTS = {"chunks": STORED, "file_hashes": FILE_HASHES, "dead": DEAD}


class ChunkStore:
    """Chunks and file hashes under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.root = str(path).rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))

    # -- commits

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _last(self) -> tuple[int, list[dict]]:
        """Number of the last commit and its batches, each ``{"at": number, part: folder, ...}``."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("commits"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, []
        stream = self._fs.open(self._path(f"commits/{max(numbers)}.json"))
        try:
            text = self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()
        try:
            return max(numbers), json.loads(str(text))["batches"]
        except (ValueError, KeyError) as e:
            raise RuntimeError(f"commit {max(numbers)} of the store {self.root} cannot be read; nothing was deleted") from e

    def _commit(self, number: int, batches: list[dict]) -> None:
        out = self._fs.create(self._path(f"commits/{number}.json"), False)
        try:
            out.write(bytearray(json.dumps({"batches": batches}).encode()))
        finally:
            out.close()

    def _batch(self, number: int, **parts: DataFrame) -> dict:
        """Writes the parts of a batch; a folder that no commit names is removed by ``vacuum``."""
        batch: dict = {"at": number}
        for part, df in parts.items():
            folder = f"{part}/{uuid.uuid4().hex}"
            df.select(*PARTS[part].fieldNames()).write.parquet(f"{self.root}/{folder}")
            batch[part] = folder
        return batch

    def _read(self, part: str) -> DataFrame:
        """The live rows of a part: those of no file that a later batch names dead."""
        rows, dead = (self._numbered(name) for name in (part, "dead"))
        if rows is None:
            return self.spark.createDataFrame([], PARTS[part])
        if dead is None:
            return rows.drop("__at")
        ends = dead.groupBy("file_path").agg(F.max("__at").alias("__end"))
        return rows.join(ends, "file_path", "left").where(F.col("__end").isNull() | (F.col("__at") >= F.col("__end"))).select(*PARTS[part].fieldNames())

    def _numbered(self, part: str) -> DataFrame | None:
        out = None
        for b in self._last()[1]:
            if part in b:
                df = self.spark.read.schema(PARTS[part]).parquet(f"{self.root}/{b[part]}").withColumn("__at", F.lit(b["at"]))
                out = df if out is None else out.unionByName(df)
        return out

    # -- reading

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def file_hashes(self) -> DataFrame:
        return self._read("file_hashes")

    def changed_files(self, files: DataFrame) -> DataFrame:
        """The rows of ``files`` whose hash is not stored; taken before chunking, so cached files cost a hash only."""
        plan = upsert.upsert_plan(files, self.file_hashes()).where("action <> 'cached'").select(F.col("file_path").alias("path"), "file_hash")
        return files.join(plan, ["path", "file_hash"], "left_semi")

    def stats(self) -> dict:
        return {"total_chunks": self.chunks().count(), "total_files_indexed": self.file_hashes().count(), "persist_dir": self.root}

    # -- writing

    def upsert(self, chunks: DataFrame, embedder: Embedder, config: EngineConfig) -> int:
        """Embeds and stores the chunks of changed files; returns the number embedded.

        All or nothing per file: a file any of whose chunks could not be embedded keeps its old rows and hash.
        Repeated chunk ids in one call: the last by position in the file wins.
        """
        wanted = [f.name for f in STORED.fields if f.name not in ("embeddings", "indexed_at")]
        for name in wanted:
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, F.lit(None).cast(STORED[name].dataType))
        good = chunks.select(*wanted).where(F.col("error").isNull() & F.col("chunk_id").isNotNull())
        fresh = upsert.latest_per_key(good, "chunk_id", "file_start_line", "file_hash")
        number, batches = self._last()
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            embedded = embed_chunks(fresh, embedder, config.max_embed_chars, config.embed_batch_size, config.embed_retries, order=("file_start_line", "page_start", "chunk_id"))
            embedded.withColumn("indexed_at", F.current_timestamp()).select(*STORED.fieldNames()).write.parquet(staged)
            new = self.spark.read.schema(STORED).parquet(staged)
            complete = upsert.complete_hashes(new)
            done = new.join(complete.select("file_path"), "file_path", "left_semi")
            count = done.count()
            if count:
                self._commit(number + 1, [*batches, self._batch(number + 1, chunks=done, file_hashes=complete, dead=complete)])
            return count
        finally:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    def delete_files(self, paths: list[str] | DataFrame) -> None:
        """Removes the chunks and hashes of the given files in one commit."""
        gone = paths.select("file_path") if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], DEAD)
        number, batches = self._last()
        self._commit(number + 1, [*batches, self._batch(number + 1, dead=gone.distinct())])

    def clear(self) -> None:
        """Commits an empty store."""
        self._commit(self._last()[0] + 1, [])

    def vacuum(self) -> int:
        """Merges all batches into one and deletes folders and commits that no longer count; returns how many folders."""
        number, batches = self._last()
        if len(batches) > 1:
            number += 1
            batches = [self._batch(number, chunks=self.chunks(), file_hashes=self.file_hashes())]
            self._commit(number, batches)
        live = {b[part] for b in batches for part in PARTS if part in b}
        removed = 0
        for part in PARTS:
            if self._fs.exists(self._path(part)):
                for s in self._fs.listStatus(self._path(part)):
                    if f"{part}/{s.getPath().getName()}" not in live:
                        self._fs.delete(s.getPath(), True)
                        removed += 1
        for s in self._fs.listStatus(self._path("commits")):
            if s.getPath().getName() != f"{number}.json":
                self._fs.delete(s.getPath(), False)
        return removed
