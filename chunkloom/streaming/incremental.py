"""Incremental indexing as a stream: each micro-batch of files goes through the same upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkloom.chunking.dispatch import chunk_files
from chunkloom.config import EngineConfig
from chunkloom.embed import Embedder
from chunkloom.operators.upsert import latest_per_key
from chunkloom.schema import FILES
from chunkloom.session import cut_lineage
from chunkloom.store import ChunkStore


def index_stream(spark: SparkSession, source_dir: str, store: ChunkStore, embedder: Embedder, checkpoint: str, config: EngineConfig | None = None) -> StreamingQuery:
    """Indexes every Parquet file of ``files`` rows that arrives in ``source_dir``.

    A batch that is run again after a failure finds its files' hashes stored and embeds nothing twice.
    """
    config = config or EngineConfig()

    def batch(files: DataFrame, _: int) -> None:
        last = latest_per_key(files, "path", "file_hash", "ext")
        store.upsert(cut_lineage(chunk_files(store.changed_files(last))), embedder, config)

    stream = spark.readStream.schema(FILES).parquet(source_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
