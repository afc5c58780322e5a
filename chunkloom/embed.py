"""Embedding as an Arrow map with a pluggable back end."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic bag-of-words embedder for tests and offline use."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


def embed_batch(texts: list[str], embedder: Embedder, max_chars: int, retries: int, pause: Callable[[float], None] = time.sleep) -> list[list[float]] | None:
    """Vectors of a batch, or None if a text is over the limit or every try fails or comes back short.

    Tries wait 1, 2, 4 ... seconds after a failure, not after the last one.
    """
    if any(len(t) > max_chars for t in texts):
        return None
    for attempt in range(retries):
        try:
            got = embedder(texts)
            if len(got) == len(texts) and all(got):
                return [[float(x) for x in v] for v in got]
        except Exception:
            pass
        if attempt + 1 < retries:
            pause(2.0**attempt)
    return None


def embed_chunks(chunks: DataFrame, embedder: Embedder, max_chars: int = 2000, batch: int = 128, retries: int = 3, out: str = "embeddings", file_col: str = "file_path", order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """``chunks`` with the vector column ``out``; batches never cross files, so a file's outcome is its own.

    Rows of a file come together by a shuffle and are embedded in ``order``.  From the first batch of a file that
    fails on, its vectors are null, and the file stays incomplete.
    """
    keep = [f for f in chunks.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last rows of a file that may go on
        failed: list = []  # the file that has failed, if any
        for rows, is_last in _marked(batches):
            part = pa.Table.from_batches([rows]) if rows is not None else None
            table = part if held is None else held if part is None else pa.concat_tables([held, part])
            if table is None:
                continue
            names, texts = table.column(file_col).to_pylist(), table.column("content").to_pylist()
            vectors: list = []
            while (at := len(vectors)) < len(names):
                end = at + 1
                while end < len(names) and end - at < batch and names[end] == names[at]:
                    end += 1
                if end == len(names) and end - at < batch and not is_last:
                    break
                got = None if failed == [names[at]] else embed_batch([t or "" for t in texts[at:end]], embedder, max_chars, retries)
                if got is None:
                    failed = [names[at]]
                vectors += got or [None] * (end - at)
            done, held = table.slice(0, len(vectors)), table.slice(len(vectors))
            if vectors:
                cols = [done.column(f.name).combine_chunks().cast(arrow.field(f.name).type) for f in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(vectors, arrow.field(out).type)], schema=arrow)

    together = chunks.select(*(f.name for f in keep)).repartition(file_col).sortWithinPartitions(file_col, *order)
    return together.mapInArrow(run, schema)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, bool]]:
    """The batches, and one more step at the end."""
    for rows in batches:
        yield rows, False
    yield None, True
