"""Files to chunks, distributed: one Arrow batch of files in, many chunk rows out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom import config as C
from chunkloom.chunking.cpp import chunk_cpp
from chunkloom.chunking.documents import chunk_markdown, chunk_pdf, read_pdf
from chunkloom.chunking.proto import chunk_proto
from chunkloom.chunking.python import chunk_python
from chunkloom.schema import CHUNKS


def short_id(*parts) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


def chunk_file(path: str, relative_path: str, ext: str | None, data: bytes | None) -> Iterator[dict]:
    """Chunks of one file by its extension in lower case; an unknown extension gives none."""
    ext = (ext or "").lower()
    if ext in C.PDF_EXTENSIONS:
        yield from chunk_pdf(*read_pdf(data), relative_path)
    elif ext in C.MARKDOWN_EXTENSIONS:
        yield from chunk_markdown(data, relative_path)
    elif ext in C.PROTO_EXTENSIONS:
        yield from chunk_proto(data, relative_path)
    elif ext == ".py":
        yield from chunk_python(data, relative_path)
    elif ext in C.CODE_EXTENSIONS:
        yield from chunk_cpp(data, relative_path)


def _rows(files: list[dict]) -> Iterator[dict]:
    for f in files:
        path = f["path"]
        base = {"file_path": path, "relative_path": f["relative_path"], "file_hash": f["file_hash"]}
        try:
            for c in chunk_file(path, f["relative_path"] or "", f["ext"], f["content"]):
                key = (path, f"p{c['page_start']}", c["symbol_name"]) if "page_start" in c else (path, c["start_line"])
                yield {"chapter": "", **base, **c, "chunk_id": short_id(*key)}
        except Exception as e:  # the file is reported, the run goes on
            yield base | {"error": f"{type(e).__name__}: {e}"[:500]}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(CHUNKS)
    for batch in batches:
        rows, size = [], 0
        for row in _rows(batch.to_pylist()):
            rows.append(row)
            size += len(row.get("content") or "")
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def chunk_files(files: DataFrame) -> DataFrame:
    """All chunks of a ``files`` table, plus one row with ``error`` set for each file that failed.

    A null ``ext`` is taken from the path; null content is an empty file; rows without path are dropped.
    """
    ext = F.coalesce("ext", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    src = files.where(F.col("path").isNotNull()).select("path", "relative_path", ext.alias("ext"), "content", "file_hash")
    return src.mapInArrow(_batches, CHUNKS)
