"""Directory scan as a Python data source: every regular file under the given roots, hidden names included."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.functions.columns import selected_file

SCHEMA = "path string, relative_path string, ext string, content binary, file_hash string, directory string"


#: Files and bytes of one partition.
MAX_FILES = 1000
MAX_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, root: str, names: list[str]):
        super().__init__(names)
        self.root, self.names = root, names


class _TreeReader(DataSourceReader):
    """The driver lists names and sizes; partitions hold as many files as fit, whatever their folders."""

    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.with_content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            names, size = [], 0
            for name, n in self._listed(root):
                if names and (len(names) >= MAX_FILES or size + n > MAX_BYTES):
                    parts.append(_Files(root, names))
                    names, size = [], 0
                names.append(name)
                size += n
            if names:
                parts.append(_Files(root, names))
        return parts or [_Files("", [])]

    def _listed(self, root: str) -> Iterator[tuple[str, int]]:
        for folder, subs, names in os.walk(root):
            subs[:] = sorted(subs) if self.recursive else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                if os.path.isfile(path):
                    yield os.path.relpath(path, root), os.path.getsize(path)

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(partition.root, name)
            data = Path(path).read_bytes()
            yield path, name, os.path.splitext(name)[1], data if self.with_content else None, hashlib.sha256(data).hexdigest(), partition.root


class TreeSource(DataSource):
    """Format ``source_tree``: option ``roots`` (one a line) and ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def scan_directories(spark: SparkSession, directories: list[str], recursive: bool = True, only_selected: bool = True, content: bool = True) -> DataFrame:
    """Files of all roots in one table; raises ``ValueError`` naming every root that is no directory.

    ``content=False`` leaves the bytes null; their hash is taken all the same.
    """
    roots = [str(Path(d).resolve()) for d in directories]
    missing = [d for d, r in zip(directories, roots, strict=True) if not os.path.isdir(r)]
    if missing:
        raise ValueError("not found: " + ", ".join(map(str, missing)))
    spark.dataSource.register(TreeSource)
    files = spark.read.format("source_tree").option("roots", "\n".join(roots)).option("recursive", str(recursive).lower()).option("content", str(content).lower()).load()
    return files.where(selected_file(F.col("relative_path"))) if only_selected else files


def with_contents(files: DataFrame) -> DataFrame:
    """``files`` with the bytes at each path and their hash; a file that is gone by now is left out."""
    schema = files.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                try:
                    data = Path(r["path"]).read_bytes()
                except OSError:
                    continue
                rows.append(r | {"content": data, "file_hash": hashlib.sha256(data).hexdigest()})
                size += len(data)
                if size > MAX_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a text file, read in splits; ``line_no`` grows with the place in it.  A missing file is an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "line_no long, line string")
    return spark.read.text(str(path)).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
