"""Table schemas of the engine."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("file_hash", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("symbols_referenced", T.ArrayType(T.StringType())),
        T.StructField("page_start", T.IntegerType()),
        T.StructField("page_end", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("file_start_line", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

FILE_HASHES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("directory", T.StringType()),
        T.StructField("files_found", T.IntegerType()),
        T.StructField("files_indexed", T.IntegerType()),
        T.StructField("files_cached", T.IntegerType()),
        T.StructField("chunks_generated", T.IntegerType()),
        T.StructField("chunks_embedded", T.IntegerType()),
        T.StructField("failed_files", T.ArrayType(T.StringType())),
    ]
)
