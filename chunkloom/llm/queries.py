"""Queries of the training-data operators; imported by the entry module only where this subpackage exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import docpairs, handwritten, knn, leak, sentences, syntax, tokenize
from chunkloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("p3_found")
def p3_found(spark, d):
    """Problem 3: functions and methods whose documentation tells more than their names."""
    return docpairs.documented_functions(table(spark, d, "code_chunks"), with_text=False).select("chunk_id").distinct()


@query("p3_pairs")
def p3_pairs(spark, d):
    """Problem 3: description-code pairs with source offsets."""
    return docpairs.documented_functions(table(spark, d, "code_chunks"))


@query("p6_ids")
def p6_ids(spark, d):
    """Problem 6: token ids of every document by the 50k byte-level vocabulary."""
    return tokenize.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


@query("p6_roundtrip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_roundtrip(spark, d):
    """Problem 6: encoding and decoding give every text back."""
    return tokenize.decode_corpus(p6_ids(spark, d)).select("doc_id", F.col("text"))


@query("p7_found")
def p7_found(spark, d):
    """Problem 7: documents that carry a passage of an evaluation item."""
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_found")
def p8_found(spark, d):
    """Problem 8: the end of every sentence of every document."""
    return sentences.sentence_boundaries(table(spark, d, "documents")).distinct()


@query("p5_found")
def p5_found(spark, d):
    """Problem 5: source files that are no valid text of the language of their extension."""
    return syntax.unparsable_files(table(spark, d, "files")).select("file_path").distinct()


@query("p5_rates")
def p5_rates(spark, d):
    """Problem 5: share of files that do not parse, per directory and language."""
    return syntax.parse_rates(table(spark, d, "files"))


@query("p2_found")
def p2_found(spark, d):
    """Problem 2: source files that nobody wrote by hand in their repository."""
    return handwritten.not_handwritten(table(spark, d, "files")).select("file_path")


@query("p2_reasons")
def p2_reasons(spark, d):
    """Problem 2: the same files with the reason."""
    return handwritten.not_handwritten(table(spark, d, "files"))


#: Numbers of a usable embedding, and neighbours asked for.
P1_DIM = 96
P1_K = 10


@query("p1_found")
def p1_found(spark, d):
    """Problem 1: pairs of chunks of which one is among the other's ten most similar."""
    pairs = knn.similar_pairs(table(spark, d, "code_chunks").select("chunk_id", "embeddings"), "chunk_id", "embeddings", P1_DIM, P1_K)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query("p1_search")
def p1_search(spark, d):
    """Problem 1: greedy graph search; every vector whose id is divisible by 100, against all vectors."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    graph = knn.build_graph(emb, "vec_id", "embedding", 64, P1_K)
    return knn.greedy_search(graph, emb.where("vec_id % 100 = 0"), "vec_id", "embedding", 64, P1_K)
