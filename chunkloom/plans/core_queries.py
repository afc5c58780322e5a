"""The registered core queries: name -> (DataFrame plan, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkloom import config as C
from chunkloom.functions import columns as X
from chunkloom.operators import context as ctx
from chunkloom.operators import expand, orphans, search, upsert
from chunkloom.plans import outline_sql
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


# ---------------------------------------------------------------- vector search

_COS = "round(1.0 - list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double), lambda x, y: x + y) / (sqrt(list_reduce(list_transform({a}, lambda p: p::double * p::double), lambda x, y: x + y)) * sqrt(list_reduce(list_transform({b}, lambda p: p::double * p::double), lambda x, y: x + y))), 6) + 0.0"
_DIST = _COS.format(a="e.embedding", b="q.embedding")
_TOPK_SQL = f"SELECT e.vec_id, e.label, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {{where}} ORDER BY distance, vec_id LIMIT 10"


def _q0(spark, d):
    emb = table(spark, d, "embeddings")
    return emb, search.first_vector(emb, F.col("vec_id") == 0, "embedding")


@query("topk_cosine", _TOPK_SQL.format(where=""))
def topk_cosine(spark, d):
    """V1: the ten rows nearest to vector 0."""
    emb, q = _q0(spark, d)
    return search.topk(emb, q, 10, "vec_id", "embedding").select("vec_id", "label", "distance")


@query("topk_filtered", _TOPK_SQL.format(where="WHERE e.label = 3"))
def topk_filtered(spark, d):
    """V2: the filter goes to the scan before ranking."""
    emb, q = _q0(spark, d)
    return search.topk(emb, q, 10, "vec_id", "embedding", F.col("label") == 3).select("vec_id", "label", "distance")


@query("topk_fallback", _TOPK_SQL.format(where="WHERE e.label = 99 OR NOT EXISTS (SELECT 1 FROM embeddings WHERE label = 99)"))
def topk_fallback(spark, d):
    """V3: no row has label 99, so the unfiltered list comes out."""
    emb, q = _q0(spark, d)
    return search.topk_with_fallback(emb, q, 10, "vec_id", "embedding", F.col("label") == 99).select("vec_id", "label", "distance")


@query(
    "topk_batch",
    f"SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::int AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 10",
)
def topk_batch(spark, d):
    """V1/J6 for a query set: every row whose id is divisible by 100, against all rows."""
    emb = table(spark, d, "embeddings")
    return search.topk_batch(emb, emb.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")


# ---------------------------------------------------------------- scan, log, filters

_EXT_SQL = "lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1))"
_SQL = lambda x: x.replace("'", "''")
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_SELECTED = f"{_EXT_SQL} IN {_IN(C.ALL_EXTENSIONS)} AND lower(split_part(relative_path, '/', -1)) NOT IN {_IN(C.EXCLUDED_FILENAMES)} AND NOT list_has_any(list_transform(string_split(relative_path, '/'), lambda x: lower(x)), [{', '.join(repr(x) for x in C.EXCLUDED_DIRS)}]) AND string_split(relative_path, '/')[1] NOT IN {_IN(C.EXCLUDED_ROOT_DIRS)}"


@query("scan_filter", f"SELECT DISTINCT path, relative_path FROM files WHERE {_SELECTED}")
def scan_filter(spark, d):
    """F1-F4 over the file table."""
    return table(spark, d, "files").select("path", "relative_path").where(X.selected_file(F.col("relative_path"))).distinct()


@query("log_tail", "SELECT event_id, line FROM (SELECT event_id, trim((ts::varchar)[:19] || ' ' || event_type || ' ' || props) AS line FROM events) WHERE contains(lower(line), 'error') ORDER BY event_id DESC LIMIT 10")
def log_tail(spark, d):
    """The last ten lines that mention an error."""
    from chunkloom.sources.logs import error_tail

    ev = table(spark, d, "events")
    line = F.concat_ws(" ", F.substring(F.col("ts").cast("string"), 1, 19), "event_type", "props")
    return error_tail(ev.select("event_id", line.alias("line")), "event_id", "line")


_TEXT = "regexp_replace(regexp_replace(decode(content), '^﻿', ''), '\r\n?', '\n', 'g')"
_CC = "(SELECT DISTINCT chunk_id, content, file_path, relative_path, language, chunk_type, symbol_name, chapter, start_line, end_line, symbols_referenced, page_start FROM code_chunks)"


@query(
    "worth_chunking",
    "SELECT chunk_id, (n BETWEEN 3 AND 10000 AND code::double / n > 0.1) AS worth FROM (SELECT chunk_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(trim(x), '^[^#\\s]'))) AS code FROM (SELECT DISTINCT chunk_id, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS l FROM code_chunks))",
)
def worth_chunking(spark, d):
    """F6 over chunk texts."""
    return table(spark, d, "code_chunks").select("chunk_id", "content").distinct().select("chunk_id", X.worth_chunking(F.col("content")).alias("worth"))


@query("min_size", "SELECT chunk_id FROM code_chunks WHERE (page_start IS NULL AND end_line - start_line >= 3) OR (page_start IS NOT NULL AND length(trim(content)) >= 100) GROUP BY chunk_id")
def min_size(spark, d):
    """Functions of at least four lines, sections of at least 100 characters."""
    c = table(spark, d, "code_chunks").select("chunk_id", "page_start", "start_line", "end_line", "content")
    code = F.col("page_start").isNull() & (F.col("end_line") - F.col("start_line") >= C.MIN_FUNCTION_SPAN)
    doc = F.col("page_start").isNotNull() & (F.length(F.trim("content")) >= C.MIN_SECTION_CHARS)
    return c.where(code | doc).select("chunk_id").distinct()


@query("embed_guard", "SELECT doc_id, coalesce(length(text), 0)::bigint AS n, coalesce(length(text), 0) <= 2000 AS ok FROM documents")
def embed_guard(spark, d):
    """texts of at most 2000 characters can be embedded."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("n"), (n <= 2000).alias("ok"))


# ---------------------------------------------------------------- scalar functions


@query("chunk_id", "SELECT DISTINCT path, substr(sha256(path), 1, 16) AS file_id, sha256(content) AS file_hash, substr(sha256(path || ':1'), 1, 16) AS first_line_id FROM files WHERE path IS NOT NULL")
def chunk_id(spark, d):
    """Content hash and short identifiers."""
    f = table(spark, d, "files").where(F.col("path").isNotNull())
    return f.select("path", X.file_id(F.col("path")).alias("file_id"), F.sha2("content", 256).alias("file_hash"), X.short_hash(F.col("path"), F.lit(1)).alias("first_line_id")).distinct()


@query("line_slice", "SELECT DISTINCT chunk_id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS lines FROM code_chunks")
def line_slice(spark, d):
    """Lines two to four."""
    c = table(spark, d, "code_chunks")
    return c.select("chunk_id", X.line_slice(F.col("content"), F.lit(2), F.lit(4)).alias("lines")).distinct()


@query("chapter_title", "SELECT DISTINCT symbol_name, regexp_extract(trim(symbol_name), '(?i)^(?:chapitre\\s*)?(\\d+(?:\\.\\d+)*)(?:[\\.\\s:-]+.*)?$', 1) AS chapter FROM code_chunks WHERE chunk_type = 'section' AND symbol_name IS NOT NULL")
def chapter_title(spark, d):
    """X4."""
    c = table(spark, d, "code_chunks").where("chunk_type = 'section' AND symbol_name IS NOT NULL")
    return c.select("symbol_name", X.title_chapter(F.col("symbol_name")).alias("chapter")).distinct()


@query("chapter_question", "SELECT doc_id, regexp_extract('Explique le Chapitre ' || (doc_id % 9) || '.' || (doc_id % 4) || ' ' || coalesce(title, ''), '(?i)(?:chapitre|chapter)\\s*(\\d+(?:\\.\\d+)*)', 1) AS chapter FROM documents")
def chapter_question(spark, d):
    """X5."""
    q = F.concat(F.lit("Explique le Chapitre "), (F.col("doc_id") % 9).cast("string"), F.lit("."), (F.col("doc_id") % 4).cast("string"), F.lit(" "), F.coalesce("title", F.lit("")))
    return table(spark, d, "documents").select("doc_id", X.question_chapter(q).alias("chapter"))


_RPC = "rpc\\s+\\w+\\s*\\(\\s*(\\w+)\\s*\\)\\s*returns\\s*\\(\\s*(\\w+)\\s*\\)"


@query(
    "refs_extract",
    f"SELECT DISTINCT chunk_id, array_to_string(list_sort(list_distinct(CASE chunk_type WHEN 'service' THEN list_concat(regexp_extract_all(content, '{_RPC}', 1), regexp_extract_all(content, '{_RPC}', 2)) WHEN 'message' THEN regexp_extract_all(content, '(?:repeated|map\\s*<\\w+\\s*,\\s*)?\\s*([A-Z]\\w+)\\s+\\w+\\s*=\\s*\\d+', 1) ELSE [] END)), '|') AS refs FROM code_chunks WHERE chunk_type IN ('service', 'message', 'enum')",
)
def refs_extract(spark, d):
    """X8/A8 over proto chunks."""
    c = table(spark, d, "code_chunks").where(F.col("chunk_type").isin("service", "message", "enum"))
    return c.select("chunk_id", F.array_join(X.proto_references(F.col("content"), F.col("chunk_type")), "|").alias("refs")).distinct()


@query("refs_roundtrip", "SELECT DISTINCT chunk_id, len(list_filter(string_split(coalesce(array_to_string(symbols_referenced, '|'), ''), '|'), lambda x: x <> ''))::int AS n FROM code_chunks")
def refs_roundtrip(spark, d):
    """List to text and back, empty parts dropped."""
    joined = F.coalesce(F.array_join("symbols_referenced", "|"), F.lit(""))
    return table(spark, d, "code_chunks").select("chunk_id", F.size(F.filter(F.split(joined, r"\|"), lambda x: x != "")).alias("n")).distinct()


@query("strip_header", "SELECT doc_id, regexp_replace(text, '^(?:[ \t]*(?:#[^\n]*)?\n)+', '') AS body FROM documents WHERE doc_type = 'comment' AND text IS NOT NULL")
def strip_header(spark, d):
    """C25 for texts with a ``#`` header."""
    t = table(spark, d, "documents").where("doc_type = 'comment' AND text IS NOT NULL")
    return t.select("doc_id", X.python_header_stripped(F.col("text")).alias("body"))


@query(
    "content_header",
    "SELECT DISTINCT chunk_id, CASE WHEN language = 'python' THEN '# File: ' || relative_path || chr(10) WHEN language IN ('cpp', 'proto') THEN '// File: ' || relative_path || chr(10) WHEN chunk_type = 'page' THEN '# Document : ' || relative_path || chr(10) || '# Page ' || page_start ELSE '# Document : ' || relative_path || chr(10) || '# Section : ' || coalesce(symbol_name, '') END AS header FROM code_chunks",
)
def content_header(spark, d):
    """First header lines by language."""
    rel = F.col("relative_path")
    doc = F.concat(F.lit("# Document : "), rel, F.lit("\n"))
    head = (
        F.when(F.col("language") == "python", F.concat(F.lit("# File: "), rel, F.lit("\n")))
        .when(F.col("language").isin("cpp", "proto"), F.concat(F.lit("// File: "), rel, F.lit("\n")))
        .when(F.col("chunk_type") == "page", F.concat(doc, F.lit("# Page "), F.col("page_start").cast("string")))
        .otherwise(F.concat(doc, F.lit("# Section : "), F.coalesce("symbol_name", F.lit(""))))
    )
    return table(spark, d, "code_chunks").select("chunk_id", head.alias("header")).distinct()


# ---------------------------------------------------------------- splitting

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(12288) || chr(133)"


@query(
    "fixed_split",
    f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)::int AS part, count(*) OVER (PARTITION BY doc_id)::int AS n_parts, piece FROM (SELECT doc_id, s, trim(substr(text, s::int, 1700), {_WS}) AS piece FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 1700)) AS s FROM documents WHERE text IS NOT NULL)) WHERE piece <> ''",
)
def fixed_split(spark, d):
    """Fixed-width pieces with part numbers."""
    pieces = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.fixed_pieces(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.size("p").alias("n_parts"), F.posexplode("p").alias("part", "piece")).withColumn("part", F.col("part") + 1)


@query(
    "para_pack",
    f"""WITH RECURSIVE p AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, para FROM (
        SELECT doc_id, i, trim(ps[i], {_WS}) AS para FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
          SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n+') AS ps FROM documents WHERE length(text) > 1700))) WHERE para <> ''),
    f AS (SELECT doc_id, k, length(para) AS cur, CASE WHEN length(para) > 1700 THEN 0 ELSE length(para) END AS size, 1 AS piece FROM p WHERE k = 1
      UNION ALL
      SELECT p.doc_id, p.k, length(p.para),
        CASE WHEN f.size > 0 AND f.size + 2 + length(p.para) <= 1700 THEN f.size + 2 + length(p.para) WHEN length(p.para) > 1700 THEN 0 ELSE length(p.para) END,
        CASE WHEN f.size > 0 AND f.size + 2 + length(p.para) <= 1700 THEN f.piece ELSE f.piece + 1 END
      FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
    packed AS (SELECT doc_id, piece, sum(cur) + 2 * (count(*) - 1) AS n, max(cur) AS most FROM f GROUP BY doc_id, piece),
    cut AS (SELECT doc_id, n FROM packed WHERE most <= 1700
      UNION ALL SELECT doc_id, length(trim(substr(para, s::int, 1700), {_WS})) FROM (SELECT doc_id, para, unnest(range(1, length(para) + 1, 1700)) AS s FROM p WHERE length(para) > 1700))
    SELECT doc_id, count(*)::bigint AS n_pieces, sum(n)::bigint AS n_chars FROM cut WHERE n >= 100 GROUP BY doc_id""",
)
def para_pack(spark, d):
    """Number and total size of the packed pieces of each text over 1700 characters."""
    t = table(spark, d, "documents").where(F.length("text") > C.MAX_CHUNK_CHARS)
    pieces = t.select("doc_id", F.explode(X.packed_paragraphs(F.col("text"))).alias("p"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.length("p")).cast("bigint").alias("n_chars"))


@query(
    "md_sections",
    f"""WITH s AS (SELECT doc_id, title, regexp_split_to_array(text, '(?m)^#{{1,3}} .+$') AS bodies, regexp_extract_all(text, '(?m)^(#{{1,3}}) .+$', 1) AS marks, regexp_extract_all(text, '(?m)^#{{1,3}} (.+)$', 1) AS heads FROM (SELECT doc_id, title, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL)),
    r AS (SELECT doc_id, i, CASE WHEN i = 1 THEN coalesce(title, '') ELSE trim(heads[i - 1], {_WS}) END AS section, CASE WHEN i > len(heads) THEN 1 ELSE length(marks[i]) END AS level, length(trim(bodies[i], {_WS})) AS n FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM s))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::int AS ordinal, section, level::int AS level, n::int AS n_chars FROM r WHERE n >= 100""",
)
def md_sections(spark, d):
    """C20/C21/W5 in SQL functions over all documents: sections with the level of the next heading."""
    return markdown_sections(table(spark, d, "documents"))


def markdown_sections(docs):
    """Sections of ``doc_id, title, text``; line ends are read as the chunker reads them."""
    g = docs.where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    head = r"(?md)^(#{1,3}) (.+)$"
    s = g.select("doc_id", "title", F.split("text", r"(?md)^#{1,3} .+$").alias("bodies"), F.regexp_extract_all("text", F.lit(head), 1).alias("marks"), F.regexp_extract_all("text", F.lit(head), 2).alias("heads"))
    r = s.select("*", F.posexplode("bodies").alias("i", "body")).select(
        "doc_id",
        "i",
        F.when(F.col("i") == 0, F.coalesce("title", F.lit(""))).otherwise(X.stripped(F.expr("get(heads, i - 1)"))).alias("section"),
        F.when(F.col("i") >= F.size("heads"), 1).otherwise(F.length(F.expr("get(marks, i)"))).alias("level"),
        F.length(X.stripped(F.col("body"))).alias("n_chars"),
    )
    w = W.partitionBy("doc_id").orderBy("i")
    return r.where(F.col("n_chars") >= C.MIN_SECTION_CHARS).select("doc_id", F.row_number().over(w).alias("ordinal"), "section", "level", "n_chars")


_TOC = "(SELECT DISTINCT file_path, page_start, symbol_name, level FROM code_chunks WHERE chunk_type = 'section' AND page_start IS NOT NULL)"


@query(
    "toc_ranges",
    f"SELECT file_path, symbol_name, page_start, coalesce(lead(page_start) OVER w - 1, max(page_start) OVER (PARTITION BY file_path))::int AS page_end FROM {_TOC} WINDOW w AS (PARTITION BY file_path ORDER BY page_start, symbol_name)",
)
def toc_ranges(spark, d):
    """Each entry of a contents table runs to the page before the next."""
    t = table(spark, d, "code_chunks").where("chunk_type = 'section' AND page_start IS NOT NULL").select("file_path", "page_start", "symbol_name", "level").distinct()
    w = W.partitionBy("file_path").orderBy("page_start", "symbol_name")
    last = F.max("page_start").over(W.partitionBy("file_path"))
    return t.select("file_path", "symbol_name", "page_start", F.coalesce(F.lead("page_start").over(w) - 1, last).cast("int").alias("page_end"))


@query("page_fallback", f"SELECT doc_id, 'Page ' || i AS symbol_name, length(trim(p[i], {_WS}))::int AS n_chars FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE length(trim(p[i], {_WS})) >= 100")
def page_fallback(spark, d):
    """Without contents table every page of at least 100 characters is a chunk."""
    p = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "page"))
    n = F.length(X.stripped(F.col("page")))
    return p.where(n >= C.MIN_SECTION_CHARS).select("doc_id", F.concat(F.lit("Page "), F.col("i") + 1).alias("symbol_name"), n.alias("n_chars"))


@query("page_join", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10) || chr(10)) AS joined FROM documents WHERE text IS NOT NULL")
def page_join(spark, d):
    """C17: pages two to three joined, the upper bound clamped."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n\n").alias("joined"))


# ---------------------------------------------------------------- store


@query(
    "upsert_plan",
    "SELECT file_path, file_hash, CASE WHEN max((s.file_hash_s = f.file_hash)::int) = 1 THEN 'cached' WHEN count(s.file_hash_s) > 0 THEN 'modified' ELSE 'new' END AS action FROM (SELECT DISTINCT path AS file_path, file_hash FROM files WHERE path IS NOT NULL) f LEFT JOIN (SELECT DISTINCT file_path AS fp, file_hash AS file_hash_s FROM file_hashes) s ON s.fp = f.file_path GROUP BY file_path, file_hash",
)
def upsert_plan(spark, d):
    """Which files are cached, modified or new."""
    return upsert.upsert_plan(table(spark, d, "files"), table(spark, d, "file_hashes"))


@query("upsert_dedup", "SELECT chunk_id, max(indexed_at) AS indexed_at, max(file_path) AS file_path FROM code_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def upsert_dedup(spark, d):
    """K2: the last write of each chunk id."""
    return upsert.latest_per_key(table(spark, d, "code_chunks").select("chunk_id", "indexed_at", "file_path"), "chunk_id", "indexed_at", "file_path")


@query("embed_complete", "SELECT substr(sha256(file_path), 1, 16) AS file_id, file_path, file_hash FROM code_chunks WHERE file_path IS NOT NULL GROUP BY file_path, file_hash HAVING count(*) = count(CASE WHEN len(embeddings) > 0 THEN 1 END)")
def embed_complete(spark, d):
    """K3/L4: hashes only of files all of whose chunks are embedded."""
    return upsert.complete_hashes(table(spark, d, "code_chunks").select("file_path", "file_hash", "embeddings"))


@query("delete_file", "SELECT file_path, count(DISTINCT chunk_id)::bigint AS n_chunks FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM deleted_files x WHERE x.file_path = c.file_path) GROUP BY file_path")
def delete_file(spark, d):
    """K5/K6: rows left after the deleted files are gone."""
    gone = table(spark, d, "deleted_files").select("file_path").distinct()
    return table(spark, d, "code_chunks").select("file_path", "chunk_id").join(gone, "file_path", "left_anti").groupBy("file_path").agg(F.countDistinct("chunk_id").alias("n_chunks"))


@query("store_stats", "SELECT count(DISTINCT chunk_id)::bigint AS total_chunks, (SELECT count(DISTINCT file_path) FROM file_hashes)::bigint AS total_files_indexed FROM code_chunks")
def store_stats(spark, d):
    """A6/P8."""
    chunks = table(spark, d, "code_chunks").agg(F.countDistinct("chunk_id").alias("total_chunks"))
    return chunks.join(F.broadcast(table(spark, d, "file_hashes").agg(F.countDistinct("file_path").alias("total_files_indexed"))))


@query(
    "index_report",
    "SELECT f.directory, files_found::bigint AS files_found, coalesce(files_indexed, 0)::bigint AS files_indexed, coalesce(files_failed, 0)::bigint AS files_failed, (files_found - coalesce(files_indexed, 0) - coalesce(files_failed, 0))::bigint AS files_cached, coalesce(g, 0)::bigint AS chunks_generated, coalesce(e, 0)::bigint AS chunks_embedded FROM (SELECT directory, count(*) AS files_found FROM files WHERE directory IS NOT NULL GROUP BY directory) f LEFT JOIN (SELECT directory, count(DISTINCT file_path) AS files_indexed, count(*) AS g, count(CASE WHEN len(embeddings) > 0 THEN 1 END) AS e FROM code_chunks GROUP BY directory) c ON c.directory = f.directory LEFT JOIN (SELECT directory, count(DISTINCT x) AS files_failed FROM (SELECT directory, unnest(failed_files) AS x FROM index_report) WHERE trim(x) <> '' GROUP BY directory) r ON r.directory = f.directory",
)
def index_report(spark, d):
    """A1-A4: counters per directory, with the files that runs named as failed."""
    files = table(spark, d, "files").where("directory IS NOT NULL").select("directory", "path")
    return upsert.index_report(files, table(spark, d, "code_chunks").select("directory", "file_path", "embeddings"), table(spark, d, "index_report").select("directory", "failed_files"))


@query("dispatch", f"SELECT kind, count(*)::bigint AS n FROM (SELECT CASE WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.md', '.rst') THEN 'markdown' WHEN e = '.proto' THEN 'proto' WHEN e = '.py' THEN 'python' WHEN e IN {_IN(C.CODE_EXTENSIONS)} THEN 'cpp' ELSE 'none' END AS kind FROM (SELECT {_EXT_SQL} AS e FROM files)) GROUP BY kind")
def dispatch(spark, d):
    """Which chunker each file goes to."""
    e = X.extension(F.col("relative_path"))
    kind = F.when(e == ".pdf", "pdf").when(e.isin(".md", ".rst"), "markdown").when(e == ".proto", "proto").when(e == ".py", "python").when(e.isin(*C.CODE_EXTENSIONS), "cpp").otherwise("none")
    return table(spark, d, "files").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _source_files(spark, d, *extensions):
    """The selected files of some extensions, one row a path."""
    f = table(spark, d, "files").select("path", "relative_path", "ext", "content", "file_hash").where(X.selected_file(F.col("relative_path")))
    if extensions:
        f = f.where(X.extension(F.col("path")).isin(*extensions))
    return upsert.latest_per_key(f, "path", "file_hash", "ext")


def _chunks_of(spark, d, *extensions):
    from chunkloom.chunking.dispatch import chunk_files as run

    return run(_source_files(spark, d, *extensions))


_FILE_LINES = """f AS (SELECT path, any_value(relative_path) AS rel, any_value({text}) AS text FROM files WHERE path IS NOT NULL AND lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN {ext} AND {selected} GROUP BY path),
    l AS (SELECT path, rel, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, rel, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM f WHERE text <> '')))"""
_DECODED = "regexp_replace(regexp_replace(TRY(decode(content)), '^﻿', ''), '\\r\\n?', chr(10), 'g')"


@query(
    "proto_chunks",
    f"""WITH RECURSIVE {_FILE_LINES.format(text=_DECODED, ext="('.proto')", selected=_SELECTED)},
    c AS (SELECT *, sum(2 * length(line) - length(replace(line, '{{', '')) - length(line) - length(line) + length(replace(line, '}}', ''))) OVER (PARTITION BY path ORDER BY i) AS depth, count(*) OVER (PARTITION BY path) AS n, regexp_extract(line, '^\\s*(message|service|enum)\\s+(\\w+)\\s*\\{{', 1) AS kind, regexp_extract(line, '^\\s*(message|service|enum)\\s+(\\w+)\\s*\\{{', 2) AS name FROM l),
    o AS (SELECT a.path, a.i, a.kind, a.name, coalesce(min(b.i), any_value(a.n) + 1) AS last FROM (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY i), 0) AS base FROM c) a LEFT JOIN c b ON b.path = a.path AND b.i >= a.i AND b.depth = a.base WHERE a.kind <> '' GROUP BY a.path, a.i, a.kind, a.name),
    s AS (SELECT a.*, min(b.i) AS next FROM o a LEFT JOIN o b ON b.path = a.path AND b.i > a.last GROUP BY ALL),
    r AS (SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) = 1) UNION ALL SELECT s.* FROM r JOIN s ON s.path = r.path AND s.i = r.next),
    x AS (SELECT path, string_agg(line, chr(10) ORDER BY i) AS context FROM l WHERE regexp_matches(trim(line, {_WS}), '^(syntax|package|import|option)') GROUP BY path),
    t AS (SELECT r.path, r.kind, r.name, r.i, r.last, any_value(l.rel) AS rel, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM r JOIN l ON l.path = r.path AND l.i BETWEEN r.i AND r.last WHERE r.last - r.i >= 2 GROUP BY ALL)
    SELECT t.path AS file_path, name AS symbol_name, kind AS chunk_type, i::int AS start_line, last::int AS end_line,
    array_to_string(list_sort(list_distinct(CASE kind WHEN 'service' THEN list_concat(regexp_extract_all(body, '{_RPC}', 1), regexp_extract_all(body, '{_RPC}', 2)) WHEN 'message' THEN regexp_extract_all(body, '(?:repeated|map\\s*<\\w+\\s*,\\s*)?\\s*([A-Z]\\w+)\\s+\\w+\\s*=\\s*\\d+', 1) ELSE [] END)), '|') AS refs,
    sha256('// File: ' || rel || chr(10) || CASE WHEN context IS NULL THEN chr(10) ELSE context || chr(10) || chr(10) END || body) AS content_hash FROM t LEFT JOIN x ON x.path = t.path""",
)
def proto_chunks(spark, d):
    """Blocks of every .proto file with context, lines and references."""
    c = _chunks_of(spark, d, ".proto").where("error IS NULL")
    return c.select("file_path", "symbol_name", "chunk_type", "start_line", "end_line", F.array_join("symbols_referenced", "|").alias("refs"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query(
    "md_chunks",
    f"""WITH f AS (SELECT path, any_value(relative_path) AS rel, any_value({_DECODED}) AS text FROM files WHERE path IS NOT NULL AND lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.md', '.rst') AND {_SELECTED} GROUP BY path),
    s AS (SELECT path, rel, regexp_split_to_array(text, '(?m)^#{{1,3}} .+$') AS bodies, regexp_extract_all(text, '(?m)^(#{{1,3}}) .+$', 1) AS marks, regexp_extract_all(text, '(?m)^#{{1,3}} (.+)$', 1) AS heads FROM f),
    r AS (SELECT path, rel, i, CASE WHEN i = 1 THEN regexp_replace(split_part(rel, '/', -1), '\\.[^.]*$', '') ELSE trim(regexp_replace(heads[i - 1], '^[# ]+', ''), {_WS}) END AS section, CASE WHEN i > len(heads) THEN 1 ELSE length(marks[i]) END AS level, trim(bodies[i], {_WS}) AS body FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM s))
    SELECT path AS file_path, section AS symbol_name, row_number() OVER (PARTITION BY path ORDER BY i)::int AS page_start, level::int AS level, regexp_extract(section, '(?i)^(?:chapitre\\s*)?(\\d+(?:\\.\\d+)*)(?:[\\.\\s:-]+.*)?$', 1) AS chapter, sha256('# Document : ' || rel || chr(10) || '# Section : ' || section || chr(10) || chr(10) || body) AS content_hash FROM r WHERE length(body) >= 100""",
)
def md_chunks(spark, d):
    """Sections of every Markdown file."""
    c = _chunks_of(spark, d, *C.MARKDOWN_EXTENSIONS).where("error IS NULL")
    return c.select("file_path", "symbol_name", "page_start", "level", "chapter", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query("python_chunks", outline_sql.PYTHON.replace("@SELECTED@", _SELECTED))
def python_chunks(spark, d):
    """C3-C6, C8 filter, F8: classes, methods and functions of every Python file with their lines."""
    c = _chunks_of(spark, d, ".py").where("error IS NULL")
    return c.select("file_path", "symbol_name", "chunk_type", "start_line", "end_line")


@query("chunk_files")
def chunk_files(spark, d):
    """Every chunk of every file; checked against fixtures, SQL cannot parse source files."""
    return _chunks_of(spark, d)


# ---------------------------------------------------------------- symbols, expansion

_ORD = "file_path, start_line, chunk_id"
_CHUNKS = "(SELECT DISTINCT chunk_id, file_path, start_line, symbol_name, symbols_referenced FROM code_chunks)"
_SYM = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_name ORDER BY {_ORD}) AS lookup_rank FROM {_CHUNKS} WHERE symbol_name IS NOT NULL) WHERE lookup_rank <= 3)"


def _distinct_chunks(spark, d):
    return table(spark, d, "code_chunks").select("chunk_id", "file_path", "start_line", "symbol_name", "symbols_referenced").distinct()


@query("symbol_lookup", f"SELECT s.symbol_name, s.chunk_id, s.lookup_rank::int AS lookup_rank, 0.5::double AS distance FROM {_SYM} s WHERE s.symbol_name IN (SELECT unnest(symbols_referenced) FROM code_chunks)")
def symbol_lookup(spark, d):
    """V5 for every referenced symbol at once."""
    refs = table(spark, d, "code_chunks").select(F.explode("symbols_referenced").alias("symbol_name"))
    return expand.lookup_symbols(_distinct_chunks(spark, d), refs).select("symbol_name", "chunk_id", "lookup_rank", "distance")


_SEEDS = "(SELECT DISTINCT chunk_id, file_path, start_line, symbol_name, symbols_referenced, chunk_id AS pos FROM code_chunks WHERE chunk_type = 'class')"


def _level(n: int) -> str:
    prev = f"l{n - 1}"
    return f"""e{n} AS (SELECT pos AS from_pos, i - 1 AS ref_pos, symbols_referenced[i] AS sym FROM (SELECT pos, symbols_referenced, unnest(range(1, len(symbols_referenced) + 1)) AS i FROM {prev})),
    f{n} AS (SELECT s.*, format('{{}}.{{:05d}}.{{}}', from_pos, ref_pos, lookup_rank) AS pos FROM e{n} JOIN sym s ON s.symbol_name = e{n}.sym WHERE sym <> ''),
    g{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line ORDER BY pos) AS n FROM f{n}) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM (
      {' UNION ALL '.join(f'SELECT file_path, start_line FROM l{k}' for k in range(n))}) y WHERE y.file_path = x.file_path AND y.start_line = x.start_line)),
    l{n} AS (SELECT chunk_id, file_path, start_line, symbol_name, symbols_referenced, pos, {n} AS depth FROM g{n})"""


def _expand_sql(depth: int) -> str:
    levels = ",\n    ".join(_level(n) for n in range(1, depth + 1))
    out = " UNION ALL ".join(f"SELECT chunk_id, pos, depth::int AS depth FROM l{k}" for k in range(depth + 1))
    return f"WITH sym AS {_SYM}, l0 AS (SELECT chunk_id, file_path, start_line, symbol_name, symbols_referenced, pos, 0 AS depth FROM {_SEEDS}),\n    {levels}\n    {out}"


def _expand(spark, d, depth):
    chunks = _distinct_chunks(spark, d)
    seeds = table(spark, d, "code_chunks").where("chunk_type = 'class'").select(*chunks.columns).distinct()
    seeds = seeds.select("*", F.col("chunk_id").alias("pos"), F.lit(0.1).alias("distance"))
    return expand.expand_dependencies(chunks, seeds, depth).select("chunk_id", "pos", "depth")


@query("dep_expand_1", _expand_sql(1))
def dep_expand_1(spark, d):
    """J1/J3, one level from every class."""
    return _expand(spark, d, 1)


@query("dep_expand_2", _expand_sql(2))
def dep_expand_2(spark, d):
    """J1/J3, two levels."""
    return _expand(spark, d, 2)


# ---------------------------------------------------------------- context and prompts

_DOC_HITS = "(SELECT source AS question_id, doc_id AS pos, (doc_id % 97) / 97.0::double AS distance, lang AS language, title AS symbol_name, '' AS chapter, source AS relative_path, 1 AS start_line, 2 AS end_line, text AS content FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"
_HEADER = "chr(10) || '--- [' || upper(coalesce(language, '')) || '] ' || coalesce(symbol_name, '') || CASE WHEN chapter <> '' THEN ' Chapitre ' || chapter ELSE '' END || ' | ' || relative_path || ' L' || start_line || '–' || end_line || ' ---' || chr(10)"


def _doc_hits(spark, d):
    t = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    return t.select(
        F.col("source").alias("question_id"),
        F.col("doc_id").alias("pos"),
        ((F.col("doc_id") % 97) / F.lit(97.0)).alias("distance"),
        F.col("lang").alias("language"),
        F.col("title").alias("symbol_name"),
        F.lit("").alias("chapter"),
        F.col("source").alias("relative_path"),
        F.lit(1).alias("start_line"),
        F.lit(2).alias("end_line"),
        F.col("text").alias("content"),
    )


@query("context_blocks", f"SELECT pos, {_HEADER} AS header, length({_HEADER} || content)::bigint AS n FROM {_DOC_HITS}")
def context_blocks(spark, d):
    """L1: block headers."""
    return ctx.with_blocks(_doc_hits(spark, d)).select("pos", "header", F.length("block").cast("bigint").alias("n"))


_BUDGET = f"""SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, pos)::int AS rank FROM (SELECT question_id, pos, distance, cum <= 14000 AS fits, 14000 - (cum - n) AS room, n, hn, block FROM (SELECT *, max((cum > 14000)::int) OVER (PARTITION BY question_id ORDER BY distance, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT *, sum(n) OVER (PARTITION BY question_id ORDER BY distance, pos ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, length(block) AS n FROM (SELECT *, {_HEADER} || content AS block, length({_HEADER}) AS hn FROM {_DOC_HITS}))))
 WHERE cum <= 14000 OR (coalesce(prior, 0) = 0 AND 14000 - (cum - n) > hn + 100))"""


@query("context_budget", f"SELECT question_id, pos, rank, (NOT fits) AS truncated, (CASE WHEN fits THEN n ELSE room + length(chr(10) || '[... tronqué ...]') END)::bigint AS n_chars FROM ({_BUDGET})")
def context_budget(spark, d):
    """Blocks per question within 14000 characters."""
    kept = ctx.within_budget(ctx.with_blocks(_doc_hits(spark, d)), 14_000, "question_id")
    return kept.select("question_id", "pos", "rank", "truncated", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "prompt_build",
    f"""WITH q AS (SELECT DISTINCT source AS question_id, 'Que fait ' || source || '?' AS question FROM documents WHERE source IS NOT NULL UNION ALL SELECT '-', 'Rien?'),
    c AS (SELECT question_id, string_agg(CASE WHEN fits THEN block ELSE substr(block, 1, room::int) || chr(10) || '[... tronqué ...]' END, chr(10) ORDER BY rank) AS context FROM ({_BUDGET}) GROUP BY question_id),
    n AS (SELECT question_id, count(*) AS n FROM {_DOC_HITS} GROUP BY question_id)
    SELECT q.question_id, sha256(CASE WHEN n.n IS NULL THEN 'Question : ' || question || '{_SQL(ctx.NO_CONTEXT)}' ELSE '{_SQL(ctx.INSTRUCTION)}' || coalesce(context, '') || '{_SQL(ctx.SEPARATOR)}' || 'Question : ' || question || '{_SQL(ctx.CLOSING)}' END) AS prompt_hash, coalesce(n.n, 0)::bigint AS n_chunks FROM q LEFT JOIN c ON c.question_id = q.question_id LEFT JOIN n ON n.question_id = q.question_id""",
)
def prompt_build(spark, d):
    """L2: prompts of all questions at once, compared by hash."""
    hits = _doc_hits(spark, d)
    q = hits.select("question_id").distinct().unionByName(table(spark, d, "documents").where("source IS NOT NULL AND text IS NULL").select(F.col("source").alias("question_id"))).distinct()
    q = q.select("question_id", F.concat(F.lit("Que fait "), "question_id", F.lit("?")).alias("question"))
    q = q.unionByName(spark.createDataFrame([("-", "Rien?")], "question_id string, question string"))
    return ctx.prompts(q, hits, 14_000).select("question_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), "n_chunks")


@query(
    "history_window",
    "SELECT event_id, coalesce(string_agg('Q: ' || coalesce(event_type, '') || chr(10) || 'R: ' || coalesce(props, '') || chr(10) || chr(10), '' ORDER BY event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM events ",
)
def history_window(spark, d):
    """The five turns before each turn."""
    return ctx.history_window(table(spark, d, "events"), "user_id", "event_id", "event_type", "props").select("event_id", "history")


# ---------------------------------------------------------------- orphan references

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288)"
_ORPHANS = f"""WITH life AS (SELECT c.*, NOT coalesce(x.deleted_at >= c.last_at, false) AS live FROM (SELECT chunk_id, min(indexed_at) AS arrived_at, max(indexed_at) AS last_at, max(file_path) AS file_path, max(symbol_name) AS symbol_name, max(symbols_referenced) AS symbols_referenced FROM code_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id) c LEFT JOIN (SELECT file_path, max(deleted_at) AS deleted_at FROM deleted_files GROUP BY file_path) x ON x.file_path = c.file_path),
    refs AS (SELECT DISTINCT chunk_id, arrived_at, trim(s, {_TRIM}) AS symbol FROM (SELECT chunk_id, arrived_at, unnest(symbols_referenced) AS s FROM life WHERE live) WHERE trim(s, {_TRIM}) <> ''),
    names AS (SELECT symbol_name, max(live) AS any_live, min(CASE WHEN live THEN arrived_at END) AS first_live FROM life WHERE symbol_name IS NOT NULL GROUP BY symbol_name),
    o AS (SELECT r.*, CASE WHEN n.symbol_name IS NULL THEN 'missing' WHEN NOT n.any_live THEN 'deleted' WHEN n.first_live > r.arrived_at THEN 'late' END AS reason FROM refs r LEFT JOIN names n ON n.symbol_name = r.symbol WHERE r.symbol NOT IN (SELECT symbol_name FROM external_symbols WHERE symbol_name IS NOT NULL))"""


def _orphans(spark, d):
    return orphans.orphan_references(table(spark, d, "code_chunks"), table(spark, d, "deleted_files"), table(spark, d, "external_symbols"))


@query("p4_found", _ORPHANS + " SELECT chunk_id, symbol, reason FROM o WHERE reason IS NOT NULL")
def p4_found(spark, d):
    """Problem 4: references of live chunks that no live chunk answered when they arrived."""
    return _orphans(spark, d).select("chunk_id", "symbol", "reason")


@query("p4_by_month", _ORPHANS + " SELECT 'code_chunks' AS table_name, strftime(arrived_at, '%Y-%m') AS month, reason, count(*)::bigint AS n_refs, count(DISTINCT symbol)::bigint AS n_symbols FROM o WHERE reason IS NOT NULL GROUP BY ALL")
def p4_by_month(spark, d):
    """Problem 4: orphan references per table, month of arrival and reason."""
    return orphans.orphans_by_period(_orphans(spark, d), "code_chunks")
