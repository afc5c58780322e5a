"""Column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom import config as C


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ``:``; null if any part is null."""
    text = F.concat(*(x for p in parts for x in (F.lit(":"), p.cast("string"))))
    return F.substring(F.sha2(F.substring(text, 2, 2_000_000_000).cast("binary"), 256), 1, 16)


def file_id(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def selected_file(relative_path: Column) -> Column:
    """The scan predicate: extension, file name, excluded folders anywhere, excluded root folders."""
    parts = F.split(relative_path, "/")
    return (
        extension(relative_path).isin(*C.ALL_EXTENSIONS)
        & ~F.lower(file_name(relative_path)).isin(*C.EXCLUDED_FILENAMES)
        & ~F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, C.EXCLUDED_DIRS)))
        & ~F.element_at(parts, 1).isin(*C.EXCLUDED_ROOT_DIRS)
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text: bad bytes replaced, byte order mark dropped, line ends as ``\\n``."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
    return F.regexp_replace(text, "\r\n?", "\n")


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(c: Column) -> Column:
    """Lines without the empty one that a final line end would add."""
    return F.split(F.regexp_replace(c, r"\n\z", ""), "\n")


def line_slice(c: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), start, end - start + 1), "\n")


def worth_chunking(source: Column) -> Column:
    """3 to 10,000 lines, more than a tenth of them neither blank nor beginning with ``#``."""
    lines = lines_of(source)
    code = F.filter(lines, lambda x: F.trim(x).rlike(r"^[^#\s]"))
    return F.size(lines).between(C.MIN_CODE_LINES, C.MAX_CODE_LINES) & (F.size(code) / F.size(lines) > C.MIN_CODE_DENSITY)


def python_header_stripped(source: Column) -> Column:
    """Without the leading blank and ``#`` lines."""
    return F.regexp_replace(source, r"\A(?:[ \t]*(?:#[^\n]*)?\n)+", "")


def title_chapter(title: Column) -> Column:
    return F.regexp_extract(stripped(title), "(?i)" + C.CHAPTER_TITLE, 1)


def question_chapter(question: Column) -> Column:
    return F.regexp_extract(question, "(?i)" + C.CHAPTER_QUESTION, 1)


def proto_references(content: Column, kind: Column) -> Column:
    """Types that a proto block names; see ``chunking.proto.references``."""
    rpc = r"rpc\s+\w+\s*\(\s*(\w+)\s*\)\s*returns\s*\(\s*(\w+)\s*\)"
    service = F.concat(F.regexp_extract_all(content, F.lit(rpc), 1), F.regexp_extract_all(content, F.lit(rpc), 2))
    message = F.regexp_extract_all(content, F.lit(r"([A-Z]\w+)\s+\w+\s*=\s*\d+"), 1)
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.when(kind == "service", service).when(kind == "message", message).otherwise(none)))


def fixed_pieces(text: Column, width: int = C.MAX_CHUNK_CHARS) -> Column:
    """Consecutive pieces of ``width`` characters, trimmed, without empty ones."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: stripped(F.substring(text, s, F.lit(width)))), lambda x: x != "")


def packed_paragraphs(text: Column, width: int = C.MAX_CHUNK_CHARS, least: int = C.MIN_SECTION_CHARS) -> Column:
    """Greedy packing of paragraphs, as one fold over the paragraph array (see ``chunking.text``)."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), stripped), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] != "") & (F.length(acc["cur"]) + 2 + F.length(p) <= width)
        flushed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        return (
            F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit("\n\n"), p).alias("cur")))
            .when(F.length(p) > width, F.struct(F.concat(flushed, fixed_pieces(p, width)).alias("done"), F.lit("").alias("cur")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("cur")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))

    packed = F.filter(F.aggregate(paragraphs, start, step, finish), lambda x: F.length(x) >= least)
    return F.when(F.length(text) <= width, F.array(text)).otherwise(packed)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus cosine similarity; null if the sizes differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.lit(1.0) - dot(a, b) / norms)
