"""Source files that nobody wrote by hand in their repository.

* Vendored copies: an inverted index of line hashes; each line weighs its rarity, -log2 of the share of
  files that have it, so common lines prove little.  Files with equal line sets are one class, settled at
  once if it spans two repositories.  Then every line names the two first files (of different repositories)
  that have it, files vote for them with their lines' weights, and for the few that win a quarter of a file's
  weight the exact weighted containment is computed: copies of a group meet at its first members without
  pairs within the group.  Files that this does not settle go the exact way: a source that holds
  ``CONTAINED`` of a file's weight (``CONTAINED_MARKED`` if its head names another party) holds one of any
  lines that weigh more than the rest, so all owners of the
  file's rarest lines of that weight are compared.  Two owners of a class stand for all of it.
* Generated, minified and data files: rules on banners in the head comment and on token composition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkloom.functions.columns import extension
from chunkloom.operators.orphans import salted_join
from chunkloom.session import cut_lineage, spread

EXTENSIONS = (".py", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".proto")
#: Characters of a line that is worth indexing, after white space is folded.
LEAST_LINE = 12
#: Share of a file's weight that its vote for another file needs, and that must then stand in that file.
VOTE_SHARE = 0.25
CONTAINED = 0.6
#: The same for a file whose head names another party's licence or library, which alone proves nothing.
CONTAINED_MARKED = 0.3
#: Distinct lines a file needs for a verdict on copying.
LEAST_LINES = 6
#: A line in more than one file of so many is joined by broadcast: there are at most this number times the
#: mean number of lines of a file of them, whatever the size of the corpus.
HOT_SHARE = 1024

# Banners of tools, and phrases that turn a banner they govern into talk about tools.
BANNER = re.compile(
    r"@generated\b|auto-?\s?generated|code generated|machine[- ]generated|automatically generated|generated (?:automatically|by|from|with|file|code)|this file (?:is|was) generated|do not (?:edit|modify)(?=\W*$|\s*[^\w\s\"'`]|\s+(?:this|these|it|by|manually|directly|below|above|or|if|when|the (?:file|contents?|generated|output))\b)|"
    r"auto(?:matically)? created from|output of [\w.-]+(?:compiler|generator|gen|tool)\b|produced by .* from |(?:manual )?changes? (?:is|are|will be) (?:overwritten|lost)|nicht von hand|"
    r"produit automatiquement|généré automatiquement|ne pas (?:éditer|modifier)|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|ändern)|generado (?:automáticamente|por)|no (?:editar|modificar)|自动生成|自動生成|сгенерирован",
    re.I,
)
_BANNER_NOUN = r"(?:do not (?:edit|modify)|@generated|(?:auto-?\s?|machine-|code )?generated)"
NOT_BANNER = re.compile(
    # not so, or not so any more
    r"(?:\b(?:not|never|non|nicht)|n't) (?:been |be )?(?:auto-?\s?|machine-|automatically )?(?:generated|généré|generiert|erzeugt)\b(?:[^.;]|\.\w)*|"
    r"\b(?:no longer|formerly|used to be|inspired by|draft)\b(?:[^.;]|\.\w)*|\bonce (?:auto-?\s?)?generated\b(?:[^.;]|\.\w)*|generated\b(?:[^.;]|\.\w)*?(?:\bonce\b|,? (?:but|then|since|now)\b(?:[^.;]|\.\w)*(?:by hand|maintained|written|edited|edit freely))(?:[^.;]|\.\w)*|"
    # a condition of the edit, or of what is told
    r"do not (?:edit|modify)(?: [\w']+){0,4} (?:if|when|unless|without|while)\b(?:[^.;]|\.\w)*|\b(?:if|when|whether)\b(?:[^.;,]|\.\w)*|"
    # the banner as a thing
    rf"\b(?:carry|carries|writes?|looks? for|detects?|skips?|checks? (?:for|that|whether)|hand-?written|rewritten)\b(?:[^.;]|\.\w)*?{_BANNER_NOUN}(?:[^.;]|\.\w)*|{_BANNER_NOUN}[\"'`]* (?:banners?|markers?|notices?)\b",
    re.I,
)
THIRD_PARTY = re.compile(r"^(?:this (?:file|code|module|source|header) is )?part of the [\w.+-]+ library\b|\bredistribution in source\b|copyright (?:\(c\)|©) [\d, -]+ the [\w.+-]+ (?:authors|contributors|project)", re.I)
_COMMENT_LINE = re.compile(r"^\s*(?:#(?!\s*(?:include|pragma|define|if|ifdef|ifndef|endif|else|elif|undef|error|line)\b)|//|/\*|\*)")
_DOCSTRING = re.compile(r"\s*[rRuU]?(\"\"\"|''')")
_MARKS = " \t#/*!"
_TOKEN = re.compile(r"(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<num>\b\d[\w.]*)|(?P<id>[^\W\d]\w*)")
_BLOCK_COMMENT = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_PLUMBING = re.compile(r"^\s*(?:import|from|#\s*(?:include|pragma|define|if|ifdef|ifndef|endif)|package|syntax|using|option|namespace)\b.*$", re.M)
_WORDS = frozenset("if else for while return in is not and or int char lambda def class const static auto void range None True False unsigned long short float double bool struct public private string".split())
#: Characters of literals that a data file holds at least, and their least share of its solid characters.
DATA_CHARS = 500
DATA_SHARE = 0.7
#: Times that a line's shape (its values masked) recurs in a table that a tool wrote, and the share of the
#: lines of such shapes.
SHAPE_LINES = 12
SHAPE_SHARE = 0.7
_VALUE = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|0[xX][\da-fA-F]+|\d[\d.]*")
#: Characters of a line that is long, blanks in it, and share of one- and two-letter names of minified code.
LONG_LINE = 120
BLANK_SHARE = 0.2
SHORT_NAMES = 0.5


def decode(content: bytes | None) -> str:
    return bytes(content or b"").decode("utf-8", errors="replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def head_comment(text: str) -> list[str]:
    """Lines of the comments and of the module docstring before the first definition, without their marks.

    Imports and the like may stand between them; a block comment or docstring is read up to its end.
    """
    out = []
    end = None  # what closes the open block
    for line in text.split("\n"):
        if end is None:
            if not line.strip() or _PLUMBING.match(line):
                continue
            if m := _DOCSTRING.match(line):
                end, line = m[1], line[m.end() :]
            elif not _COMMENT_LINE.match(line):
                break
            elif line.lstrip().startswith("/*"):
                end, line = "*/", line.lstrip()[2:]
        if end is not None and end in line:
            line, rest = line.split(end, 1)
            end = None
            if rest.strip() and not _COMMENT_LINE.match(rest):
                out.append(line.strip(_MARKS))
                break
        out.append(line.strip(_MARKS))
    return out


def is_banner(head: list[str]) -> bool:
    """Whether a head comment says that a tool wrote the file; a line that begins in lower case goes on with the last."""
    told = "".join((" " if x[:1].islower() else ". ") + x for x in head)
    return bool(BANNER.search(NOT_BANNER.sub(" ", told)))


def is_foreign(text: str) -> bool:
    """A page or another document under the extension of a source file."""
    return bool(re.match(r"\s*(?:<!doctype|<html|<\?xml|<head|<body|\{\s*\"|%PDF|---\n)", text, re.I))


def composition(text: str) -> str | None:
    """``generated``, ``minified`` or ``data`` by the rules, or None."""
    if is_foreign(text):
        return None
    head = head_comment(text)
    if is_banner(head):
        return "generated"
    lines = [x for x in text.split("\n") if x.strip() and not _COMMENT_LINE.match(x)]
    code = _PLUMBING.sub("", _BLOCK_COMMENT.sub(" ", "\n".join(lines)))
    literals = words = names = short = literal_chars = 0
    for m in _TOKEN.finditer(code):
        words += 1
        if m.lastgroup == "id":
            if m[0] not in _WORDS:
                names += 1
                short += len(m[0].rstrip("0123456789")) <= 1
        else:
            literals += 1
            literal_chars += len(m[0])
    dense = [x for x in lines if len(x) >= LONG_LINE and x.strip().count(" ") < BLANK_SHARE * len(x)]
    if dense and names and short >= SHORT_NAMES * names:
        return "minified"
    solid = len(re.sub(r"\s", "", code))
    if "=" in code and literal_chars >= DATA_CHARS and literal_chars >= DATA_SHARE * solid and literals >= 4 * (words - literals):
        return "data"
    shapes = Counter(_VALUE.sub("0", x.strip()) for x in code.split("\n") if re.search(r"\w", x))
    same = sum(n for shape, n in shapes.items() if n >= SHAPE_LINES and "0" in shape)
    if same >= SHAPE_SHARE * sum(shapes.values()) and same:
        return "generated"
    return None


def names_another_party(text: str) -> bool:
    """Whether the head comment names a licence, library or authors as copied files do, and a project's own may."""
    return not is_foreign(text) and any(THIRD_PARTY.search(x) for x in head_comment(text))


def line_hashes(text: str) -> list[int]:
    """Sorted distinct hashes of the lines worth indexing; none for foreign documents."""
    if is_foreign(text):
        return []
    folded = (" ".join(x.split()) for x in text.split("\n"))
    return sorted({xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in folded if len(x) >= LEAST_LINE})


def inspected(files: DataFrame) -> DataFrame:
    """``path, directory, reason, marked, lines`` of each source file, one row per path."""
    directory = F.coalesce(F.col("directory"), F.lit("")) if "directory" in files.columns else F.lit("")
    src = files.where(F.col("path").isNotNull() & extension(F.col("path")).isin(*EXTENSIONS)).select("path", directory.alias("directory"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([composition(t) for t in texts], pa.string()), pa.array([names_another_party(t) for t in texts], pa.bool_()), pa.array([line_hashes(t) for t in texts], pa.list_(pa.int64()))],
                names=["path", "directory", "reason", "marked", "lines"],
            )

    out = spread(src).mapInArrow(run, "path string, directory string, reason string, marked boolean, lines array<bigint>")
    w = W.partitionBy("path").orderBy(F.col("reason").asc_nulls_last(), F.size("lines").desc(), "directory")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_PAIR = "fid bigint, source bigint, marked boolean, total double, lines array<bigint>, weights array<double>"


def _least(marked: bool) -> float:
    return CONTAINED_MARKED if marked else CONTAINED


def _line_stats(rows: DataFrame, n_files: int) -> DataFrame:
    """``line, df, w, one, one_did, two, two_did``: files that have a line, its weight, its first owners in two repositories."""
    per_dir = rows.groupBy("line", "did").agg(F.count(F.lit(1)).alias("n"), F.min("fid").alias("first"))
    ranked = per_dir.withColumn("k", F.row_number().over(W.partitionBy("line").orderBy("first"))).where("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    two = ranked.groupBy("line").agg(pick(1, "first").alias("one"), pick(1, "did").alias("one_did"), pick(2, "first").alias("two"), pick(2, "did").alias("two_did"))
    spread_ = per_dir.groupBy("line").agg(F.sum("n").alias("df"))
    return cut_lineage(spread_.join(two, "line").withColumn("w", F.log2(F.lit(float(n_files)) / F.col("df") + 1)))


def _owned(files: DataFrame, rows: DataFrame, n_files: int) -> DataFrame:
    """Each file with its lines, their weights and the other repositories' first owners of each (null if none)."""
    stats = _line_stats(rows, n_files)
    hot_from = max(1000, n_files // HOT_SHARE)
    hot = stats.where(F.col("df") > hot_from)
    marked = rows.join(F.broadcast(hot.select("line", F.lit(True).alias("hot"))), "line", "left")
    cold = marked.where("hot is null").drop("hot").join(stats.where(F.col("df") <= hot_from), "line")
    weighed = cold.unionByName(marked.where("hot").drop("hot").join(F.broadcast(hot), "line"))
    one = F.when((F.col("one_did") != F.col("did")) & (F.col("df") > 1), F.col("one"))
    entry = F.struct("line", "w", one.alias("one"), F.when(F.col("two_did") != F.col("did"), F.col("two")).alias("two"))
    lists = weighed.groupBy("fid").agg(F.sum("w").alias("total"), F.sort_array(F.collect_list(entry)).alias("x"))
    parts = [F.col(f"x.{c}").alias(name) for c, name in (("line", "lines"), ("w", "weights"), ("one", "one"), ("two", "two"))]
    return cut_lineage(files.select("fid", "did", "marked").join(lists, "fid").select("fid", "did", "marked", "total", *parts))


def _lists(batch: pa.RecordBatch, *columns: str) -> Iterator[list[np.ndarray]]:
    """Rows of list columns as arrays; a null entry is -1."""
    flat = [(np.asarray(c.offsets), np.asarray(c.flatten().fill_null(-1))) for c in (batch.column(batch.schema.get_field_index(name)) for name in columns)]
    start = [o[0] for o, _ in flat]
    for k in range(len(batch)):
        yield [x[o[k] - s : o[k + 1] - s] for (o, x), s in zip(flat, start, strict=True)]


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with the sources that win ``VOTE_SHARE`` of their weight."""
    for batch in batches:
        take, sources = [], []
        for k, ((weights, one, two), total) in enumerate(zip(_lists(batch, "weights", "one", "two"), batch.column("total").to_pylist(), strict=True)):
            voted = np.concatenate([one, two])
            names, at = np.unique(voted, return_inverse=True)
            got = np.bincount(at, np.concatenate([weights, weights]), len(names))
            for source in names[(got >= VOTE_SHARE * total) & (names >= 0)]:
                take.append(k)
                sources.append(source)
        rows = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("fid"), pa.array(sources, pa.int64()), *(rows.column(c) for c in ("marked", "total", "lines", "weights"))], names=["fid", "source", "marked", "total", "lines", "weights"])


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of which the source holds enough of the file's weight."""
    for batch in batches:
        share = [float(w[np.isin(mine, theirs, assume_unique=True)].sum()) for mine, w, theirs in _lists(batch, "lines", "weights", "theirs")]
        share = np.array(share) / np.asarray(batch.column("total")) if share else np.zeros(0)
        enough = share >= np.array([_least(m) for m in batch.column("marked").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("fid"), batch.column("source"), pa.array(share, pa.float64())], names=["fid", "source", "contained"]).filter(pa.array(enough, pa.bool_()))


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest lines of each file, of which any sufficient source holds one; those that others have too."""
    for batch in batches:
        take, out = [], []
        for k, ((lines, weights, two), total, marked) in enumerate(zip(_lists(batch, "lines", "weights", "two"), batch.column("total").to_pylist(), batch.column("marked").to_pylist(), strict=True)):
            order = np.lexsort((lines, -weights))
            rest = (1 - _least(marked)) * total * (1 + 1e-9)
            n = int(np.searchsorted(np.cumsum(weights[order]), rest, side="right")) + 1
            shared = [i for i in order[:n] if two[i] >= 0]
            take += [k] * len(shared)
            out += [lines[i] for i in shared]
        rows = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("fid"), rows.column("did"), pa.array(out, pa.int64())], names=["fid", "did", "line"])


def vendored(inspected_files: DataFrame) -> DataFrame:
    """``path, source, contained``: files whose weighted lines stand in a file of another repository."""
    numbered = inspected_files.where(F.size("lines") > 0).select(F.monotonically_increasing_id().alias("fid"), F.xxhash64("directory").alias("did"), "path", "marked", "lines")
    files = cut_lineage(numbered)
    n_files = files.count()
    if not n_files:
        return files.select("path", F.col("path").alias("source"), F.lit(0.0).alias("contained"))
    own = _owned(files, files.select("fid", "did", F.explode("lines").alias("line")), n_files)
    theirs = files.select(F.col("fid").alias("source"), F.col("lines").alias("theirs"))
    result = "fid bigint, source bigint, contained double"
    long_enough = F.size("lines") >= LEAST_LINES

    likely = cut_lineage(own.where(long_enough).mapInArrow(_voted, _PAIR))
    voted = cut_lineage(salted_join(likely, theirs, "source", "fid").mapInArrow(_contained, result))

    member = F.struct("did", "fid")
    kind = [F.xxhash64("lines").alias("kind"), F.xxhash64(F.lit(1), "lines").alias("kind2")]
    members = files.select("fid", "did", F.size("lines").alias("n"), *kind)
    kinds = cut_lineage(members.groupBy("kind", "kind2").agg(F.min("n").alias("n"), F.min(member).alias("one"), F.max(member).alias("two")))
    apart = (F.col("one.did") != F.col("two.did")) & (F.col("n") >= LEAST_LINES)
    other = F.when(F.col("did") == F.col("one.did"), F.col("two.fid")).otherwise(F.col("one.fid"))
    equal = members.drop("n").join(kinds.where(apart), ["kind", "kind2"]).select("fid", other.alias("source"), F.lit(1.0).alias("contained"))

    single = kinds.where((F.col("one.did") == F.col("two.did")) & (F.col("n") >= LEAST_LINES))
    open_ = single.select(F.col("one.fid").alias("fid")).join(voted.select("fid").distinct(), "fid", "left_anti")
    unsettled = cut_lineage(own.join(open_, "fid", "left_semi"))
    wanted = unsettled.mapInArrow(_rarest, "fid bigint, did bigint, line bigint")
    reps = kinds.select(F.explode(F.array_distinct(F.array("one.fid", "two.fid"))).alias("fid"))
    owners = files.join(reps, "fid", "left_semi").select(F.col("fid").alias("source"), F.col("did").alias("home"), F.explode("lines").alias("line"))
    candidates = wanted.join(owners, "line").where(F.col("did") != F.col("home")).select("fid", "source").distinct()
    open_pairs = cut_lineage(candidates.join(unsettled.drop("did", "one", "two"), "fid"))
    exact = salted_join(open_pairs, theirs, "source", "fid").mapInArrow(_contained, result).withColumnRenamed("fid", "rep")
    members_of = members.join(single.select("kind", "kind2", F.col("one.fid").alias("rep")), ["kind", "kind2"]).select("fid", "rep")
    all_ = voted.unionByName(equal).unionByName(exact.join(members_of, "rep").select("fid", "source", "contained"))
    best = all_.groupBy("fid").agg(F.max_by("source", "contained").alias("source"), F.max("contained").alias("contained"))
    names = files.select("fid", "path")
    return best.join(names, "fid").join(names.select(F.col("fid").alias("source"), F.col("path").alias("of")), "source").select("path", F.col("of").alias("source"), "contained")


def not_handwritten(files: DataFrame) -> DataFrame:
    """``file_path, reason`` of the source files that a tool wrote, that are minified, vendored or data.

    One row per path; a path scanned several times counts once.  Empty files, other extensions, null paths
    and documents under a wrong extension give no rows.
    """
    seen = cut_lineage(inspected(files))
    copies = vendored(seen).select("path").distinct().withColumn("reason", F.lit("vendored"))
    rules = seen.where(F.col("reason").isNotNull()).select("path", "reason")
    return rules.unionByName(copies).groupBy(F.col("path").alias("file_path")).agg(F.min("reason").alias("reason"))
