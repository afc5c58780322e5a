"""Sentence boundaries across languages and scripts.

Layout comes first: fenced code, headings, list entries, quoted and commented lines and paragraphs are cut
into blocks whose ends are certain.  Inside a block every sentence mark is a candidate.  Marks that only end
sentences decide alone; a full stop is classified by a maximum-entropy model over the neighbouring tokens,
their case, length, digits and script.  The model learns from reliable candidates of the corpus itself:
full stops that end a block (boundaries), and full stops before a lower-case word, or after an abbreviation
and before a number (none).

Two inputs are computed from the corpus: counts of how often a word stands before a full stop inside a block
and how often it begins one (over all documents; words that are more than one in ``NAMED`` have counts of their
own, the others share ``BUCKETS`` hash buckets, so the size is fixed), and the model's weights (from the
candidates of at most ``SAMPLE_DOCS`` documents, the first by hash).
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.session import cut_lineage, release, spread

#: Words with a count of their own are at least one in so many of all words; hash buckets of the rest.
NAMED = 1 << 17
BUCKETS = 1 << 17
#: Hash buckets of the model's features.
FEATURES = 1 << 16
#: Documents whose candidates the model is fitted on, and candidates kept of one document.
SAMPLE_DOCS = 4000
SAMPLE_PER_DOC = 200

# Marks.
STOPS = ".!?…。！？｡．؟۔।॥"
SURE = "。！？｡؟۔।॥!?"
OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}
CLOSERS = "\"”“’'»›」』）)\\]】》*_`~"
WIDE = "。！？｡「」『』"
_INVISIBLE = "​‌‍⁠﻿­‎‏"
_LETTER = r"(?:[^\W_]|[̀-ًͯ-ٰٟऀ-ःऺ-ॏॢॣั-ฺ็-๎])"  # with vowel signs
_WORD = re.compile(rf"{_LETTER}+(?:[.'’\-]+{_LETTER}+)*")
_JOINED = re.compile(r"(?<=[^\W\d_]{2})\.(?=[A-ZÀ-ÞА-Я][a-zß-ÿа-я])")  # a missing blank after a stop
_CAND = re.compile(rf"[{re.escape(STOPS)}](?:[{re.escape(STOPS)}{_INVISIBLE}]|(?<=\.) (?=\.))*(?:[{CLOSERS}{_INVISIBLE}]|[\s  ]»)*")
_NEXT = re.compile(r"[\w]")
_BLANK_RUN = re.compile(rf"[\s{_INVISIBLE}]+")
_UNMARKED = "฀-๿຀-໿"  # Thai and Lao write no sentence marks
_UNMARKED_GAP = re.compile(rf"(?<=[{_UNMARKED}])[{_INVISIBLE}]*(?P<gap>\s[\s{_INVISIBLE}]*)(?=[\"“«(]?[{_UNMARKED}])")

_LINE = re.compile(r"[^\r\n  \x0b\x0c\x85]*(?:\r\n|[\r\n  \x0b\x0c\x85]|\Z)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_QUOTE = re.compile(rf"[\s{_INVISIBLE}]*(?:>[ \t]?)+")
_COMMENT = re.compile(rf"[\s{_INVISIBLE}]*(?://[/!]?|#+|/\*+|\*/?(?=\s|$))[ \t]?")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s+\S")
_LIST = re.compile(r"\s*(?:[-*+•‣–—]|\(?\d{1,3}[.)、]|\(?[a-z]\))\s+(?=\S)")
_LIST_WIDE = re.compile(r"\s*\d{1,3}[、．]\s*(?=\S)")
_SPEAKER = re.compile(r"\s*[^\W\d_][\w .-]{0,24}:\s+(?=\S)")
_RULE = re.compile(r"\s*(?:[-=_*#~]\s*){3,}$")


class Block(NamedTuple):
    text: str  # lines joined by blanks, without their marks
    parts: list[tuple[int, int]]  # (start in text, start in the document) of each line
    code: bool
    lead: int  # length of the heading sign, list number or speaker label in text


def blocks(text: str, doc_type: str | None) -> Iterator[Block]:
    """Layout blocks in order; each ends a sentence."""
    comment = (doc_type or "").lower() == "comment"
    thread = (doc_type or "").lower() == "thread"
    lines: list[tuple[int, str]] = []
    lead = 0
    fence, fence_at, fence_end = "", 0, 0

    def flush() -> Iterator[Block]:
        nonlocal lines, lead
        if lines:
            at, parts = 0, []
            for start, body in lines:
                parts.append((at, start))
                at += len(body) + 1
            yield Block(" ".join(b for _, b in lines), parts, False, lead)
        lines, lead = [], 0

    for m in _LINE.finditer(text):
        if m.start() == len(text) and m.start() == m.end():
            break
        start, raw = m.start(), m[0].rstrip("\r\n  \x0b\x0c\x85")
        skip = 0
        if q := _QUOTE.match(raw):
            skip = q.end()
        if comment and (c := _COMMENT.match(raw, skip)):
            skip = c.end()
        body = raw[skip:]
        if fence:
            if body.strip().startswith(fence) and not body.strip().strip(fence[0]):
                yield Block(text[fence_at : start + len(raw)], [(0, fence_at)], True, 0)
                fence = ""
            fence_end = start + len(raw)
            continue
        if f := _FENCE.match(body):
            yield from flush()
            fence, fence_at, fence_end = f[1][:3], start + skip + len(body) - len(body.lstrip()), start + len(raw)
            continue
        if not body.strip(" \t 　" + _INVISIBLE) or _RULE.match(body):
            yield from flush()
            continue
        if not comment and _HEADING.match(body):
            yield from flush()
            n = len(body) - len(body.lstrip().lstrip("#").lstrip())
            lines, lead = [(start + skip, body)], n
            yield from flush()
            continue
        if mark := (_LIST.match(body) or _LIST_WIDE.match(body)):
            if not lines or not _continues(lines[-1][1], mark[0]):
                yield from flush()
                lead = mark.end()
        elif thread and (label := _SPEAKER.match(body)):
            yield from flush()
            lead = label.end()
        lines.append((start + skip, body))
    if fence:
        yield Block(text[fence_at:fence_end], [(0, fence_at)], True, 0)
    yield from flush()


def _continues(before: str, mark: str) -> bool:
    """Whether a line that looks like a list entry only continues a wrapped sentence: ``sec.`` / ``14. of``."""
    return mark.strip()[:1].isalnum() and bool(before.strip()) and before.rstrip()[-1] not in STOPS + ":;" + CLOSERS and not _LIST.match(before)


_PAIRED = re.compile("[" + re.escape('"' + "".join(OPEN) + "".join(OPEN.values())) + "]")
_CLOSES = {c: {o for o in OPEN if c in OPEN[o]} for c in "".join(OPEN.values())} | {'"': {'"'}}


def spans(text: str) -> list[tuple[int, int]]:
    """Matching quotes and brackets of a block as ``(open, close)``, outermost first; unmatched ones are left out."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _PAIRED.finditer(text):
        c, i = m[0], m.start()
        hit = -1
        if openers := _CLOSES.get(c):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in openers:
                    hit = k
                    break
        if hit >= 0:
            out.append((stack[hit][1], i))
            del stack[hit:]
        elif c == '"' or c in OPEN:
            stack.append((c, i))
    return sorted(out)


@functools.lru_cache(maxsize=1 << 16)
def word_key(word: str) -> int:
    """A word's hash, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Counts(NamedTuple):
    """Per word, how often it stands: before a full stop inside a block, before anything else (both without
    case), at the beginning of a block, after a word or comma, after a full stop (with case).

    ``named`` has the places of the words with counts of their own; the others' buckets stand behind them.
    """

    stop: np.ndarray
    free: np.ndarray
    first: np.ndarray
    inner: np.ndarray
    after: np.ndarray
    named: dict[int, int]

    def at(self, word: str) -> int:
        key = word_key(word)
        place = self.named.get(key)
        return len(self.named) + key % BUCKETS if place is None else place


COLUMNS = ("stop", "free", "first", "inner", "after")


_keys: dict[str, tuple[int, int]] = {}


def _word_keys(word: str) -> tuple[int, int]:
    """Keys of a word without case and as it stands, remembered while they fit."""
    got = _keys.get(word)
    if got is None:
        if len(_keys) >= 1 << 16:
            _keys.clear()
        _keys[word] = got = (word_key(word.casefold()), word_key(word))
    return got


def count_words(block: Block, stop: list, free: list, first: list, inner: list, after: list) -> None:
    """Adds the keys of a block's words to the lists of the places where they stand."""
    s = block.text
    last = len(s.rstrip())
    begun = False
    for m in _WORD.finditer(s, block.lead):
        folded, key = _word_keys(m[0])
        begin, end = m.span()
        if end < last:
            c = s[end]
            if c == ".":
                if end + 1 < last and s[end + 1].isspace():
                    stop.append(folded)
            elif c not in STOPS:
                free.append(folded)
        if not begun:
            first.append(key)
            begun = True
        elif begin > 1 and s[begin - 1] == " ":
            before = s[begin - 2]
            if before == ".":
                after.append(key)
            elif before.isalnum() or before in ",;'":
                inner.append(key)


class Candidate(NamedTuple):
    at: int  # start of the marks
    end: int  # after marks and closers
    marks: str
    left: str
    right: str
    gap: bool  # white space follows
    closed: bool  # closing quotes or brackets follow the marks


_LETTER_AT = re.compile(_LETTER)


def candidates(s: str, lead: int) -> Iterator[Candidate]:
    words = None
    for m in _CAND.finditer(s, lead):
        if words is None:  # all words of the block, of any length
            words = [w.span() for w in _WORD.finditer(s)]
            starts = [w[0] for w in words]
        run = m[0]
        at, end = m.span()
        marks = run.rstrip(CLOSERS.replace("\\", "") + _INVISIBLE + "   ")
        left_word = ""
        k = bisect_right(starts, at - 1) - 1
        if k >= 0 and words[k][1] >= at and _LETTER_AT.match(s, at - 1):
            left_word = _JOINED.split(s[words[k][0] : at])[-1]
        n = _NEXT.search(s, end)
        right = _WORD.match(s, n.start()) if n else None
        gap = end < len(s) and (s[end].isspace() or (n is not None and any(c.isspace() for c in s[end : n.start()])))
        yield Candidate(at, end, marks, left_word, right[0] if right else (n[0] if n else ""), gap, len(run.rstrip(_INVISIBLE)) > len(marks))


def _shape(word: str) -> str:
    if not word:
        return "none"
    if word.isdigit():
        return f"int{min(len(word), 3)}"
    if word[0].isdigit():
        return "num"
    if "." in word:
        return "dots"
    kind = "U" if word.isupper() else "T" if word[0].isupper() else "l" if word[0].islower() else "c"
    return f"{kind}{min(len(word), 6)}"


@functools.lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "OTHER").split(" ")[0] if c else "NONE"


def _abbreviation(word: str, counts: Counts) -> float:
    """Log odds that the word stands before a full stop."""
    b = counts.at(word.casefold())
    return math.log((counts.stop[b] + 0.5) / (counts.free[b] + 0.5)) if word else 0.0


def features(c: Candidate, counts: Counts) -> list[int]:
    """Active feature buckets of a candidate; the case of the word after it takes no part (see above)."""
    left, right = c.left.casefold(), c.right.casefold()
    bl, br = counts.at(left), counts.at(c.right)
    abbreviation = _abbreviation(c.left, counts)
    starter = math.log((counts.first[br] + 0.5) / (counts.inner[br] + 0.5)) if right else 0.0
    opener = math.log((counts.first[br] + 0.5) / (counts.after[br] + 0.5)) if right else 0.0
    seen = counts.stop[bl] + counts.free[bl]
    names = [
        "bias",
        f"l={left}",
        f"ls={_shape(c.left)}",
        f"la={max(-4, min(4, round(abbreviation)))}",
        f"lac={max(-4, min(4, round(abbreviation)))},{_shape(c.left)[:1]}",
        f"ln={seen > 2}",
        f"r={right}",
        f"rs={max(-5, min(4, round(starter)))}",
        f"ro={max(-3, min(1, round(opener)))}",
        f"rd={right[:1].isdigit()}",
        "bias" if not c.left[-1:].isalpha() else f"sc={_script(c.left[-1:])}",
        f"rsc={_script(c.right[:1])}",
        f"m={c.marks[:3]}",
    ]
    if left and not seen:  # a new word tells by its shape and script only
        names[1] = names[3] = names[4] = names[5] = "bias"
    if right and not counts.first[br] + counts.inner[br] + counts.after[br]:
        names[6] = names[7] = names[8] = "bias"
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def reliable(block: Block, follows: str, counts: Counts) -> Iterator[tuple[list[int], int]]:
    """Labelled examples of a block: the stop at its end, and stops before a lower-case word."""
    s, last = block.text, len(block.text.rstrip())
    for c in candidates(s, block.lead):
        if c.marks != "." or c.closed:
            continue
        if c.end >= last:
            yield features(c._replace(right=follows), counts), 1
        elif c.gap and (c.right[:1].islower() or c.right[:1].isdigit() and _abbreviation(c.left, counts) > 1):
            yield features(c, counts), 0


#: Columns of :func:`features` that describe the word before and the word after the mark.
LEFT, RIGHT = [1, 2, 3, 4, 5, 10], [6, 7, 8, 9, 11]


def fit(rows: list[list[int]], labels: list[int], rounds: int = 60, decay: float = 1e-4) -> np.ndarray:
    """Weights of the maximum-entropy model by full-batch adaptive gradient ascent; classes weigh the same.

    Every example also counts with the word before the stop unknown and with the word after it unknown, so
    that either side can decide alone where the other is new.
    """
    w = np.zeros(FEATURES, "f8")
    if not rows:
        return w
    full = np.asarray(rows, "i8")
    left, right = full.copy(), full.copy()
    left[:, RIGHT] = full[:, :1]  # the bias again stands for "unknown"
    right[:, LEFT] = full[:, :1]
    x = np.vstack([full, left, right])
    y = np.tile(np.asarray(labels, "f8"), 3)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    grown = np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((y - p) * share, x.shape[1]), FEATURES) - decay * w
        grown += g * g
        w += 0.5 * g / np.sqrt(grown)
    return w


class Model(NamedTuple):
    counts: Counts
    weights: np.ndarray


#: Scores that a worker remembers; the same words meet at many stops.
REMEMBERED = 1 << 18
_scores: dict[tuple, float] = {}


def score(c: Candidate, model: Model) -> float:
    key = (id(model), c.left, c.right, c.marks)
    got = _scores.get(key)
    if got is None:
        if len(_scores) >= REMEMBERED:
            _scores.clear()
        _scores[key] = got = float(model.weights[features(c, model.counts)].sum())
    return got


def _is_boundary(c: Candidate, model: Model) -> bool:
    """Decides a candidate outside quotes and brackets."""
    sure = c.marks.strip(".… ") != ""
    lower = c.right[:1].islower()
    if c.marks[-1] in WIDE or c.marks[-1] in "।॥؟۔":
        return True
    if sure:
        if lower and (c.closed or not c.gap):
            return False
        return c.gap or c.right[:1].isupper() or _script(c.right[:1]) not in ("LATIN", "DIGIT", "CYRILLIC")
    if len(c.marks) > 1 or c.marks == "…":  # an ellipsis
        return c.gap and not lower and not c.right[:1].isdigit()
    if not c.gap:
        return c.right[:1].isupper() and c.right[1:2].islower() and len(c.left) > 2 and c.left.islower() and "." not in c.right and score(c, model) > 0
    if lower:
        return not c.closed and score(c, model) > 3
    return score(c, model) > 0


def block_ends(block: Block, model: Model) -> list[int]:
    """Ends of the sentences of a block, in its text."""
    s = block.text
    last = len(s.rstrip(" \t\r\n 　   \x0b\x0c" + _INVISIBLE))
    if block.code or not last:
        return [last] if last else []
    pairs = spans(s)
    ends: list[int] = []
    begin = block.lead
    for c in candidates(s, block.lead):
        if c.end >= last:
            continue
        inside = [p for p in pairs if p[0] < c.at <= p[1]]
        if any(p[1] >= c.end for p in inside):
            continue
        if inside:
            whole = not re.search(r"\w", s[begin : inside[0][0]])
            if c.marks[-1] in WIDE or _script(c.right[:1]) in ("CJK", "HIRAGANA", "KATAKANA"):
                ok = whole and not s[c.end : c.end + 1].isalpha()
            else:
                ok = c.gap and not c.right[:1].islower() and (whole or score(c, model) > 0)
        else:
            ok = _is_boundary(c, model)
        if ok:
            ends.append(c.end)
            begin = c.end
    for m in _UNMARKED_GAP.finditer(s, block.lead):
        ends.append(m.start("gap"))
    ends = sorted({len(s[:e].rstrip(_INVISIBLE + " ")) for e in ends})
    kept, begin = [], 0
    for e in ends:
        if re.search(r"\w", s[begin:e]):
            kept.append(e)
            begin = e
        elif kept and not s[kept[-1] : e].strip(STOPS + CLOSERS + " "):
            kept[-1] = e
            begin = e
    if re.search(r"\w", s[begin:last]) or not kept:
        kept.append(last)
    elif not s[kept[-1] : last].strip(STOPS + CLOSERS + _INVISIBLE + "  "):
        kept[-1] = last
    return kept


def sentence_ends(text: str | None, doc_type: str | None, model: Model) -> list[int]:
    """Ends of the sentences of a text in code points; null and blank texts have none."""
    if not text or not text.strip(" \t\r\n 　\x0b\x0c\x85  " + _INVISIBLE):
        return []
    out = []
    for b in blocks(text, doc_type):
        starts = [p[0] for p in b.parts]
        for e in block_ends(b, model):
            k = bisect_right(starts, e - 1) - 1
            out.append(b.parts[k][1] + e - b.parts[k][0])
    return sorted(set(out))


# ---------------------------------------------------------------- distributed plan

_COUNT_SCHEMA = T.StructType([T.StructField("word", T.LongType())] + [T.StructField(c, T.LongType()) for c in COLUMNS])
#: Words that a task counts before it sends them on.
HELD_WORDS = 1 << 19


def _texts(documents: DataFrame) -> DataFrame:
    kind = F.col("doc_type") if "doc_type" in documents.columns else F.lit(None).cast("string")
    return spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text", kind.alias("doc_type")))


def word_counts(documents: DataFrame) -> Counts:
    """Word counts over all documents; the driver gets at most ``NAMED`` words and ``BUCKETS`` sums."""

    def sent(sums: list[Counter]) -> pa.RecordBatch:
        keys = sorted(set().union(*sums))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([d[k] for k in keys], pa.int64()) for d in sums)], names=_COUNT_SCHEMA.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[Counter] = [Counter() for _ in COLUMNS]
        for batch in batches:
            for text, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places: list[list[int]] = [[] for _ in COLUMNS]
                for b in blocks(text, kind):
                    if not b.code:
                        count_words(b, *places)
                for total, keys in zip(sums, places, strict=True):
                    total.update(keys)
                if max(map(len, sums)) > HELD_WORDS:
                    yield sent(sums)
                    sums = [Counter() for _ in COLUMNS]
        yield sent(sums)

    total = sum((F.col(c) for c in COLUMNS), F.lit(0))
    words = cut_lineage(_texts(documents).mapInArrow(run, _COUNT_SCHEMA).groupBy("word").agg(*(F.sum(c).alias(c) for c in COLUMNS)).withColumn("total", total))
    least = (words.agg(F.sum("total")).first()[0] or 0) / NAMED
    frequent = words.where((F.col("total") >= least)).orderBy("word").toArrow()
    rest = words.where(F.col("total") < least).groupBy(F.pmod("word", F.lit(BUCKETS)).alias("word")).agg(*(F.sum(c).alias(c) for c in COLUMNS)).toArrow()
    release(words)
    n = frequent.num_rows
    named = dict(zip(frequent.column("word").to_pylist(), range(n), strict=True))
    out = Counts(*(np.zeros(n + BUCKETS, "i8") for _ in COLUMNS), named)
    for c in COLUMNS:
        getattr(out, c)[:n] = np.asarray(frequent.column(c))
        getattr(out, c)[n + np.asarray(rest.column("word"))] = np.asarray(rest.column(c))
    return out


def _sample(documents: DataFrame) -> DataFrame:
    """The ``SAMPLE_DOCS`` documents first by hash of id and text; equal ones count once."""
    texts = _texts(documents).withColumn("h", F.xxhash64("doc_id", "text"))
    n = documents.count()
    if n > 2 * SAMPLE_DOCS:
        texts = texts.where(F.shiftrightunsigned("h", 34) < F.lit(int((1 << 30) * 1.5 * SAMPLE_DOCS / n)))
    order = F.shiftrightunsigned("h", 34)
    last = texts.select("h").distinct().orderBy(order, "h").offset(SAMPLE_DOCS - 1).limit(1).select(order.alias("o"), "h").first()
    if last is not None:
        texts = texts.where((order < last.o) | ((order == last.o) & (F.col("h") <= last.h)))
    return texts.dropDuplicates(["h"])


def train(documents: DataFrame) -> Model:
    """The boundary model of a corpus; deterministic for given documents."""
    counts = word_counts(documents)
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [b for b in blocks(text, kind) if not b.code]
                starts = [(m[0] if (m := _WORD.search(b.text, b.lead)) else "") for b in found]
                n = 0
                for k, b in enumerate(found):
                    for f, label in reliable(b, starts[(k + 1) % len(found)], shared.value):
                        if n < SAMPLE_PER_DOC:
                            x.append(f)
                            y.append(label)
                            n += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.int32())], names=["x", "y"])

    rows = _sample(documents).select("text", "doc_type").mapInArrow(run, "x array<int>, y int").toArrow()
    if not rows.num_rows:
        return Model(counts, np.zeros(FEATURES))
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    y = np.asarray(rows.column("y"))
    order = np.lexsort((*x.T, y))
    return Model(counts, fit(list(x[order]), list(y[order])))


def sentence_boundaries(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per sentence: ``doc_id, end_pos`` in code points.

    Needs ``doc_id`` and ``text``; ``doc_type`` is used where present.  Null and blank texts have no rows;
    repeated rows give distinct ends.  Without ``model`` one is trained on the same documents.
    """
    model = model or train(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("end_pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        _scores.clear()
        for batch in batches:
            take, ends = [], []
            for n, (text, kind) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = sentence_ends(text, kind, m)
                take += [n] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])

    return _texts(documents).mapInArrow(run, schema)
