"""Evaluation texts that leak into training text, by q-gram lemma filtering and banded alignment.

Texts are reduced to their letters and digits (case, punctuation, spacing, markup, invisible characters,
look-alikes and broken encodings folded away).  If a window of 18 or more words of an item stands in a
document with at most one word in eight changed or left out, the two share at least ``T`` character q-grams
whose diagonals lie close together, where ``T`` follows from the q-gram lemma for that item's cheapest
window.  Shared q-grams are counted in overlapping diagonal bands; bands that reach ``T`` are aligned word
by word inside the band, and the aligned words decide.

The item set is taken in blocks of bounded size; each block's index is sent to every task and the documents
are read once a block.  Documents are never shuffled.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.session import cut_lineage, spread

#: Least number of consecutive item words, and words per allowed error.
MIN_WORDS = 18
WORDS_PER_ERROR = 8
#: Characters of a q-gram.
Q = 8
#: Half the width of a diagonal band, in characters.
BAND = 64
#: Item characters of one block; bounds what is sent to the tasks (about 30 bytes a character).
BLOCK_CHARS = 4_000_000

# Letters that look alike, after case folding and without their marks.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнгԛԝ" + "αοερτυνικχβη" + "ıłøđħŧɑɡꞓ",
    "aeopcyxijsdhlkmtbhrqw" + "aoeptuvikxbn" + "ilodhtagc",
)
_MOJIBAKE = re.compile("[ÂÃ][\u0080-ÿŒ-Ÿˆ-™]|â[\u0080-™]{2}")
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))+\s*/?>|</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbf\"'/]")
_LINK = re.compile(r"(\[[^\[\]\n]*\])\([^()\s]*\)")
_COMBINING = re.compile("[̀-ͯ]")
_NOT_WORD = re.compile(r"[^\w\s]+|_+")


def _repair(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def _unescape(m: re.Match) -> str:
    digits = m[1] or m[2]
    return chr(int(digits, 16)) if digits and not 0xD800 <= int(digits, 16) < 0xE000 else " "


def canonical_words(text: str | None) -> list[str]:
    """The words of a text, each reduced to folded letters and digits; null is empty."""
    if not text:
        return []
    if not text.isascii():
        text = _MOJIBAKE.sub(_repair, text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _COMBINING.sub("", text).translate(LOOK_ALIKES)
    return _NOT_WORD.sub("", text).split()


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams of a code point array."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.zeros(n, "u8")
    for k in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return h ^ (h >> np.uint64(29))


def code_points(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), dtype="<u4").astype("u8")


#: Most words of a window that must be looked at: a longer qualifying window can be cut into two of at least
#: ``MIN_WORDS`` words, one of which has no more errors a word than the whole.
MAX_WORDS = 2 * MIN_WORDS - 1


def window_bounds(words: list[str]) -> list[tuple[int, int]]:
    """For each error budget ``(characters, q-grams)``: the widest window with that budget, and how many
    q-grams the cheapest one must share with its document by the q-gram lemma."""
    size = np.array([len(w) for w in words])
    bounds: dict[int, tuple[int, int]] = {}
    for n in range(MIN_WORDS, min(len(words), MAX_WORDS) + 1):
        errors = n // WORDS_PER_ERROR
        windows = np.lib.stride_tricks.sliding_window_view(size, n)
        total = windows.sum(1)
        lost = np.sort(windows, axis=1)[:, -errors:].sum(1) + errors * (Q - 1)
        kept = int((total - Q + 1 - lost).min())
        wide, least = bounds.get(errors, (0, kept))
        bounds[errors] = (max(wide, int(total.max())), max(1, min(least, kept)))
    return list(bounds.values())


class Items(NamedTuple):
    ids: list
    words: list[list[str]]
    starts: list[np.ndarray]
    least: np.ndarray
    wide: np.ndarray  # error budget x item: widest window, in q-grams
    need: np.ndarray  # error budget x item: q-grams that must be shared; more than there are where it has no window
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    sieve: np.ndarray


def build_index(rows: list[tuple]) -> Items | None:
    """Index of items ``(id, text)``; those under 18 words cannot have a case and are left out."""
    ids, words = [], []
    for i, text in rows:
        w = canonical_words(text)
        if len(w) >= MIN_WORDS:
            ids.append(i)
            words.append(w)
    if not ids:
        return None
    hashes, item, pos = [], [], []
    for k, w in enumerate(words):
        h = gram_hashes(code_points("".join(w)))
        hashes.append(h)
        item.append(np.full(len(h), k, "i4"))
        pos.append(np.arange(len(h), dtype="i4"))
    bounds = [window_bounds(w) for w in words]
    wide = np.zeros((max(map(len, bounds)), len(words)), "i8")
    need = np.full(wide.shape, 1 << 40, "i8")
    for k, b in enumerate(bounds):
        for e, (width, least) in enumerate(b):
            wide[e, k], need[e, k] = width, least
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    sieve = np.zeros(1 << 22, dtype=bool)
    sieve[(grams >> np.uint64(42)).astype("i8")] = True
    return Items(
        ids,
        words,
        [np.concatenate([[0], np.cumsum([len(x) for x in w])]) for w in words],
        need.min(axis=0),
        wide,
        need,
        grams,
        np.append(first, len(h)),
        np.concatenate(item)[order],
        np.concatenate(pos)[order],
        sieve,
    )


def candidate_bands(index: Items, h: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``(document, item, lowest diagonal, highest diagonal)`` of the bands that share enough q-grams.

    ``h`` holds the q-gram hashes of several documents one after another, ``doc_of`` the start of each in it;
    diagonals count from the start of ``h``.
    """
    at = np.flatnonzero(index.sieve[(h >> np.uint64(42)).astype("i8")])
    k = np.searchsorted(index.grams, h[at])
    k[k == len(index.grams)] = 0
    hit = index.grams[k] == h[at]
    at, k = at[hit], k[hit]
    if not len(at):
        return
    count = index.first[k + 1] - index.first[k]
    post = np.repeat(index.first[k], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    item, diag = index.item[post].astype("i8"), np.repeat(at, count) - index.pos[post]
    doc = np.searchsorted(doc_of, np.repeat(at, count), side="right") - 1
    band = diag // BAND
    lo = int(band.min()) - 1
    span = int(band.max()) - lo + 2
    n_items = len(index.ids)
    base = (doc * n_items + item) * span + (band - lo)
    # a hit counts in its own band and in the one before, which overlaps it by half
    own, n = np.unique(base, return_counts=True)
    keys = np.sort(np.concatenate([own, own - 1]), kind="stable")
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    at_own, at_next = np.searchsorted(own, keys), np.searchsorted(own, keys + 1)
    padded, counts = np.append(own, -1), np.append(n, 0)
    n = np.where(padded[at_own] == keys, counts[at_own], 0) + np.where(padded[at_next] == keys + 1, counts[at_next], 0)
    likely = keys[n >= index.least[keys // span % n_items]]
    if not len(likely):
        return
    among = lambda x: likely[np.minimum(np.searchsorted(likely, x), len(likely) - 1)] == x
    first, before = among(base), among(base - 1)
    twice, pos = np.concatenate([base[first], base[before] - 1]), np.concatenate([index.pos[post[first]], index.pos[post[before]]])
    order = np.lexsort((pos, twice))
    twice, pos = twice[order], pos[order]
    once = np.append(True, (twice[1:] != twice[:-1]) | (pos[1:] != pos[:-1]))  # a q-gram counts once a band
    twice, pos = twice[once], pos[once].astype("i8")
    ends = np.searchsorted(twice, twice, side="right")
    owner = twice // span % n_items
    dense = np.zeros(len(twice), bool)
    for wide, need in zip(index.wide, index.need, strict=True):
        last = np.arange(len(twice)) + need[owner] - 1
        inside = last < ends
        dense[inside] |= pos[last[inside]] - pos[inside] < wide[owner[inside]]
    good = twice[dense]
    good = good[np.append(True, good[1:] != good[:-1])] if len(good) else good
    open_ = None
    for key in good:
        owner, b = int(key // span), int(key % span) + lo
        if open_ and open_[0] == owner and b <= open_[2] + 1:
            open_ = (owner, open_[1], b)
            continue
        if open_:
            yield *divmod(open_[0], n_items), open_[1] * BAND, (open_[2] + 2) * BAND
        open_ = (owner, b, b)
    if open_:
        yield *divmod(open_[0], n_items), open_[1] * BAND, (open_[2] + 2) * BAND


def _word_moves(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int] | None:
    """Numbers of item and document words that spell the same from ``a[i]`` and ``b[j]``: 1-1, n-1 or 1-n."""
    x, y = a[i], b[j]
    if x == y:
        return 1, 1
    if y.startswith(x):
        n = i + 1
        while len(x) < len(y) and n < len(a):
            x += a[n]
            n += 1
        return (n - i, 1) if x == y else None
    if x.startswith(y):
        n = j + 1
        while len(y) < len(x) and n < len(b):
            y += b[n]
            n += 1
        return (1, n - j) if x == y else None
    return None


def _keep(cells: dict[int, list[tuple]], at: int, path: tuple[int, int, int, int]) -> None:
    """Adds a path to a cell unless one there is as good in all respects; drops those that it beats so."""
    others = cells.get(at)
    if others is None:
        cells[at] = [path]
        return
    start, errors, credit, debt = path
    for o in others:
        if o[0] <= start and o[1] <= errors and o[2] >= credit and o[3] <= debt:
            return
    cells[at] = [o for o in others if not (start <= o[0] and errors <= o[1] and credit >= o[2] and debt <= o[3])]
    cells[at].append(path)


def _stands_whole(a: list[str], b: list[str]) -> bool:
    """Whether ``MIN_WORDS`` words of ``a`` stand in ``b`` without any error, which needs no alignment."""
    text = f" {' '.join(b)} "
    return any(f" {' '.join(a[i : i + MIN_WORDS])} " in text for i in range(len(a) - MIN_WORDS + 1))


def align(a: list[str], a_at: np.ndarray, b: list[str], b_at: np.ndarray, lo: int, hi: int) -> bool:
    """Whether some alignment of item words ``a`` and document words ``b`` in the band is a case.

    Cells lie in the band if the diagonal of their character offsets is between ``lo`` and ``hi``.  A case is a
    path of at least ``MIN_WORDS`` item words from a word that stands to one that stands, with at most one
    error in ``WORDS_PER_ERROR``.  Words added in the document are no errors, but there must be at most two
    for each word that stands, counted from the start up to any place and from any place to the end.

    A cell keeps ``(start, errors, credit, debt)`` of the paths to it that no other beats: credit is what
    words added may still cost, debt what the rest must make good for them.
    """
    slack = BAND
    first = np.searchsorted(b_at, a_at[:-1] + lo - slack)
    last = np.searchsorted(b_at, a_at[:-1] + hi + slack, side="right")
    n, m = len(a), len(b)
    if _stands_whole(a, b[int(first[0]) : int(last[-1])]):
        return True
    rows: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in range(n + 1)]
    for i in range(n):
        row, below, x = rows[i], rows[i + 1], a[i]
        lead = x[0]
        for j in range(int(first[i]), min(int(last[i]), m)):
            paths = row.get(j, ())
            if b[j][0] == lead and (move := _word_moves(a, i, b, j)):
                target, to = rows[i + move[0]], j + move[1]
                for start, errors, credit, debt in (*paths, (i, 0, 0, 0)) if n - i >= MIN_WORDS else paths:
                    size = i + move[0] - start
                    debt = max(0, debt - 2 * move[0])
                    if not debt and size >= MIN_WORDS and size >= WORDS_PER_ERROR * errors:
                        return True
                    _keep(target, to, (start, errors, credit + 2 * move[0], debt))
            for start, errors, credit, debt in paths:
                # a path that needs MIN_WORDS more words to make up for its errors is better begun anew
                if WORDS_PER_ERROR * (errors + 1) <= n - start and WORDS_PER_ERROR * (errors + 1) - (i + 1 - start) < MIN_WORDS:
                    worse = (start, errors + 1, credit, debt)
                    _keep(below, j + 1, worse)
                    _keep(below, j, worse)
                if credit and debt < 2 * (n - i):
                    _keep(row, j + 1, (start, errors, credit - 1, debt + 1))
    return False


#: A word that has lost its blanks holds at least two words of the item, which are this share of its letters or
#: as many as this; single letters prove nothing.
GLUED_SHARE = 2 / 3
GLUED_WORDS = 6


@functools.lru_cache(maxsize=256)
def _splitter(item: tuple[str, ...]) -> tuple[frozenset, re.Pattern]:
    known = frozenset(item)
    return known, re.compile("(" + "|".join(sorted((re.escape(w) for w in known if len(w) > 1), key=lambda w: (-len(w), w))) + ")")


def _parted(words: list[str], item: list[str]) -> list[str]:
    """``words`` with those that have lost their blanks cut into words of the item and what lies between them.

    Words that are the item's own stay.  Of a glued word the leftmost longest words of the item are taken.
    """
    known, split = _splitter(tuple(item))
    out = []
    for w in words:
        if w not in known and len(w) > 3:
            parts = split.split(w)
            found = parts[1::2]
            if len(found) > 1 and (len(found) >= GLUED_WORDS or sum(map(len, found)) >= GLUED_SHARE * len(w)):
                out += filter(None, parts)
                continue
        out.append(w)
    return out


#: Letters of the documents that are searched in one pass.
PASS_LETTERS = 1_000_000


def leaks_in(index: Items, texts: list[str | None]) -> Iterator[tuple[int, object]]:
    """``(position in texts, item id)`` of each item of which a passage stands in a text."""
    group: list[tuple[int, list[str], str]] = []
    size = 0
    least = int(index.least.min()) + Q - 1
    for n, text in enumerate(texts):
        words = canonical_words(text)
        letters = "".join(words)
        if len(letters) >= least:
            group.append((n, words, letters))
            size += len(letters)
        if size >= PASS_LETTERS:
            yield from _leaks_in(index, group)
            group, size = [], 0
    if group:
        yield from _leaks_in(index, group)


def _leaks_in(index: Items, group) -> Iterator[tuple[int, object]]:
    sizes = [len(x) for _, _, x in group]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = set()
    for doc, item, lo, hi in candidate_bands(index, gram_hashes(code_points("".join(x for _, _, x in group))), starts[:-1]):
        n, words, _ = group[doc]
        if (n, item) in found:
            continue
        words = _parted(words, index.words[item])
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        off = int(starts[doc])
        if align(index.words[item], index.starts[item], words, at, lo - off, hi - off):
            found.add((n, item))
            yield n, index.ids[item]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The item set in blocks of at most ``BLOCK_CHARS`` characters (one longer item is a block)."""
    block, size = [], 0
    for r in items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(item_id, text).toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``doc_id, item_id``: documents that carry a passage of an item.

    Null ids and null or short texts have no case; an empty item set gives no rows.  Items with equal texts
    are each reported.
    """
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    arrow = to_arrow_schema(schema)
    spark = documents.sparkSession
    docs = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = list(leaks_in(index, batch.column(1).to_pylist()))
                ids = batch.column(0).take(pa.array([n for n, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), pa.array([i for _, i in hits], arrow.field(1).type)], schema=arrow)

        return run

    # one block stays a plain map; of several each is searched and written before the next is sent out
    parts, last = [], None
    for block in item_blocks(items, item_id, text):
        if (index := build_index(block)) is None:
            continue
        if last is not None:
            parts.append(cut_lineage(docs.mapInArrow(search(last), schema)))
            last.destroy()
        last = spark.sparkContext.broadcast(index)
    if last is None:
        return spark.createDataFrame([], schema)
    parts.append(docs.mapInArrow(search(last), schema))
    return functools.reduce(DataFrame.unionByName, parts).distinct()
