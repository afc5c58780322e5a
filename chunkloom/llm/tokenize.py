"""Encoding of a corpus with a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is a tree of spans: it is cut in halves until a span is a leaf, leaves are encoded in one batch for
all texts of an Arrow batch, and neighbours are joined pairwise up the tree.  A join re-encodes only a
window over the seam and grows it until both sides provably agree:

* The pre-tokenizer is a scan from left to right with at most one character of look-ahead and none behind.
  Hence from any true piece boundary on, the scan depends only on the text after it.
* In the left span every piece but the last ``UNSTABLE`` ones ended before the span's end could matter, so
  the window may begin at such a boundary.
* As soon as the window's scan and the right span's own scan share a boundary that is not among the last
  ``UNSTABLE`` pieces of the window, both run alike from there, and the right span's tokens stay valid.

BPE merges never cross a piece boundary, so tokens before and after the window are kept and those in it
replaced.  The join is associative; decoding concatenates the leaves' bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkloom.session import spread

#: Characters of a leaf; longer spans are halved.
LEAF_CHARS = 1024
#: First size of a seam window in characters on either side; it doubles until the sides agree.
WINDOW_CHARS = 64
#: Pieces at the end of a scan that later text may change: a contraction is split into two at most.
UNSTABLE = 3
#: Fixed value: the public pre-tokenizer pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of the installed ``.tiktoken`` file; callers may give any other path."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = spec.submodule_search_locations[0] if spec else "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")


class Tokenizer:
    """One vocabulary: batch encoding of leaves and the seam join."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype="i8")
        for b, i in ranks.items():
            self.sizes[i] = len(b)

    def leaves(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, dtype="i4") for x in self.encoding.encode_ordinary_batch(texts, num_threads=1)]

    def ends(self, text: str) -> list[int]:
        """Ends of the pieces of ``text`` in characters."""
        return [m.end() for m in self.pieces.finditer(text)]

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Token ids of ``left + right`` from those of both."""
        if not left or not right:
            return a if left else b
        size = WINDOW_CHARS
        while size < max(len(left), len(right)):
            start = self._start(left, size)
            if start is not None:
                window = left[start:] + right[:size]
                seam = len(left) - start
                mine = {x - seam for x in self.ends(window)[: -UNSTABLE or None] if x >= seam}
                theirs = self.ends(right[:size])[:-UNSTABLE]
                stop = next((x for x in (0, *theirs) if x in mine), None)
                if stop is not None:
                    middle = self._by_piece(window, seam + stop)
                    return np.concatenate([self._cut(a, left[start:], tail=True), middle, self._cut(b, right[:stop], tail=False)])
            size *= 2
        return self.leaves([left + right])[0]

    def _by_piece(self, window: str, end: int) -> np.ndarray:
        """Ids of the window's pieces up to ``end``; a cut text could be split differently at its end."""
        ids: list[int] = []
        for m in self.pieces.finditer(window):
            if m.end() > end:
                break
            ids += self.encoding.encode_ordinary(m[0])  # a piece alone is one piece
        return np.asarray(ids, dtype="i4")

    def _start(self, left: str, size: int) -> int | None:
        """A piece boundary of ``left`` that no later text moves, about ``size`` characters before its end.

        The scan for it must itself begin at a boundary: a single space between two other characters always
        starts a piece, as does the beginning of the span.
        """
        at = len(left) - size
        while at > 0:
            at = left.rfind(" ", 0, at)
            if at <= 0:
                break
            if not left[at - 1].isspace() and not left[at + 1].isspace():
                break
        at = max(at, 0)
        ends = self.ends(left[at:])
        keep = [at, *(at + x for x in ends)][: len(ends) + 1 - UNSTABLE]
        return keep[-1] if keep else None

    def _cut(self, ids: np.ndarray, part: str, tail: bool) -> np.ndarray:
        """``ids`` without the tokens of ``part``, which is its text's end (``tail``) or beginning."""
        want = len(part.encode())
        if not want:
            return ids
        done = np.cumsum(self.sizes[ids[::-1] if tail else ids])
        n = int(np.searchsorted(done, want)) + 1
        if done[n - 1] != want:
            raise AssertionError("a stable boundary must be a token boundary")
        return ids[: len(ids) - n] if tail else ids[n:]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text: leaves of all texts in one batch, then joins level by level."""
        spans: list[str] = []
        trees = [self._halve(t or "", spans) for t in texts]
        coded = self.leaves(spans)
        return [self._reduce(t, spans, coded)[1] for t in trees]

    def _halve(self, text: str, spans: list[str]):
        if len(text) <= LEAF_CHARS:
            spans.append(text)
            return len(spans) - 1
        mid = len(text) // 2
        return self._halve(text[:mid], spans), self._halve(text[mid:], spans)

    def _reduce(self, node, spans, coded) -> tuple[str, np.ndarray]:
        if isinstance(node, int):
            return spans[node], coded[node]
        (lt, la), (rt, ra) = self._reduce(node[0], spans, coded), self._reduce(node[1], spans, coded)
        return lt + rt, self.join(lt, la, rt, ra)

    def decode(self, ids) -> str:
        """The text of ``ids``; halves are decoded apart and their bytes joined."""

        def concat(lo: int, hi: int) -> bytes:
            if hi - lo <= LEAF_CHARS:
                return b"".join(self.token_bytes[i] for i in ids[lo:hi])
            mid = (lo + hi) // 2
            return concat(lo, mid) + concat(mid, hi)

        return concat(0, len(ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per Python worker and vocabulary."""
    return Tokenizer(path)


def encode_corpus(documents: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``documents`` with the column ``ids`` of token ids in place of ``text``.

    Null and empty texts give an empty list.  No special tokens are added, and their strings in a text are
    ordinary text.  All other columns stay; a column named like ``ids`` is replaced.  The map shuffles
    nothing where the input has as many partitions as there are cores.  ``vocabulary`` must be readable on every executor.
    """
    path = vocabulary or default_vocabulary()
    keep = [f for f in documents.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            coded = tok.encode_all(batch.column(batch.schema.get_field_index(text)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype("i4")
            flat = np.concatenate(coded) if coded else np.zeros(0, "i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())).cast(arrow.field(ids).type)
            cols = [batch.column(batch.schema.get_field_index(f.name)).cast(arrow.field(f.name).type) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, lists], schema=arrow)

    return spread(documents.select(*(f.name for f in keep), text)).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with ``text`` decoded from ``ids``; a null list gives an empty text."""
    path = vocabulary or default_vocabulary()
    keep = [f for f in encoded.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = [tok.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(f.name)).cast(arrow.field(f.name).type) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], schema=arrow)

    return encoded.select(*(f.name for f in keep), ids).mapInArrow(run, schema)
