"""Text rules that the chunkers share: decoding, file headers, worth, line slices, splitting."""

from __future__ import annotations

import re

from chunkloom import config as C

BOM = "﻿"


def decode_text(data: bytes | None) -> str:
    """UTF-8 with bad bytes replaced, byte order mark dropped, line ends as ``\\n``; null is empty."""
    return decode_bytes(data).replace("\r\n", "\n").replace("\r", "\n")


def decode_bytes(data: bytes | None) -> str:
    """As :func:`decode_text`, but line ends stay as they are."""
    return bytes(data or b"").decode("utf-8", errors="replace").removeprefix(BOM)


def line_slice(lines: list[str], start: int, end: int) -> str:
    """Lines ``start`` to ``end``, counted from 1, both included."""
    return "\n".join(lines[start - 1 : end])


def header_length(lines: list[str], language: str) -> int:
    """Number of leading lines that belong to the file header.

    Python: blank and ``#`` lines.  C++: blank and ``//`` lines up to the end of the first block comment.
    A file with nothing else keeps its last line.
    """
    in_block = False
    for n, raw in enumerate(lines):
        text = raw.strip()
        if language != "cpp":
            if text and text[0] != "#":
                return n
            continue
        in_block = in_block or text.startswith("/*")
        if in_block:
            if "*/" in text:
                return n + 1
        elif text and not text.startswith("//"):
            return n
    return max(len(lines) - 1, 0)


def strip_header(source: str, language: str) -> tuple[str, int]:
    """The source without its header, and how many lines that removed."""
    lines = source.splitlines(keepends=True)
    n = header_length(lines, language)
    return "".join(lines[n:]), n


def worth_chunking(source: str) -> bool:
    """3 to 10,000 lines of which more than a tenth are code.

    Only lines that begin with ``#`` count as comments, for C++ too; a line that equals some comment line
    is one.
    """
    lines = source.splitlines()
    if not C.MIN_CODE_LINES <= len(lines) <= C.MAX_CODE_LINES:
        return False
    code = sum(1 for x in lines if (t := x.strip()) and t[0] != "#")
    return code / len(lines) > C.MIN_CODE_DENSITY


_BLANK_LINES = re.compile(r"\n\s*\n+")


def fixed_split(paragraph: str, width: int = C.MAX_CHUNK_CHARS) -> list[str]:
    """Consecutive pieces of ``width`` characters, trimmed, without empty ones."""
    pieces = (paragraph[at : at + width].strip() for at in range(0, len(paragraph), width))
    return [x for x in pieces if x]


def pack_paragraphs(text: str, width: int = C.MAX_CHUNK_CHARS, least: int = C.MIN_SECTION_CHARS) -> list[str]:
    """Paragraphs packed greedily into pieces of at most ``width`` characters.

    A text that fits comes back as it is.  A longer paragraph is cut at fixed width.  Pieces under
    ``least`` characters are dropped.
    """
    if len(text) <= width:
        return [text]
    done: list[str] = []
    open_: list[str] = []
    size = 0
    for paragraph in filter(None, (x.strip() for x in _BLANK_LINES.split(text))):
        if open_ and size + 2 + len(paragraph) <= width:
            open_.append(paragraph)
            size += 2 + len(paragraph)
            continue
        if open_:
            done.append("\n\n".join(open_))
        if len(paragraph) > width:
            done.extend(fixed_split(paragraph, width))
            open_, size = [], 0
        else:
            open_, size = [paragraph], len(paragraph)
    if open_:
        done.append("\n\n".join(open_))
    return [x for x in done if len(x) >= least]
