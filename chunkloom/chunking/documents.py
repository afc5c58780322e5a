"""Markdown and PDF texts to section and page chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from chunkloom import config as C
from chunkloom.chunking.text import decode_text, pack_paragraphs

_HEADING = re.compile(r"^(#{1,3} .+)$", re.M)
_CHAPTER = re.compile(C.CHAPTER_TITLE, re.I)


def title_chapter(title: str) -> str:
    """The chapter number that a title begins with, or an empty string."""
    m = _CHAPTER.match(title.strip())
    return m[1] if m else ""


def _doc(content, kind, symbol, chapter, level, first, last) -> dict:
    return {
        "content": content,
        "language": "pdf",
        "chunk_type": kind,
        "symbol_name": symbol,
        "chapter": chapter,
        "level": level,
        "page_start": first,
        "page_end": last,
        "start_line": first,
        "end_line": last,
        "symbols_referenced": [],
    }


def chunk_markdown(data: bytes, relative_path: str) -> Iterator[dict]:
    """Sections under headings of level one to three, numbered in the order they are emitted.

    A section's ``level`` is that of the heading after it, 1 for the last.  Sections under 100 characters
    are dropped and take no number.
    """
    parts = _HEADING.split(decode_text(data))
    titles = [PurePosixPath(relative_path).stem, *(h.lstrip("#").strip() for h in parts[1::2])]
    levels = [*(len(h) - len(h.lstrip("#")) for h in parts[1::2]), 1]
    number = 0
    for title, level, body in zip(titles, levels, parts[0::2], strict=True):
        body = body.strip()
        if len(body) < C.MIN_SECTION_CHARS:
            continue
        number += 1
        yield _doc(f"# Document : {relative_path}\n# Section : {title}\n\n{body}", "section", title, title_chapter(title), level, number, number)


def chunk_pdf(pages: list[str], toc: list[tuple[int, str, int]], relative_path: str) -> Iterator[dict]:
    """Chunks of a PDF from its page texts and table of contents ``(level, title, page)``.

    With a table of contents each entry runs to the page before the next; otherwise every page is a chunk.
    """
    if not toc:
        for n, page in enumerate((p.strip() for p in pages), 1):
            if len(page) >= C.MIN_SECTION_CHARS:
                yield _doc(f"# Document : {relative_path}\n# Page {n}\n\n{page}", "page", f"Page {n}", "", 0, n, n)
        return
    ends = [page - 1 for _, _, page in toc[1:]] + [len(pages)]
    for (level, title, first), last in zip(toc, ends, strict=True):
        text = "\n\n".join(pages[max(first - 1, 0) : min(last, len(pages))]).strip()
        if len(text) < C.MIN_SECTION_CHARS:
            continue
        pieces = pack_paragraphs(text)
        for n, piece in enumerate(pieces, 1):
            name = f"{title} (part {n}/{len(pieces)})" if len(pieces) > 1 else title
            head = f"# Document : {relative_path}\n# Section : {name} (p. {first}–{last})\n\n"
            yield _doc(head + piece, "section", name, title_chapter(title), level, first, last)


def read_pdf(data: bytes | None) -> tuple[list[str], list[tuple[int, str, int]]]:
    """Page texts and table of contents by the optional PDF library; raises where it is missing."""
    try:
        import fitz
    except ImportError as e:  # not part of this environment
        raise RuntimeError("reading PDF files needs the optional package pymupdf") from e
    with fitz.open(stream=bytes(data or b""), filetype="pdf") as doc:
        return [p.get_text() for p in doc], [(lv, t, p) for lv, t, p, *_ in doc.get_toc()]
