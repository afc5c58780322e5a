"""Protocol Buffers files to message, service and enum chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from chunkloom import config as C
from chunkloom.chunking.text import decode_text

# What opens a block, what is context, what counts as a reference.
BLOCK_OPEN = re.compile(r"^\s*(message|service|enum)\s+(\w+)\s*\{")
CONTEXT_PREFIXES = ("syntax", "package", "import", "option")
RPC_TYPES = re.compile(r"rpc\s+\w+\s*\(\s*(\w+)\s*\)\s*returns\s*\(\s*(\w+)\s*\)")
FIELD_TYPE = re.compile(r"(?:repeated|map\s*<\w+\s*,\s*)?\s*([A-Z]\w+)\s+\w+\s*=\s*\d+")


def references(content: str, kind: str) -> list[str]:
    """Sorted distinct types that a block names: both ends of each rpc, or capitalised field types."""
    if kind == "service":
        return sorted({t for pair in RPC_TYPES.findall(content) for t in pair})
    return sorted(set(FIELD_TYPE.findall(content))) if kind == "message" else []


def blocks(lines: list[str]) -> Iterator[tuple[str, str, int, int]]:
    """Outermost blocks as ``kind, name, first line, last line``; an unclosed one ends behind the file."""
    at = 0
    while at < len(lines):
        m = BLOCK_OPEN.match(lines[at])
        if not m:
            at += 1
            continue
        depth, end = 0, len(lines) + 1
        for n in range(at, len(lines)):
            depth += lines[n].count("{") - lines[n].count("}")
            if depth == 0:
                end = n + 1
                break
        yield m[1], m[2], at + 1, end
        at = end


def chunk_proto(data: bytes, relative_path: str) -> Iterator[dict]:
    """Blocks of at least three lines, each under the file's context lines."""
    lines = decode_text(data).splitlines()
    context = "\n".join(x for x in lines if x.strip().startswith(CONTEXT_PREFIXES))
    header = f"// File: {relative_path}\n" + (f"{context}\n\n" if context else "\n")
    for kind, name, first, last in blocks(lines):
        if last - first < C.MIN_PROTO_SPAN:
            continue
        body = "\n".join(lines[first - 1 : last])
        yield {
            "content": header + body,
            "language": "proto",
            "chunk_type": kind,
            "symbol_name": name,
            "start_line": first,
            "end_line": last,
            "file_start_line": first,
            "symbols_referenced": references(body, kind),
        }
