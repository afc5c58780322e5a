"""Command line: python -m chunkloom.cli --store DIR (--index DIR... | --query | --clean | --debug-chunk FILE)."""

from __future__ import annotations

import argparse
import os
import time

from chunkloom.api import Engine
from chunkloom.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chunkloom")
    p.add_argument("--store", default="chunk_store")
    p.add_argument("--index", nargs="+", metavar="DIR")
    p.add_argument("--force", action="store_true")
    p.add_argument("--query", action="store_true")
    p.add_argument("--clean", action="store_true")
    p.add_argument("--debug-chunk", metavar="FILE")
    a = p.parse_args(argv)
    engine = Engine(build_session(), a.store)
    if a.clean:
        engine.clear()
        print("index cleared")
    if a.debug_chunk:
        path = os.path.abspath(a.debug_chunk)
        for c in engine.debug_chunks(path, os.path.dirname(path)):
            print(f"{c['chunk_type']} {c['symbol_name']} L{c['start_line']}-{c['end_line']} {c['symbols_referenced']}")
    if a.index:
        print(engine.index_directories(a.index, force_reindex=a.force).summary())
    if a.query:
        while question := input("> ").strip():
            t = time.time()
            print(engine.query(question, expand_deps=False))
            print(f"({time.time() - t:.1f} s)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
