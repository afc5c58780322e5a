"""Engine settings and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

# File selection.
CODE_EXTENSIONS = (".py", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx")
PDF_EXTENSIONS = (".pdf",)
MARKDOWN_EXTENSIONS = (".md", ".rst")
PROTO_EXTENSIONS = (".proto",)
ALL_EXTENSIONS = CODE_EXTENSIONS + PDF_EXTENSIONS + MARKDOWN_EXTENSIONS + PROTO_EXTENSIONS
EXCLUDED_FILENAMES = ("license.py", "licence.py", "copyright.py", "setup.py", "conf.py")
EXCLUDED_DIRS = ("__pycache__", ".git", ".venv", "venv", "node_modules")
EXCLUDED_ROOT_DIRS = ("Delivery", "Build", "test", "tests", "OSS", "SDD")

# Chunk sizes.
MIN_FUNCTION_SPAN = 3
MIN_PROTO_SPAN = 2
MAX_CHUNK_CHARS = 1700
MIN_CODE_LINES = 3
MAX_CODE_LINES = 10_000
MIN_CODE_DENSITY = 0.1
MIN_SECTION_CHARS = 100

# Patterns.
CHAPTER_TITLE = r"^(?:chapitre\s*)?(\d+(?:\.\d+)*)(?:[\.\s:-]+.*)?$"
CHAPTER_QUESTION = r"(?:chapitre|chapter)\s*(\d+(?:\.\d+)*)"
TRUNCATION_MARK = "\n[... tronqué ...]"
SYMBOL_DISTANCE = 0.5
SYMBOL_LIMIT = 3


@dataclass(frozen=True)
class EngineConfig:
    """Run-time settings, passed explicitly; nothing is read from the environment on import."""

    max_embed_chars: int = 2000
    embed_batch_size: int = 128
    top_k: int = 10
    expansion_depth: int = 1
    max_context_chars: int = 14_000
    file_prompt_chars: int = 6_000
    file_prompt_top_k: int = 6
    max_history_turns: int = 5
    embed_retries: int = 3
    #: Whether indexing other directories than the last time empties the store first.
    clear_on_other_directory: bool = False
    #: A query set up to this many rows is broadcast; a larger one goes in blocks of this size.
    query_block_rows: int = 2_000
