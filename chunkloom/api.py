"""The Python interface: index, query, clear, statistics; language model calls are pluggable."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.chunking.dispatch import chunk_files
from chunkloom.config import EngineConfig
from chunkloom.embed import Embedder, embed_batch, hashing_embedder
from chunkloom.operators import context, expand, search, upsert
from chunkloom.functions.columns import question_chapter
from chunkloom.session import cut_lineage, release
from chunkloom.sources.tree import scan_directories, with_contents
from chunkloom.store import ChunkStore


@dataclass
class IndexReport:
    directory: str
    files_found: int = 0
    files_indexed: int = 0
    files_cached: int = 0
    chunks_generated: int = 0
    chunks_embedded: int = 0
    failed_files: list[str] = field(default_factory=list)

    def summary(self) -> str:
        """The report as text; at most ten failed files are named."""
        lines = [f"Index of {self.directory}", f"  files found      : {self.files_found}", f"  files indexed    : {self.files_indexed}", f"  files cached     : {self.files_cached}", f"  chunks generated : {self.chunks_generated}", f"  chunks embedded  : {self.chunks_embedded}"]
        if self.failed_files:
            lines.append(f"  failed files     : {len(self.failed_files)}")
            lines += [f"    - {p}" for p in self.failed_files[:10]]
            if len(self.failed_files) > 10:
                lines.append(f"    ... and {len(self.failed_files) - 10} more")
        return "\n".join(lines)


class Engine:
    """Indexing and retrieval over one store."""

    def __init__(self, spark: SparkSession, store_path: str, embedder: Embedder | None = None, llm: Callable[[str], str] | None = None, config: EngineConfig | None = None):
        self.spark = spark
        self.store = ChunkStore(spark, store_path)
        self.embedder = embedder or hashing_embedder()
        self.llm = llm
        self.config = config or EngineConfig()
        self.history: list[dict] = []
        self._directories: list[str] | None = None

    # -- indexing

    def index_directories(self, directories: list[str], recursive: bool = True, force_reindex: bool = False, purge_missing: bool = False) -> IndexReport:
        """Scans, chunks, embeds and stores what changed; ``purge_missing`` also drops files that are gone."""
        if force_reindex or self.config.clear_on_other_directory and self._directories not in (None, sorted(directories)):
            self.store.clear()
        self._directories = sorted(directories)
        files = cut_lineage(upsert.latest_per_key(scan_directories(self.spark, directories, recursive, content=False), "path", "file_hash"))
        changed = with_contents(self.store.changed_files(files))
        chunks = cut_lineage(chunk_files(changed).join(files.select(F.col("path").alias("file_path"), "directory"), "file_path", "left"))
        embedded = self.store.upsert(chunks, self.embedder, self.config)
        here = files.select(F.col("path").alias("file_path"))
        if purge_missing:
            self.store.delete_files(self.store.file_hashes().join(here, "file_path", "left_anti"))
        found = files.count()
        failed = [r[0] for r in chunks.where("error is not null").select("file_path").distinct().orderBy("file_path").toLocalIterator()]
        indexed, generated = self.store.chunks().join(here, "file_path", "left_semi").agg(F.countDistinct("file_path"), F.count(F.lit(1))).first()
        release(files, chunks)
        return IndexReport(", ".join(map(str, directories)), found, indexed, found - indexed - len(failed), generated, embedded, failed)

    def index_directory(self, directory: str, recursive: bool = True, force_reindex: bool = False) -> IndexReport:
        return self.index_directories([directory], recursive, force_reindex)

    def debug_chunks(self, path: str, root: str) -> list[dict]:
        """Chunks of one file without indexing it."""
        files = scan_directories(self.spark, [root], only_selected=False).where(F.col("path") == path)
        return [r.asDict() for r in chunk_files(files).collect()]

    # -- retrieval

    def retrieve(self, question: str, top_k: int | None = None, language: str | None = None, expand_deps: bool = True, depth: int | None = None) -> DataFrame:
        """Hits of a question in order: ``..., distance, pos``; a chapter in the question filters, with fallback."""
        k = top_k or self.config.top_k
        chunks = self.store.chunks()
        got = embed_batch([question], self.embedder, 10**9, self.config.embed_retries)
        vector = got[0] if got else []
        chapter = self.spark.range(1).select(question_chapter(F.lit(question))).first()[0]
        where = F.lit(True) if language is None else F.col("language") == language
        pool = chunks.where(where)
        if chapter:
            hits = search.topk_with_fallback(pool, vector, k, "chunk_id", "embeddings", F.col("chapter") == chapter)
        else:
            hits = search.topk(pool, vector, k, "chunk_id", "embeddings")
        from pyspark.sql import Window as W

        hits = cut_lineage(hits.withColumn("pos", F.row_number().over(W.partitionBy().orderBy("distance", "chunk_id")) - 1))
        if not expand_deps:
            return hits
        more = expand.expand_dependencies(chunks, hits, depth if depth is not None else self.config.expansion_depth)
        return more.join(chunks.drop("file_path", "start_line", "symbol_name", "symbols_referenced"), "chunk_id")

    def build_prompt(self, question: str, top_k: int | None = None, max_chars: int | None = None, expand_deps: bool = True, language: str | None = None) -> tuple[str, int]:
        """The prompt and the number of retrieved chunks."""
        hits = self.retrieve(question, top_k, language, expand_deps).withColumn("question_id", F.lit(1))
        q = self.spark.createDataFrame([(1, question)], "question_id int, question string")
        r = context.prompts(q, hits, max_chars or self.config.max_context_chars).first()
        return r["prompt"], r["n_chunks"]

    def build_file_prompt(self, path: str, text: str, user_prompt: str) -> str:
        """A prompt about one file: the context retrieved for it, if any, the request, the file's name and its fenced text."""
        hits = self.retrieve(f"{user_prompt} file:{path}", self.config.file_prompt_top_k).withColumn("question_id", F.lit(1))
        blocks = context.within_budget(context.with_blocks(hits), self.config.file_prompt_chars, "question_id").orderBy("rank").select("text").collect()
        return context.file_prompt("\n".join(r[0] for r in blocks), user_prompt, path, text)

    def query(self, question: str, expand_deps: bool = True) -> str:
        """An answer to a question; the last turns go before the prompt, not into retrieval."""
        prompt, n = self.build_prompt(question, expand_deps=expand_deps)
        past = "".join(f"Q: {t['question']}\nR: {t['answer']}\n\n" for t in self.history[-self.config.max_history_turns :])
        if self.llm is None:
            return past + prompt
        try:
            answer = self.llm(past + prompt)
        except Exception as e:
            answer = f"error: {e}"
        self.history.append({"question": question, "answer": answer})
        return answer

    def get_chunks_by_symbol(self, symbol: str, limit: int = 3) -> DataFrame:
        return expand.symbol_table(self.store.chunks().where(F.col("symbol_name") == symbol), limit).withColumn("distance", F.lit(0.5))

    # -- store

    def delete_file(self, path: str) -> None:
        self.store.delete_files([path])

    def clear(self) -> None:
        self.store.clear()
        self.history.clear()

    def stats(self) -> dict:
        return self.store.stats()

    # -- tool calls

    def call_tool(self, name: str, arguments: dict) -> str:
        """The tools ``clean``, ``index`` and ``query``; another name raises ``ValueError``."""
        if name == "clean":
            self.clear()
            return "index cleared"
        if name == "index":
            return self.index_directory(arguments["directory"], force_reindex=bool(arguments.get("force_reindex", False))).summary()
        if name == "query":
            return self.query(arguments["question"]) if self.stats()["total_chunks"] else "the index is empty"
        raise ValueError(f"unknown tool: {json.dumps(name)}")
