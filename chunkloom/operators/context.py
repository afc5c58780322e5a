"""Context blocks, character budget, prompts and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkloom import config as C
from chunkloom.session import cut_lineage


#: Characters that a block of :func:`with_blocks` has at least: its header without names.
LEAST_HEADER = 21
#: Turns of one range of :func:`history_window`.
HISTORY_SPAN = 10_000
#: Parts of a question's prompt.
INSTRUCTION = "Tu analyses une base de code. Les extraits ci-dessous en proviennent.\n\n"
SEPARATOR = "\n\n---\n"
CLOSING = "\n\nAppuie ta réponse sur ces extraits et nomme les fichiers et symboles utiles."
NO_CONTEXT = "\n\n(Aucun extrait trouvé : la base est peut-être vide.)"


def file_prompt(found: str, request: str, path: str, text: str) -> str:
    """Context, request, file name and fenced text; without context the first part is left out."""
    head = f"Extraits de la base de code :\n{found}\n\n" if found else ""
    return f"{head}{request}\n\nFichier {path} :\n\n```\n{text}\n```"


def block_header() -> Column:
    """``\\n--- [LANG] symbol Chapitre c | rel L1–9 ---\\n`` of a hit."""
    chapter = F.coalesce(F.col("chapter"), F.lit(""))
    return F.concat(
        F.lit("\n--- ["),
        F.upper(F.coalesce("language", F.lit(""))),
        F.lit("] "),
        F.coalesce("symbol_name", F.lit("")),
        F.when(chapter != "", F.concat(F.lit(" Chapitre "), chapter)).otherwise(""),
        F.lit(" | "),
        F.coalesce("relative_path", F.lit("")),
        F.lit(" L"),
        F.coalesce(F.col("start_line").cast("string"), F.lit("?")),
        F.lit("–"),
        F.coalesce(F.col("end_line").cast("string"), F.lit("?")),
        F.lit(" ---\n"),
    )


def with_blocks(hits: DataFrame) -> DataFrame:
    return hits.withColumn("header", block_header()).withColumn("block", F.concat("header", F.coalesce("content", F.lit(""))))


def within_budget(hits: DataFrame, max_chars: int, group: str, order: tuple[str, ...] = ("distance", "pos"), least: int = LEAST_HEADER) -> DataFrame:
    """Blocks of each ``group`` that fit into ``max_chars``, in order; the first that does not is cut.

    A running sum finds the boundary.  The boundary block stays, shortened and marked, if more room is
    left than its header and 100 characters; nothing after it is tried.  A null distance counts as 1.
    A block has at least ``least`` characters, so blocks beyond the first ``max_chars / least + 1`` of a group
    cannot matter; each task drops them before the shuffle.
    """
    w = W.partitionBy(group).orderBy(F.coalesce(F.col(order[0]), F.lit(1.0)), *order[1:])
    rows = hits.withColumn("__size", F.length("block"))
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_chars // least + 1).drop("__n")
    rows = rows.withColumn("__cum", F.sum("__size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    left = F.lit(max_chars) - (F.col("__cum") - F.col("__size"))
    fits = F.col("__cum") <= max_chars
    cut = (~fits) & (left >= 0) & (left > F.length("header") + 100)
    prior_over = F.max((F.col("__cum") > max_chars).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("__prior", F.coalesce(prior_over, F.lit(0)))
        .where(fits | (cut & (F.col("__prior") == 0)))
        .withColumn("truncated", ~fits)
        .withColumn("text", F.when(fits, F.col("block")).otherwise(F.concat(F.expr(f"substring(block, 1, {max_chars} - (__cum - __size))"), F.lit(C.TRUNCATION_MARK))))
        .withColumn("rank", F.row_number().over(w))
        .drop("__cum", "__prior", "__size")
    )


def prompts(questions: DataFrame, hits: DataFrame, max_chars: int, group: str = "question_id") -> DataFrame:
    """One row per question: ``<group>, prompt, n_chunks``; ``n_chunks`` counts what was retrieved.

    A prompt is an instruction, the context, a separator, the question and a closing request.  A question
    without hits gets a fixed text and 0.  ``questions`` has ``<group>, question``.
    """
    kept = within_budget(with_blocks(hits), max_chars, group)
    parts = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    context = parts.select(group, F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("context"))
    counts = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    full = F.concat(F.lit(INSTRUCTION), F.coalesce("context", F.lit("")), F.lit(SEPARATOR + "Question : "), F.col("question"), F.lit(CLOSING))
    return (
        questions.select(group, "question")
        .join(counts, group, "left")
        .join(context, group, "left")
        .select(
            group,
            F.when(F.col("n").isNull(), F.concat(F.lit("Question : "), F.col("question"), F.lit(NO_CONTEXT))).otherwise(full).alias("prompt"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks"),
        )
    )


def history_window(turns: DataFrame, key: str, order: str, question: str, answer: str, n: int = 5, span: int = HISTORY_SPAN) -> DataFrame:
    """Each turn with the text of at most ``n`` turns before it.

    A conversation may hold a third of all turns.  Turns are put in order by one range sort, which splits a
    conversation over as many tasks as it needs, and are numbered within their range; ranges of ``span`` turns
    then work alone with copies of the ``n`` turns before them.  Null questions and answers are empty texts.
    """
    w = W.partitionBy(key, "__range").orderBy("__at").rowsBetween(-n, -1)
    turn = F.concat(F.lit("Q: "), F.coalesce(question, F.lit("")), F.lit("\nR: "), F.coalesce(answer, F.lit("")), F.lit("\n\n"))
    placed = _numbered(turns, key, order)
    own = placed.withColumn("__range", F.floor(F.col("__at") / span)).withColumn("__own", F.lit(True))
    before = placed.where(F.col("__at") % span >= span - n).withColumn("__range", F.floor(F.col("__at") / span) + 1).withColumn("__own", F.lit(False))
    windowed = own.unionByName(before).withColumn("history", F.array_join(F.collect_list(turn).over(w), ""))
    return windowed.where("__own").drop("__at", "__range", "__own")


def _numbered(turns: DataFrame, key: str, order: str) -> DataFrame:
    """``turns`` with ``__at``, its place within its key, without a task that holds all turns of one.

    Turns are sorted by ranges of ``(key, order)``; each partition numbers its own turns of a key, and the few
    counts per partition and key give the start of each.
    """
    part = cut_lineage(turns.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()))
    inside = part.withColumn("__place", F.row_number().over(W.partitionBy("__part", key).orderBy(order)))
    counts = part.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__c").over(W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    joined = inside.alias("a").join(starts.alias("b"), (F.col("a.__part") == F.col("b.__part")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
    return joined.select("a.*", (F.col("a.__place") + F.col("b.__start") - 1).alias("__at")).drop("__part", "__place")
