"""Two-pass answering of a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .context import answer_prompt, format_context
from .search import exclude_seen

Search = Callable[[DataFrame], DataFrame]


def fallback_merge(docs: DataFrame, fallback: DataFrame, question: str, few: int = 5, take: int = 8, total: int = 12) -> DataFrame:
    """Append fallback hits of unseen sections to questions with fewer than
    ``few`` documents; repeats among the fallback hits stay."""
    n = docs.groupBy(question).agg(F.count("*").alias("_n"))
    fb = fallback.where(F.col("rank") <= take).join(n, question, "left").where(F.coalesce("_n", F.lit(0)) < few).drop("_n")
    new = exclude_seen(fb, docs, question, ["rank"], once=False)
    return _append(docs, new, question).where(F.col("rank") <= total)


def second_pass_merge(docs: DataFrame, found: DataFrame, question: str) -> DataFrame:
    """Append the first hit of every section that the question has not seen."""
    return _append(docs, exclude_seen(found, docs, question, ["rank"], once=True), question)


def _append(docs: DataFrame, new: DataFrame, question: str) -> DataFrame:
    cols = [question, "rank", "section", "content"]
    both = docs.select(*cols, F.lit(0).alias("_part")).unionByName(new.select(*cols, F.lit(1).alias("_part")))
    w = Window.partitionBy(question).orderBy("_part", "rank", "section", "content")
    return both.withColumn("rank", F.row_number().over(w))


def ask(questions: DataFrame, docs: DataFrame, second: Search, generate: Callable[[Column, Column, Column], Column], barrier: Callable[[DataFrame], DataFrame],
        fallback: DataFrame | None = None) -> DataFrame:
    """(question_id, success, documents, n_documents, answer, error, iterations, note).

    ``docs`` are the ranked first-pass documents (question_id, rank, section,
    content); questions with fewer than 5 of them get the hits of ``fallback``,
    the structured search, of sections they have not seen.  ``generate`` maps
    (question_id, prompt, context) to a struct (answer, error).  The answers of
    each pass go through ``barrier``, which must materialise them, so that a
    costly model sees every prompt once.  ``second`` maps (question_id,
    term_ord, term) to ranked hits (question_id, rank, section, content).

    Outcomes: no document: no success, 0 iterations.  A model error in either
    pass: no success, the first-pass documents, the error, 1 iteration.  An
    answer that wants more and gets new sections: 2 iterations, all documents.
    An answer that wants more and gets none: 1 iteration and a note.
    """
    docs = docs.select("question_id", "rank", "section", "content")
    if fallback is not None:
        docs = barrier(fallback_merge(docs, fallback, "question_id"))
    ctx = format_context(docs, "question_id")
    reply = generate(F.col("question_id"), answer_prompt(F.col("question"), F.col("context")), F.col("context"))
    first = barrier(questions.join(ctx, "question_id").select("question_id", "question", reply.alias("r")).select("question_id", "question", "r.answer", "r.error"))
    more = first.where(scores.needs_more(F.col("answer")))
    terms = more.select("question_id", F.posexplode(scores.quick_terms(F.col("answer"), F.col("question"))).alias("term_ord", "term"))
    found = exclude_seen(second(terms), docs, "question_id", ["rank"], once=True).select("question_id", "rank", "section", "content")
    merged = _append(docs.join(found.select("question_id").distinct(), "question_id", "left_semi"), found, "question_id")
    merged = barrier(merged)
    again = format_context(merged, "question_id").join(questions, "question_id").select("question_id", reply.alias("r"))
    again = barrier(again.select("question_id", F.col("r.answer").alias("answer_2"), F.col("r.error").alias("error_2"), F.lit(True).alias("_second")))
    failed = first.where("error is not null").select("question_id").unionByName(again.where("error_2 is not null").select("question_id"))
    kept = merged.join(failed, "question_id", "left_anti")
    every = docs.join(kept.select("question_id").distinct(), "question_id", "left_anti").unionByName(kept)
    parts = F.array_sort(F.collect_list(F.struct("rank", "section", "content")))
    lists = every.groupBy("question_id").agg(F.transform(parts, lambda d: F.struct(d["section"].alias("section"), d["content"].alias("content"))).alias("documents"))
    out = questions.select("question_id").join(first.drop("question"), "question_id", "left").join(again, "question_id", "left").join(lists, "question_id", "left")
    found_any, fault = F.col("documents").isNotNull(), F.coalesce("error", "error_2")
    second_used = F.coalesce("_second", F.lit(False)) & fault.isNull()
    return out.select(
        "question_id",
        (found_any & fault.isNull()).alias("success"),
        F.coalesce("documents", F.expr("cast(array() as array<struct<section: string, content: string>>)")).alias("documents"),
        F.when(found_any, F.size("documents")).otherwise(0).cast("int").alias("n_documents"),
        F.when(fault.isNull(), F.coalesce("answer_2", "answer")).alias("answer"),
        F.when(~found_any, F.lit("No relevant documents found")).when(fault.isNotNull(), F.concat(F.lit("Error generating response: "), fault)).alias("error"),
        F.when(~found_any, 0).when(second_used, 2).otherwise(1).cast("int").alias("iterations"),
        F.when(found_any & fault.isNull() & ~second_used & scores.needs_more(F.col("answer")), F.lit("Comprehensive search completed")).alias("note"),
    )
