"""Bounded context and prompt of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview


def format_context(docs: DataFrame, question: str, max_docs: int = 8, max_chars: int = 1000) -> DataFrame:
    """(question, context): of the first ``max_docs`` by rank, the first of every
    section, each cut at ``max_chars``, joined by blank lines.  At most
    ``max_docs`` values meet in a group."""
    d = docs.where(F.col("rank") <= max_docs).withColumn("_s", F.coalesce("section", F.lit("Unknown")))
    w = Window.partitionBy(question, "_s").orderBy("rank")
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    part = F.concat(F.lit("Section "), F.col("_s"), F.lit(":\n"), preview(F.coalesce("content", F.lit("")), max_chars))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return d.groupBy(question).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Answer the question from the sections below and cite their numbers. Say which further sections are needed if these do not suffice.\n\nQuestion: "),
        question,
        F.lit("\n\nSections:\n"),
        context,
        F.lit("\n\nAnswer:"),
    )
