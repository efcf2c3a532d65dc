"""``python -m ordinanza TABLES [QUESTION_ID ...]``: answers of the question table, rendered for a terminal.

The engine answers all questions in one batch; only the rows that are shown are collected.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from .functions import text
from .plans import core
from .session import local_session


def main(tables: str, *ids: str) -> None:
    spark = local_session()
    q = spark.read.parquet(f"{tables}/questions.parquet").select("question_id", "question")
    rows = core.ask_sql(spark, tables).join(q, "question_id")
    rows = rows.where(F.col("question_id").isin([int(i) for i in ids])) if ids else rows.orderBy("question_id").limit(10)
    shown = rows.select(
        "question_id",
        "question",
        "iterations",
        F.coalesce("error", F.array_join(text.wrap(text.highlight(text.preview(F.col("answer"), 600), "*", "*"), 88), "\n  ")).alias("shown"),
    )
    for r in shown.collect():
        print(f"[{r.question_id}] {r.question} ({r.iterations} passes)\n  {r.shown}\n")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
