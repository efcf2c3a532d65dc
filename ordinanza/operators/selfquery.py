"""Structured filters read from a question, pushed down as Catalyst predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SECTION_REF

_OPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
}


def compile_filter(spec: str | dict) -> Column:
    """A predicate from JSON such as {"and": [{"eq": ["section", "7.04.010"]}, ...]}."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    (op, args), = spec.items()
    if op in ("and", "or"):
        parts = [compile_filter(a) for a in args]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~compile_filter(args)
    name, value = args
    return _OPS[op](F.col(name), value)


def self_query(questions: DataFrame, docs: DataFrame, key: str, take: int = 8) -> DataFrame:
    """Documents whose section is one that the question names: (question_id, key, section, rank).

    The offline reading of a question is its section references; an equi-join on
    the section does the filtering, so a hot section is split by AQE.
    """
    from pyspark.sql import Window

    refs = questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(SECTION_REF), 1))).alias("section"))
    hits = refs.join(docs.select(key, "section"), "section")
    w = Window.partitionBy("question_id").orderBy(key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take).select("question_id", key, "section", "rank")
