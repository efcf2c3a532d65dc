"""The additive relevance score and the lexicon-driven expansions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import SECTION_REF, SPACE, contains_any, first_match, strings, strip, tokens


def section_bonus(section: Column, table=L.SECTION_BONUS) -> Column:
    """Points of the first matching prefix; 0 without a section."""
    s, out = F.coalesce(section, F.lit("")), None
    for prefix, points in table:
        out = F.when(s.startswith(prefix), points) if out is None else out.when(s.startswith(prefix), points)
    return out.otherwise(0)


def quality_bonus(content: Column, table=L.QUALITY_BONUS) -> Column:
    """Sum of the points of every group with a phrase in the lower-cased content."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return sum((F.when(contains_any(low, ps), n).otherwise(0) for n, ps in table), F.lit(0))


def word_match(question: Column, content: Column) -> Column:
    """Number of distinct lower-cased, space-separated tokens that both texts have."""
    q, c = (tokens(F.lower(F.coalesce(x, F.lit("")))) for x in (question, content))
    return F.size(F.array_intersect(q, c))


def relevance(question: Column, section: Column, content: Column) -> Column:
    return word_match(question, content) + section_bonus(section) + quality_bonus(content)


def expand(question: Column, topics=L.QUESTION_TOPICS, cap: int = 6) -> Column:
    """The question followed by the variants of every matching topic, at most ``cap``."""
    low = F.lower(question)
    parts = [F.array(question)] + [F.when(contains_any(low, t), strings(v)).otherwise(strings([])) for t, v in topics]
    return F.slice(F.concat(*parts), 1, cap)


def k_per_query(queries: Column, k: int) -> Column:
    return F.greatest(F.lit(2), F.expr(f"{k}") / F.size(queries)).cast("int")


def needs_more(answer: Column, phrases=L.NEEDS_MORE) -> Column:
    return contains_any(F.lower(F.coalesce(answer, F.lit(""))), phrases)


def section_refs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION_REF), 1)


def section_refs_all(text: Column) -> Column:
    """Distinct references written as 'Section N', bare, or 'Chapter N.N', sorted."""
    t = F.coalesce(text, F.lit(""))
    pats = [
        r"(?i)section\s+(\d+\.\d+\.\d+(?:\.\d+)*)",
        r"(?i)\b(\d+\.\d+\.\d+(?:\.\d+)*)\b",
        r"(?i)chapter\s+(\d+\.\d+)",
    ]
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), 1) for p in pats])))


def search_terms(text: Column) -> Column:
    """What follows 'SEARCH:' and white space, line ends too, up to the end of that line; trimmed, empty ones dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)search:{SPACE}*([^\n]+)"), 1)
    return F.filter(F.transform(found, strip), lambda t: t != "")


def quick_terms(answer: Column, question: Column, topics=L.QUICK_TOPICS) -> Column:
    """At most two section references of the answer and one search of the question's topic."""
    topic = first_match(F.lower(F.coalesce(question, F.lit(""))), topics, lambda t: strings([t]))
    return F.slice(F.concat(F.slice(section_refs(answer), 1, 2), F.coalesce(topic, strings([]))), 1, 3)


def topic_searches(question: Column, answer: Column, topics=L.TOPIC_SEARCHES, cap: int = 4) -> Column:
    """Searches of the first topic in the question, then of what the answer says."""
    q, a = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))
    none = strings([])
    says = [
        (a.contains("public decency"), L.CONTEXT_DECENCY),
        (a.contains("permit") & a.contains("required"), L.CONTEXT_PERMIT),
        (a.contains("zoning"), L.CONTEXT_ZONING),
        (~a.contains("prohibited") & ~a.contains("allowed"), L.CONTEXT_SILENT),
    ]
    parts = [F.coalesce(first_match(q, topics, strings), none)] + [F.when(t, strings(v)).otherwise(none) for t, v in says]
    return F.slice(F.concat(*parts), 1, cap)


def extra_terms(question: Column, answer: Column, model_output: Column, cap: int = 5) -> Column:
    """References of the answer, topic searches and the model's SEARCH lines; the
    first of terms that differ only in case is kept."""
    refs = F.transform(section_refs_all(answer), lambda r: r)
    every = F.concat(refs, topic_searches(question, answer), search_terms(model_output))
    kept = F.aggregate(
        every,
        strings([]),
        lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )
    return F.slice(kept, 1, cap)
