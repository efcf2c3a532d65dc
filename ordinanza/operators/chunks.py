"""Recursive character chunker and the parent/child expansion."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, size: int, seps: tuple[str, ...]) -> list[str]:
    """Cut at the first separator that occurs; it stays at the start of the next piece."""
    for i, sep in enumerate(seps):
        if sep == "":
            return list(text)
        if sep in text:
            head, *tail = text.split(sep)
            parts = [p for p in [head, *(sep + t for t in tail)] if p]
            out: list[str] = []
            for p in parts:
                out.extend([p] if len(p) <= size else _pieces(p, size, seps[i + 1 :]))
            return out
    return [text]


def chunk_spans(text: str, size: int = 500, overlap: int = 200, seps: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, chunk) of the chunks of ``chunk_text``; start is where the chunk begins in the text, from 0."""
    if not text:
        return []
    out, cur, length, at = [], [], 0, 0
    for p in _pieces(text, size, seps):
        if cur and length + len(p) > size:
            out.append((at - length, "".join(cur)))
            while cur and (length > overlap or length + len(p) > size):
                length -= len(cur.pop(0))
        cur.append(p)
        length += len(p)
        at += len(p)
    out.append((at - length, "".join(cur)))
    return [(i + len(c) - len(c.lstrip()), c.strip()) for i, c in out if c.strip()]


def chunk_text(text: str, size: int = 500, overlap: int = 200, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters; each repeats at most ``overlap``
    characters of the one before, in whole pieces.  Stripped; empty ones dropped."""
    return [c for _, c in chunk_spans(text, size, overlap, seps)]


def expand_children(parents: DataFrame, key: str, text: str, *inherit: str, size: int = 500, overlap: int = 200) -> DataFrame:
    """One row per chunk of every parent: (key, *inherit, chunk_no, chunk).

    Arrow batches, one pass, no shuffle; null texts give no rows.
    """
    cols = [key, *inherit]
    src = parents.select(*cols, F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [chunk_text(t, size, overlap) for t in b.pop("_text")]
            times = [len(x) for x in lists]
            out = pd.DataFrame({c: b[c].to_numpy().repeat(times) for c in b})
            out["chunk_no"] = [i for x in lists for i in range(len(x))]
            out["chunk"] = [c for x in lists for c in x]
            yield out

    fields = ", ".join(f"`{c}` {t}" for c, t in src.drop("_text").dtypes)
    return src.mapInPandas(run, f"{fields}, chunk_no int, chunk string")


def expand_pages(pages: DataFrame, doc: str, page: str, text: str, size: int = 500, overlap: int = 200) -> DataFrame:
    """One row per chunk of every document: (doc, page, chunk_no, chunk).

    The pages of a document are joined by line ends and cut as one text, so that
    overlaps cross page ends and chunk_no runs over the document; ``page`` is
    the page on which the chunk begins.  A task holds the text of one document;
    null texts and null documents give no rows.
    """
    src = pages.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("_ps"))
    src = src.select(F.col(doc).alias("_d"), F.col("_ps.p").alias("_p"), F.col("_ps.t").alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, numbers, texts in zip(b["_d"], b["_p"], b["_t"]):
                starts = [0, *accumulate(len(t) + 1 for t in texts)][:-1]
                for i, (at, c) in enumerate(chunk_spans("\n".join(texts), size, overlap)):
                    rows.append((d, numbers[bisect_right(starts, at) - 1], i, c))
            yield pd.DataFrame(rows, columns=[doc, page, "chunk_no", "chunk"])

    kinds = dict(pages.dtypes)
    return src.mapInPandas(run, f"`{doc}` {kinds[doc]}, `{page}` {kinds[page]}, chunk_no int, chunk string")
