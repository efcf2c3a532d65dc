"""Splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "word", "sentence", "line", "paragraph")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\s+")
_CUTS = {4: _BLANK, 3: _LINE, 2: _SENTENCE, 1: _WORD}


def _stretches(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """Contiguous spans of text[a:b] that end behind each boundary of a level."""
    out, at = [], a
    for m in _CUTS[level].finditer(text, a, b):
        if m.end() < b:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, b))
    return out


def atoms(text: str, room: int, limit: int) -> tuple[list[int], list[int], int]:
    """Starts of the atomic segments, the strength of the boundary before each, and the cut level.

    Atoms are the coarsest stretches of at most ``room`` characters, with hard
    cuts inside what never fits.  The cut level (4 paragraph ... 1 word, 0 none)
    is the finest boundary that had to be cut because a stretch, without white
    space around it, has more than ``limit`` characters; for the whole text white space counts.
    """
    starts, strength = [], []
    needed = 4

    def walk(a: int, b: int, level: int, before: int) -> None:
        nonlocal needed
        if b - a <= room:
            starts.append(a)
            strength.append(before)
            return
        if level < needed and len(text[a:b].strip()) > limit:
            needed = level
        if level == 0:
            for i, x in enumerate(range(a, b, room)):
                starts.append(x)
                strength.append(before if i == 0 else 0)
        else:
            for i, (x, y) in enumerate(_stretches(text, a, b, level)):
                walk(x, y, level - 1, before if i == 0 else level)

    walk(0, len(text), 4, 5)
    return starts, strength, needed


def split_spans(text: str, limit: int = 500, overlap: int = 50) -> tuple[list[tuple[int, int, int]], int | None]:
    """(start, end, strength of the cut before it) of every piece, without its overlap, and the cut level of the atoms
    (see ``atoms``; None for a text within the limit).

    The spans cover the text without gaps.  Adjacent segments sit in a heap by
    (boundary strength, combined size, place) and merge weakest first while the
    combined size plus the overlap fits in ``limit``.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 5)], None
    room = limit - overlap
    starts, strength, level = atoms(text, room, limit)
    k = len(starts)
    end = starts[1:] + [n]
    left, right = list(range(-1, k - 1)), list(range(1, k + 1))
    alive, version = [True] * k, list(range(k))  # a version names one state of one segment
    heap = [(strength[i], end[i] - starts[i - 1], i, i - 1, i) for i in range(1, k) if end[i] - starts[i - 1] <= room]
    heapq.heapify(heap)
    k_version = k
    while heap:
        _, size, i, va, vb = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = left[i]
        if version[j] != va or version[i] != vb:
            continue
        end[j], right[j], alive[i] = end[i], right[i], False
        k_version += 1
        version[j] = k_version
        if right[i] < k:
            left[right[i]] = j
        for a, b in ((left[j], j), (j, right[j])):
            if a >= 0 and b < k and end[b] - starts[a] <= room:
                heapq.heappush(heap, (strength[b], end[b] - starts[a], b, version[a], version[b]))
    return [(starts[i], end[i], strength[i]) for i in range(k) if alive[i]], level


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 500, overlap: int = 50, with_text: bool = True) -> DataFrame:
    """One row per piece of every text of ``df``.

    Columns: key, piece_no, start_pos (1-based, overlap included), n_chars,
    overlap_chars, boundary (level of the cut before the piece), oversized,
    cut_level (coarsest level at which every stretch of the whole text fits the
    limit; null unless oversized) and, ``with_text``, piece.

    Every piece has at most ``limit`` characters and begins with exactly the
    last ``overlap`` characters of the one before, or with all of it where it
    has fewer (a short first piece), as overlap_chars says; without the
    overlaps the pieces join to the original text.  Null texts give no rows, the empty text
    one empty piece, repeated keys are split each on their own.  Row-local: one
    Arrow pass, no shuffle; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_key"].to_numpy(), b["_text"].to_numpy()):
                big = len(t) > limit
                spans, level = split_spans(t, limit, overlap)
                level = None if level is None else LEVELS[level]
                for i, (x, y, s) in enumerate(spans):
                    o = min(overlap, x)
                    rows.append((k, i, x - o + 1, y - x + o, o, "start" if i == 0 else LEVELS[s], big, level, *((t[x - o : y],) if with_text else ())))
            yield pd.DataFrame(rows, columns=names)

    names = [key, "piece_no", "start_pos", "n_chars", "overlap_chars", "boundary", "oversized", "cut_level", *(["piece"] if with_text else [])]
    kind = dict(src.dtypes)["_key"]
    schema = f"`{key}` {kind}, piece_no int, start_pos int, n_chars int, overlap_chars int, boundary string, oversized boolean, cut_level string" + (", piece string" if with_text else "")
    return src.mapInPandas(run, schema)
