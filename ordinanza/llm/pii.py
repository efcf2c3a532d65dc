"""Personal information in free text: a character BiLSTM-CRF finds it, typed placeholders replace it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charcrf

WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
WINDOW, OVERLAP, BATCH = 512, 64, 256
_MODEL: dict = {}


def load(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    if path not in _MODEL:
        with np.load(path) as z:
            _MODEL[path] = {k: z[k].astype(np.float32) for k in z.files}
    return _MODEL[path]


def _windows(ids: list[np.ndarray]):
    """(document, start) of overlapping windows that cover every text."""
    doc, start = [], []
    for n, x in enumerate(ids):
        at = 0
        while len(x):
            doc.append(n)
            start.append(at)
            if at + WINDOW >= len(x):
                break
            at += WINDOW - OVERLAP
    return doc, start


def tag_texts(texts: list[str], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Tag numbers of every character of every text.

    Texts are cut into windows of 512 characters that overlap by 64.  Windows
    are decoded in batches sorted by length; of two windows over one character
    the one with the longer context to its edge decides, so that the seams of
    all windows are reconciled over the whole text.
    """
    ids = [charcrf.encode(t).astype(np.int16) for t in texts]
    doc, start = _windows(ids)
    out = [np.zeros(len(x), np.int8) for x in ids]
    size = [min(WINDOW, len(ids[d]) - s) for d, s in zip(doc, start)]
    order = sorted(range(len(doc)), key=size.__getitem__)
    for lo in range(0, len(order), BATCH):
        part = order[lo : lo + BATCH]
        x = np.zeros((max(size[i] for i in part), len(part)), np.int16)
        for c, i in enumerate(part):
            x[: size[i], c] = ids[doc[i]][start[i] : start[i] + size[i]]
        tags = charcrf.decode(model, x)
        for c, i in enumerate(part):
            a, b = start[i], start[i] + size[i]
            lo_, hi = a + (OVERLAP // 2 if a else 0), b - (0 if b == len(ids[doc[i]]) else OVERLAP // 2)
            out[doc[i]][lo_:hi] = tags[lo_ - a : hi - a, c]
    return out


def raw_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tagged runs; a run that continues one of its kind without O between is joined."""
    if not tags.any():
        return []
    kind = (tags + 1) // 2
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        if kind[a]:
            begins = [a, *(a + 1 + np.flatnonzero(tags[a + 1 : b] % 2 == 1))]
            for x, y in zip(begins, [*begins[1:], b]):
                out.append((int(x), int(y), charcrf.KINDS[kind[a] - 1]))
    return out


# -- exact checks of the tagged spans ------------------------------------------

_AT = r"(?:@|\s?[\[(]at[\])]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"[^\W_](?:[\w.+'-]*\w)?{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+", re.I)
PHONE = re.compile(r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,10}(?:[\s./-]\d{2,6}){0,4}|\+?1[\s.-]?\(?\d{3}\)?[\s./-]?\d{3}[\s.-]?\d{4}")
IDENT = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]\d{7,8}[A-Z]?|\d{7,8}[- ]?[A-Z]|[A-Z]{3} \d{4} \d{4}|[A-Z]{2}-\d{4}-\d{4}")
_SOCIAL = re.compile(r"\d{3}-\d{2}-\d{4}")
_SHORT_WAYS = r"st|ln|rd|ave|blvd|dr|pl|ct|cir|pkwy|hwy|ter|sq"
_WAYS = (
    r"street|st|lane|ln|road|rd|avenue|ave|boulevard|blvd|drive|dr|terrace|place|pl|court|ct|way|circle|cir|parkway|pkwy|trail|crescent|close|row|"
    r"square|sq|loop|alley|walk|highway|hwy|path|mews|grove|hill|ridge|run|bend|pike|gardens|green"
)
ADDRESS = re.compile(
    rf"\d{{1,5}}(?:-\d{{1,3}}|[a-z])?(?:\s\d/\d)?\s(?:[nsew]\.?\s|north\s|south\s|east\s|west\s)?(?:[^\W\d_][\w'’-]*\s){{1,3}}?(?:(?:{_SHORT_WAYS})\b\.?|(?:{_WAYS})\b)(?:\s(?-i:(?=[A-Z][a-z]))(?:{_WAYS})\b)?"
    r"|(?:calle|paseo|avenida|plaza|camino)\s(?:[^\W\d_][\w'’-]*\s){1,3}?\d{1,5}\b",
    re.I,
)
_PART = r"[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*"
NAME = re.compile(rf"{_PART},\s+{_PART}(?:\s+[^\W\d_]\.)?|(?:{_PART}|[^\W\d_]\.)(?:\s+[^\W\d_]\.)?\s+{_PART}|{_PART}", re.U)
TITLE = re.compile(r"(?:(?:mr|mrs|ms|mx|dr|rev|sr|sra|srta|fr|prof|hon)\.|don|doña)\s+", re.I)
CLOSING = re.compile(r"(?:yours|sincerely|regards|respectfully|thanks|cordially|best)(?:\s+\w+)?,\s+", re.I)
_NOT_A_NAME = re.compile(rf"\s+({_WAYS}|plaza|hall|room|reading|park|works|trust|pier|bridge)\b", re.I)
# Months, which are no name by themselves, and words that are no part of a name.
_MONTHS = frozenset(
    "january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre "
    "octubre noviembre diciembre".split()
)
_NEVER = frozenset(
    "the of and to in a is that for it as was with be by on not are or from at which but have had they were before after between "
    "under section explain suppose meanwhile neither choose last monday tuesday wednesday thursday friday saturday sunday".split()
)
_RULES = {"email": EMAIL, "phone": PHONE, "id": IDENT, "address": ADDRESS}
_WORDISH = re.compile(r"[\w'’-]")


def check_span(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact bounds of a tagged span, or None where it cannot be of its kind.

    The span is matched against the form of its kind inside a margin around it,
    which grows until the match ends inside it; the match that covers most of
    the span decides, so that a start or end that the tagger missed is put right.
    """
    if kind == "name":
        return _check_name(text, a, b)
    room = 40
    while True:
        lo, hi = max(0, a - room), min(len(text), b + room)
        best = _best_match(text, a, b, lo, hi, kind)
        whole = lo == 0 and hi == len(text)
        if whole or (best and lo < best[0] and best[1] < hi) or (not best and room > 4 * (b - a) + 1000):
            return best and best[:2]
        room *= 4


def _best_match(text: str, a: int, b: int, lo: int, hi: int, kind: str) -> tuple[int, int, int] | None:
    best = None
    for m in _RULES[kind].finditer(text, lo, hi):
        x, y = m.span()
        cover = min(y, b) - max(x, a)
        if cover <= 0:
            continue
        # not inside a longer token, number or amount
        before, after = text[x - 1 : x], text[y : y + 1]
        if (before and (before.isalnum() or before in "@_$#§")) or (after and (after.isalnum() or after in "@_")):
            continue
        if kind in ("phone", "id") and (re.search(r"\d[-./]$", text[max(0, x - 2) : x]) or re.match(r"[-/.]\d", text[y : y + 2])):
            continue
        if kind == "phone" and sum(c.isdigit() for c in text[x:y]) < 7:
            continue
        if best is None or cover > best[2]:
            best = (x, y, cover)
    return best


def _check_name(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and not text[a].isalpha():
        a += 1
    while a > 0 and _WORDISH.match(text[a - 1]):
        a -= 1
    while b > a and not text[b - 1].isalnum() and text[b - 1] != ".":
        b -= 1
    while b < len(text) and _WORDISH.match(text[b]) and text[b - 1] != ".":
        b += 1
    m = TITLE.match(text, a)
    if m and m.end() < b:
        a = m.end()
    m = CLOSING.match(text, a)
    if m and m.end() < b:
        a = m.end()
    m = NAME.match(text, a)
    if not m or text[a : a + 1] == "":
        return None
    m = _NOT_A_NAME.match(text, max(m.end(), b))
    if m and (m.group(1)[0].isupper() or text[a:b].islower()):
        return None
    if a and text[a - 1] in "@.+_" or text[b : b + 1] in ("@", "_"):
        return None
    parts = re.findall(r"[^\W\d_]{2,}", text[a:b].lower())
    if any(w in _NEVER for w in parts) or all(w in _MONTHS for w in parts) or parts[-1:] and parts[-1] in _MONTHS and re.match(r"\.?\s*\d", text[b : b + 4]) or text[a:b].islower() and " " not in text[a:b]:
        return None
    if b - a < 3 or any(c.isdigit() for c in text[a:b]):
        return None
    return a, b


def find_spans(texts: list[str], model: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Checked, non-overlapping spans of every text; where two overlap the longer stays."""
    out = []
    for text, tags in zip(texts, tag_texts(texts, model)):
        got = []
        for a, b, kind in raw_spans(tags):
            s = check_span(text, a, b, kind)
            if not s and kind == "phone":
                s = check_span(text, a, b, "id")
                kind = "id"
            elif s and kind == "phone" and _SOCIAL.fullmatch(text, *s):
                kind = "id"
            if s:
                got.append((*s, kind))
        got.sort(key=lambda s: (s[0] - s[1], s[0], s[2]))
        kept: list[tuple[int, int, str]] = []
        for s in got:
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
        out.append(sorted(kept))
    return out


def redact(text: str, spans) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def _run(df: DataFrame, key: str, text: str, weights: str, rows, schema: str, step: int = 512) -> DataFrame:
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < tasks:  # decoding costs far more than one shuffle of the text
        src = src.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(weights)
        for b in batches:
            keys, texts = b["_k"].to_numpy(), b["_t"].tolist()
            for lo in range(0, len(texts), step):
                part = [t or "" for t in texts[lo : lo + step]]
                yield rows(keys[lo : lo + step], texts[lo : lo + step], find_spans(part, model))

    return src.mapInPandas(run, f"`{key}` {dict(src.dtypes)['_k']}, {schema}")


def find_pii(df: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(key, kind, start_pos, end_pos): every occurrence, positions from 1, the end included.

    Whole texts of any length; null and empty texts give no rows; repeated keys
    are read each on their own; other columns are not read.  Row-local.
    """

    def rows(keys, texts, spans) -> pd.DataFrame:
        return pd.DataFrame([(k, kind, a + 1, b) for k, s in zip(keys, spans) for a, b, kind in s], columns=[key, "kind", "start_pos", "end_pos"])

    return _run(df, key, text, weights, rows, "kind string, start_pos int, end_pos int")


def replace_pii(df: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(key, text with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] in place, n_replaced). A null text stays null."""

    def rows(keys, texts, spans) -> pd.DataFrame:
        return pd.DataFrame({key: keys, text: [None if t is None else redact(t, s) for t, s in zip(texts, spans)], "n_replaced": [len(s) for s in spans]})

    return _run(df, key, text, weights, rows, f"`{text}` string, n_replaced int")
