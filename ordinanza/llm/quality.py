"""Per-document text statistics and line labels by a hidden Markov model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
MAX_LABELS, MAX_LABELLED_LINES, MAX_COMMON = 5_000, 2_000, 10_000

# -- statistics --------------------------------------------------------------

_WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’-]*"


def common_list(words: DataFrame, column: str = "word") -> list[str]:
    """The frequent words, whose number is checked against a fixed bound before they become a literal."""
    rows = words.where(F.col(column).isNotNull()).select(F.lower(column).alias("w")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(r.w for r in rows)


def statistics(text: Column, common: list[str]) -> dict[str, Column]:
    """n_words, mean_word_len, symbol_ratio, punct_line_share and common_share of
    a text.  Lines are those with more than white space.  0 where there is
    nothing to divide by; null for a null text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\s\p{Z}]"))
    n, m, chars = F.size(words), F.size(lines), F.length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))
    ratio = lambda a, b: F.when(text.isNull(), None).when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return {
        "n_words": F.when(text.isNotNull(), n),
        "mean_word_len": ratio(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), n),
        "symbol_ratio": ratio(F.length(F.regexp_replace(text, r"[\s\p{Z}\p{L}\p{M}\p{N}]+", "")), chars),
        "punct_line_share": ratio(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?;:,][\s\p{Z}]*$"))), m),
        "common_share": ratio(F.size(F.filter(words, lambda w: w.isin(common))), n),
    }


# -- observations ------------------------------------------------------------

HEADING = re.compile(r"^[\W_]*(?:section\s+)?\d{1,3}\.\d{1,3}\.\d{1,4}\b", re.I)
_MARK = re.compile(r"^\s*(?:[-*•–·▪o>]\s+|\(?(?:\d{1,3}|[a-z]|[ivxl]{1,6})[.)]\s+)", re.I)
_FIELD = re.compile(r"^\s*[^\W\d_][^\W\d_]*(?:[ /][^\W\d_]+){0,3}\s*(?::|\s=|\s[–—-])\s*\S")
_FIELD_CUT = re.compile(r"\s*[;|]\s*|\s*\n\s*")
_CELLS = re.compile(r"\s*\|\s*|\s*\t\s*|\s*\.{3,}\s*|(?<=\S) {2,}(?=\S)")
_GAP = re.compile(r"[|\t]|\.\.\.|  ")
_SIGNS = re.compile(r"[\W_]+")
_VOWEL = re.compile(r"[aeiouyáéíóúü]", re.I)
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{6,}", re.I)
_ENDS = {".": 1, "!": 1, "?": 1, ";": 2, ",": 2, ":": 3}

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACES = dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")

#: Number of values of each feature: entry (none, mark, field), cells, words, readable (the last: too short to tell), common, ending, symbols.
SIZES = (3, 4, 4, 4, 3, 4, 3)


def _wordlike(tok: str) -> bool:
    t = tok.strip(".,;:!?()[]\"'“”’§$%-–—­​")
    t = t.replace("'", "").replace("’", "").replace("-", "").replace("‐", "")
    if not 2 <= len(t) <= 22 or not t.isalpha() or not _VOWEL.search(t):
        return len(t) == 1 and t in "aAiI"
    if len(t) > 3 and not t.isascii() and sum(c.isascii() for c in t) < 0.6 * len(t):
        return False
    return len(t) > 2 and not _HARD.search(t) or t.lower() in _SHORT


_SHORT = frozenset("of to in is as by or an at on be if no so up we he it do go my me us am".split())
# The frequent function words that the line feature counts.
_COMMON = frozenset(
    "the of and to in a is that for it as was with be by on not are or from at which an any each no may must shall within under over "
    "between every until unless where when before after during los la el de del que en un una y se".split()
)


_TOKENS: dict[str, tuple[bool, bool, bool]] = {}


def _token(t: str) -> tuple[bool, bool, bool]:
    """Whether a token is like a word, an amount, a common word; remembered, as most tokens come again."""
    got = _TOKENS.get(t)
    if got is None:
        amount = t[0] in "$€—" or t[-1] == "%" or t in ("n/a", "R-") or (any(c.isdigit() for c in t) and len(t) <= 10 and not any(c.isalpha() for c in t))
        got = (_wordlike(t), amount, t.lower().strip(".,;:") in _COMMON)
        if len(_TOKENS) > 500_000:
            _TOKENS.clear()
        _TOKENS[t] = got
    return got


def observe(line: str) -> tuple[int, ...]:
    """The feature values of one line."""
    toks = line.split()
    n = len(toks)
    words = amounts = common = 0
    for w, a, c in map(_token, toks):
        words += w
        amounts += a
        common += c
    rest = n - amounts
    readable = words / rest if rest else (1.0 if amounts and n <= 8 else 0.0)
    common = common / n if n else 0
    solid = line.replace(" ", "")
    signs = sum(map(len, _SIGNS.findall(solid))) / len(solid) if solid else 0
    cells = len(_CELLS.findall(line.strip())) if _GAP.search(line) else 0
    return (
        1 if _MARK.match(line) else 2 if _FIELD.match(line) else 0,
        min(cells, 3),
        0 if n <= 3 else 1 if n <= 8 else 2 if n <= 16 else 3,
        3 if n <= 3 and readable < 0.65 else 0 if readable < 0.35 else 1 if readable < 0.65 else 2,
        0 if common == 0 else 1 if common <= 0.2 else 2,
        _ENDS.get(line.rstrip()[-1:], 0),
        0 if signs < 0.12 else 1 if signs < 0.35 else 2,
    )


def units(text: str) -> list[str]:
    """The lines of a text without a heading line; the fields, where it consists of ``Key: value`` fields in a row.
    Invisible characters are dropped and no-break and thin spaces are plain ones."""
    text = _INVISIBLE.sub("", text).translate(_SPACES)
    lines = [x for x in text.split("\n") if x.strip()]
    parts = [p for p in _FIELD_CUT.split(text) if p.strip()]
    if len(parts) >= 2 and sum(bool(_FIELD.match(p)) for p in parts) >= max(2, len(parts) - 1):
        return parts
    if len(lines) > 1 and HEADING.match(lines[0]):
        return lines[1:]
    if lines and HEADING.match(lines[0]):
        return [HEADING.sub("", lines[0], count=1)]
    return lines


# -- the model ---------------------------------------------------------------

PRIOR = 0.5  # the same count for every value of every feature, and for every transition


class LineModel:
    """HMM over line observations with categorical emissions per feature.

    Everything it knows comes from the labelled documents; the prior is the same
    for all values.  Without labels every line is prose, and a kind without
    labels is never given.
    """

    def __init__(self, docs: list[tuple[str, list[tuple[int, ...]]]], rounds: int = 4):
        """``docs``: (kind, observations). All lines begin with the kind of their document;
        lines of a list or table may turn out as prose (lead-ins) in constrained re-estimation."""
        paths = [[KINDS.index(kind)] * len(obs) for kind, obs in docs]
        for n in range(rounds + 1):
            self.emit = [np.full((4, k), PRIOR) for k in SIZES]
            self.trans, self.start = np.full((4, 4), PRIOR), np.full(4, PRIOR)
            for path, (_, obs) in zip(paths, docs):
                for i, (s, o) in enumerate(zip(path, obs)):
                    for f, v in enumerate(o):
                        self.emit[f][s, v] += 1
                    if i:
                        self.trans[path[i - 1], s] += 1
                    else:
                        self.start[s] += 1
            self._logs()
            if n < rounds:
                paths = [self.decode(obs, {0, KINDS.index(kind)} if kind in ("list", "table") else {KINDS.index(kind)}) for kind, obs in docs]

    def _logs(self) -> None:
        self.le = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]
        self.lt = np.log(self.trans / self.trans.sum(1, keepdims=True)).tolist()
        self.ls = np.log(self.start / self.start.sum()).tolist()
        self.cache: dict = {}
        self.paths: dict = {}

    def _scores(self, o) -> list[float]:
        got = self.cache.get(o)
        if got is None:
            got = self.cache[o] = sum(self.le[f][:, v] for f, v in enumerate(o)).tolist()
        return got

    def decode(self, obs, allowed=frozenset(range(4))) -> list[int]:
        """Best state path (Viterbi) among the allowed states."""
        if not obs:
            return []
        key = (tuple(obs), len(allowed) == 4)
        if key[1] and key in self.paths:
            return self.paths[key]
        st, lt = sorted(allowed), self.lt
        v = {s: self.ls[s] + self._scores(obs[0])[s] for s in st}
        back = []
        for o in obs[1:]:
            e = self._scores(o)
            nv, bp = {}, {}
            for s in st:
                b = max(st, key=lambda r: v[r] + lt[r][s])
                nv[s], bp[s] = v[b] + lt[b][s] + e[s], b
            back.append(bp)
            v = nv
        s = max(st, key=lambda r: v[r])
        path = [s]
        for bp in reversed(back):
            s = bp[s]
            path.append(s)
        path.reverse()
        if key[1] and len(obs) <= 12:
            if len(self.paths) > 200_000:
                self.paths.clear()
            self.paths[key] = path
        return path


def fit_lines(df: DataFrame, key: str, text: str, labels: DataFrame, kind: str = "kind", max_labels: int = MAX_LABELS) -> LineModel:
    """Fit on at most ``max_labels`` labelled documents (by hash of the key) of
    at most MAX_LABELLED_LINES lines; only their feature codes reach the driver."""
    some = labels.where(F.col(kind).isin(*KINDS)).orderBy(F.xxhash64(key), key).limit(max_labels).select(F.col(key).alias("_k"), F.col(kind).alias("_kind"))
    j = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(some, "_k").select("_kind", "_t", "_k")

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["_k"], "kind": b["_kind"], "obs": [[int("".join(map(str, observe(x)))) for x in units(t)[:MAX_LABELLED_LINES]] for t in b["_t"]]})

    kt = dict(j.dtypes)["_k"]
    rows = sorted(j.mapInPandas(codes, f"k {kt}, kind string, obs array<long>").collect(), key=lambda r: (str(r.k), r.kind, list(r.obs)))
    return LineModel([(r.kind, [tuple(map(int, str(o).zfill(len(SIZES)))) for o in r.obs]) for r in rows])


def label_documents(df: DataFrame, key: str, text: str, model: LineModel) -> DataFrame:
    """(key, n_lines, prose_share, list_share, table_share, junk_share, kind).

    Every line is labelled by the model; the kind is list or table where more
    than half of the lines (a heading aside) are, junk where more than half of
    their characters are, else prose.  A document
    without lines, null or empty, is prose with shares of 0.  Row-local.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_k"].to_numpy(), b["_t"].to_numpy()):
                lines = units(t) if t else []
                path = model.decode([observe(x) for x in lines])
                n = len(path)
                share = [path.count(s) / n if n else 0.0 for s in range(4)]
                best = 1 if share[1] >= share[2] else 2
                junk = sum(len(x) for x, s in zip(lines, path) if s == 3) > 0.5 * sum(map(len, lines))
                rows.append((k, n, *share, "junk" if junk else KINDS[best] if share[best] > 0.5 else "prose"))
            if len(model.cache) > 100_000:
                model.cache.clear()
            yield pd.DataFrame(rows, columns=[key, "n_lines", *(f"{x}_share" for x in KINDS), "kind"])

    kt = dict(src.dtypes)["_k"]
    return src.mapInPandas(run, f"`{key}` {kt}, n_lines int, prose_share double, list_share double, table_share double, junk_share double, kind string")
