"""Noise of scanned pages: broken words, misread characters, page furniture.

Words of the whole corpus are counted once.  Frequent words form the lexicon,
whose size is bounded by the share a word needs.  For every other word,
correction candidates come from an inverted join on character bigrams, and
boosted trees trained on words corrupted by known shape confusions choose the
replacement, if any.  Boosted classifiers over a line and the next line of text
decide joins, and over a line decide furniture.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boosting import Boosted

MIN_COUNT, MIN_SHARE = 8, 2e-6  # at most 1 / MIN_SHARE words are in the lexicon
TRAIN_WORDS = 2_000

# Shapes that scanning confuses, the true letters first.
SHAPES = (
    ("e", "c"), ("a", "@"), ("i", "|"), ("i", "!"), ("t", "+"), ("o", "0"), ("s", "5"), ("s", "$"), ("l", "1"), ("l", "i"), ("i", "l"), ("i", "1"), ("l", "|"),
    ("h", "b"), ("g", "9"), ("c", "("), ("b", "6"), ("b", "8"), ("z", "2"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("w", "vv"), ("h", "li"), ("li", "h"), ("k", "lc"),
    ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("o", "c"), ("q", "9"), ("y", "v"), ("ri", "n"), ("rn", "m"), ("cl", "d"),
)
_SHAPE = {(b, a): 0.25 for a, b in SHAPES}
_MARKS = "-‐¬­"
_OUT = ".,;:!?()[]\"'“”’‘<>*•~-–—|/\\…§"
_DROP = dict.fromkeys(map(ord, "​‌‍﻿⁠­"))
_TOKEN = re.compile(r"\S+")
_END_MARK = re.compile(rf"[{_MARKS}][^\S\n]*\n")


def split_end(line: str) -> tuple[str, str, str] | None:
    """(text before the last token, that token without its mark, the mark) of a line that ends in a mark behind a letter."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in _MARKS or not s[-2].isalpha():
        return None
    at = len(s) - 1
    while at and not s[at - 1].isspace():
        at -= 1
    return s[:at], s[at:-1], s[-1]


def broken_pairs(text: str) -> Iterator[tuple[str, str]]:
    """The tokens on both sides of every line end behind a mark."""
    for m in _END_MARK.finditer(text):
        right = _TOKEN.search(text, m.end())
        at = m.start()
        if right and at and text[at - 1].isalpha():
            while at and not text[at - 1].isspace():
                at -= 1
            yield text[at : m.start()], right.group()


def plain(raw: str) -> str:
    """A token without the signs around it, in lower case."""
    return raw.translate(_DROP).lower().replace("‐", "-").replace("’", "'").strip(_OUT)


def inner(raw: str) -> str:
    """A token without closing marks only, so that signs read for letters stay."""
    return raw.translate(_DROP).lower().replace("‐", "-").replace("’", "'").rstrip(".,;:?\"”’)]").lstrip("\"“‘[")


def _wordlike(u: str) -> bool:
    letters = sum(c.isalpha() for c in u)
    return (2 <= letters and 3 <= len(u) or letters == 1 and len(u) == 2) and letters * 2 >= len(u) and ":" not in u and "/" not in u and "_" not in u


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over whole texts: tokens in plain and inner form, and words put together again over line ends."""
    src = texts.select(F.col(text).alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Counter()

        def flush() -> pd.DataFrame:
            words: Counter = Counter()
            for raw, n in total.items():
                forms = {plain(raw), inner(raw)}
                for u in forms:
                    if _wordlike(u) or u.isalpha():
                        words[u] += n
            total.clear()
            return pd.DataFrame({"word": np.array(list(words), object), "n": np.array(list(words.values()), np.int64)})

        for b in batches:
            for t in b["t"]:
                total.update(t.split())
                if "\n" in t:
                    total.update(plain(a) + plain(c) for a, c in broken_pairs(t))
            if len(total) > 500_000:
                yield flush()
        yield flush()

    return src.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _distance(s: str, v: str) -> tuple[float, int]:
    """Weighted edit distance (shape confusions cost 0.25) and the length of the differing middle."""
    i = 0
    while i < len(s) and i < len(v) and s[i] == v[i]:
        i += 1
    j = 0
    while j < len(s) - i and j < len(v) - i and s[-1 - j] == v[-1 - j]:
        j += 1
    a, b = s[i : len(s) - j], v[i : len(v) - j]
    if (a, b) in _SHAPE:
        return 0.25, max(len(a), len(b))
    # shapes that take in a neighbour of the middle (rn for m next to an n)
    d = [[9.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0.0
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            c = d[x][y]
            if x < len(a) and c + 1 < d[x + 1][y]:
                d[x + 1][y] = c + 1
            if y < len(b) and c + 1 < d[x][y + 1]:
                d[x][y + 1] = c + 1
            if x < len(a) and y < len(b):
                k = c + (0 if a[x] == b[y] else 1)
                if k < d[x + 1][y + 1]:
                    d[x + 1][y + 1] = k
            for la in (1, 2):
                for lb in (1, 2):
                    if x + la <= len(a) and y + lb <= len(b):
                        k = _SHAPE.get((a[x : x + la], b[y : y + lb]))
                        if k is not None and c + k < d[x + la][y + lb]:
                            d[x + la][y + lb] = c + k
    w = d[len(a)][len(b)]
    if w >= 1:
        # the middle was cut too close: compare with one more letter on both sides
        for lo, hi in ((1, 0), (0, 1), (1, 1)):
            if i >= lo and j >= hi:
                a2, b2 = s[i - lo : len(s) - j + hi], v[i - lo : len(v) - j + hi]
                if (a2, b2) in _SHAPE:
                    return 0.25, max(len(a2), len(b2))
    return w, max(len(a), len(b))


def pair_features(s: str, ns: int, v: str, nv: int, shared: int) -> list[float]:
    w, mid = _distance(s, v)
    signs = sum(not c.isalpha() and c not in "-'" for c in s)
    return [w, mid, np.log(nv / max(ns, 1)), np.log(nv), len(v), shared / (len(v) + 1), signs, float(s[0] == v[0]), float(s[-1] == v[-1]), abs(len(s) - len(v))]


def _bigrams(u: str) -> set[str]:
    p = f"^{u}$"
    return {p[i : i + 2] for i in range(len(p) - 1)}


def fit_ranker(lexicon: dict[str, int], seed: int = 5) -> Boosted:
    """Trees that tell a misread form of a word from other words.

    Positives: words corrupted by one or two shape confusions, as rare against
    their original as misreadings are.  Negatives: the same forms with other
    words, words with their neighbours in the lexicon, and fragments.
    """
    rng = random.Random(seed)
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0])) if w.replace("-", "").replace("'", "").isalpha() and len(w) > 1][:TRAIN_WORDS]
    by: dict[str, list[str]] = {}
    for w in words:
        for g in _bigrams(w):
            by.setdefault(g, []).append(w)
    xs, ys = [], []

    def add(s, ns, v, y):
        xs.append(pair_features(s, ns, v, lexicon[v], len(_bigrams(s) & _bigrams(v))))
        ys.append(y)

    def near(s):
        c: Counter = Counter()
        for g in _bigrams(s):
            c.update(by.get(g, ()))
        return [v for v, _ in c.most_common(6) if v != s and abs(len(v) - len(s)) <= 2]

    for w in words:
        # frequent misreadings are in the lexicon too: they are neither source nor counterexample
        if any(lexicon[v] >= 100 * lexicon[w] and _distance(w, v)[0] <= 0.5 for v in near(w)):
            continue
        for _ in range(4):
            s = w
            for _ in range(1 if rng.random() < 0.85 else 2):
                a, b = rng.choice(SHAPES)
                at = [m.start() for m in re.finditer(re.escape(a), s)]
                if at:
                    k = rng.choice(at)
                    s = s[:k] + b + s[k + len(a) :]
            if s != w and s not in lexicon:
                ns = max(1, int(lexicon[w] * 10 ** rng.uniform(-5, -1.3)))
                add(s, ns, w, 1)
                for v in near(s)[:3]:
                    if v != w:
                        add(s, ns, v, 0)
        for v in near(w)[:4]:
            add(w, lexicon[w], v, 0)
            if _distance(w, v)[0] > 0.5:
                add(w, max(1, int(lexicon[v] * 10 ** rng.uniform(-5, -1))), v, 0)
        if len(w) > 5:
            k = rng.randint(2, len(w) - 2)
            for s in (w[:k], w[k:]):
                for v in near(s)[:2]:
                    add(s, max(1, lexicon[w] // 100), v, 0)
    return Boosted().fit(np.array(xs), np.array(ys)) if sum(ys) > 20 else Boosted().fit(np.zeros((1, 10)), np.zeros(1))


def _lost(n: int) -> int:
    """Bigrams of a word of n letters that a misreading may change."""
    return 3 if n <= 5 else 4 if n <= 8 else 5


def corrections(counts: DataFrame, lexicon: dict[str, int], ranker: Boosted, min_p: float = 0.5) -> DataFrame:
    """(word, fix, p): misread words and their replacements.

    A candidate, a word of the lexicon, has all bigrams of a word but a few
    (``_lost``) and nearly its length.  Two sets that share that many have one in
    common among the rarest few of either, so only those are joined, with the
    length; the grams that most words have join nothing.  Pairs within a few
    edits are ranked by the trees.
    """
    sc = counts.sparkSession.sparkContext
    have: Counter = Counter()
    for w in lexicon:
        have.update(_bigrams(w))
    rarity = sc.broadcast({g: n for n, (g, _) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0])), 1)})
    words = sc.broadcast(frozenset(lexicon))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, known = rarity.value.get, words.value
        for b in batches:
            for lo in range(0, len(b), 2000):
                rows = []
                for w, n in zip(b["word"].iloc[lo : lo + 2000], b["n"].iloc[lo : lo + 2000]):
                    size = len(w)
                    if size < 2 or size == 2 and w.isalpha() or not any(map(str.isalpha, w)):
                        if w not in known:
                            continue
                    order = sorted(_bigrams(w), key=lambda g: (rank(g, 0), g))
                    if not (size == 2 and w.isalpha()):
                        rows += [(w, n, size, g, False) for g in order[: _lost(size + 1) + 3]]
                    if w in known:
                        rows += [(w, n, k, g, True) for g in order[: _lost(size) + 1] for k in range(size - 1, size + 3)]
                yield pd.DataFrame(rows, columns=["w", "n", "len", "g", "known"])

    every = cut(counts.select("word", "n").mapInPandas(grams, "w string, n long, len int, g string, known boolean"))
    s = every.where("not known").select(F.col("w").alias("s"), F.col("n").alias("ns"), "len", "g")
    v = every.where("known").select(F.col("w").alias("v"), F.col("n").alias("nv"), "len", "g")
    pairs = s.join(v, ["g", "len"]).where("s <> v and nv >= 8 * ns").select("s", "ns", "v", "nv").distinct()
    pairs = pairs.where("levenshtein(s, v, 4) between 1 and case when length(v) <= 5 then 2 when length(v) <= 8 then 3 else 4 end")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, v, nv, pair_features(s, ns, v, nv, shared)) for s, ns, v, nv in zip(b["s"], b["ns"], b["v"], b["nv"]) if (shared := len(_bigrams(s) & _bigrams(v))) >= len(v) + 1 - _lost(len(v))]
            if rows:
                p = ranker.probability(np.array([r[3] for r in rows]))
                rows = [(s, v, nv, x) for (s, v, nv, _), x in zip(rows, p.tolist()) if x >= min_p]
            yield pd.DataFrame(rows, columns=["s", "v", "nv", "p"])

    ranked = pairs.mapInPandas(rank, "s string, v string, nv long, p double")
    best = ranked.groupBy("s").agg(F.max(F.struct(F.round("p", 3).alias("p"), "nv", "v")).alias("b"))
    return best.select(F.col("s").alias("word"), F.col("b.v").alias("fix"), F.col("b.p").alias("p"))


# -- joins and furniture -------------------------------------------------------

def join_features(n_joined: int, n_hyphen: int, n_left: int, n_right: int, mark: str) -> list[float]:
    return [np.log1p(n_joined), np.log1p(n_hyphen), np.log1p(n_left), np.log1p(n_right), np.log1p(n_joined) - np.log1p(n_hyphen), float(mark in "-‐")]


def fit_joiner(lexicon: dict[str, int], seed: int = 6) -> Boosted:
    """Trees over a line end and the next line: a broken word, or a compound at its own hyphen."""
    rng = random.Random(seed)
    get = lambda w: lexicon.get(w, 0)
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))][:TRAIN_WORDS]
    xs, ys = [], []
    for w in words:
        parts = w.split("-")
        if len(parts) == 2 and all(p.isalpha() for p in parts):
            for _ in range(30):
                xs.append(join_features(get("".join(parts)), get(w), get(parts[0]), get(parts[1]), rng.choice("-‐¬­")))
                ys.append(0)
        elif w.isalpha() and len(w) >= 4:
            for _ in range(4):
                k = rng.randint(2, len(w) - 2)
                known = rng.random() < 0.9
                xs.append(join_features(get(w) if known else 0, 0, get(w[:k]), get(w[k:]), rng.choice("--‐¬­")))
                ys.append(1)
    return Boosted(trees=40).fit(np.array(xs or [[0] * 6]), np.array(ys or [1]))


_PAGE_NO = re.compile(r"^\W*(?:p(?:age|g)?\.?\s*)?(?:\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,2}-\d{1,3})[^\w.,;:%)]*$", re.I)
_DIGIT = re.compile(r"\d")
_LONE = re.compile(r" \S \S ")
_BRACKETED = re.compile(r"\[\s*\d{1,4}\s*\]")
_SPACED = re.compile(r"(?:\b[^\W\d_] ){3,}[^\W\d_]\b")
_LEAD_NO = re.compile(r"^\s*\d{1,4}\s{2,}[^\W\d_]")
_TAIL_NO = re.compile(r"\s{2,}(?:\d{1,4}|\[\d{1,3}[-.]\d{1,4}\])\s*$")
_DIVISION = re.compile(r"^\s*(?:chapter|title|part|article|division)\s+\d{1,3}(?:\.\d{1,3})?\b", re.I)
_CODE_TITLE = re.compile(r"^\s*\d{1,3}\.\d{1,3}(?!\.?\d)\s")
_ENTRY = re.compile(r"\s*(?:[-*•]|\(?\w{1,4}[.)])\s")
_COLUMNS = re.compile(r"\S\s*(?:\s\|\s|\t|\.{4,}| {3,})\s*\S")
_HEADED = re.compile(r"^[\W_]*(?:section\s+)?\d{1,3}\.\d{1,3}\.\d{1,4}\b", re.I)
_KEYED = re.compile(r"^\s*[^\W\d_]+(?:[ /][^\W\d_]+){0,3}\s*(?::|\s=|\s[–—-])\s*\S")
_OPEN_END = re.compile(r"[.!?;,:]\s*$")


def line_marks(line: str) -> tuple[float, ...]:
    """The six features of a line that text rarely has: page number, spaced letters, leading and trailing number, division, title of a code."""
    s = line.strip()
    digit = _DIGIT.search(s)
    return (
        float(bool(digit) and (bool(_PAGE_NO.match(s)) and not s.endswith((")", "]")) or bool(_BRACKETED.fullmatch(s)))),
        float(bool(_LONE.search(s) or len(s) < 8) and bool(_SPACED.search(s))),
        float(bool(digit) and bool(_LEAD_NO.match(line))),
        float(bool(digit) and "  " in line and bool(_TAIL_NO.search(line))),
        float(bool(digit) and bool(_DIVISION.match(s))),
        float(bool(digit) and bool(_CODE_TITLE.match(s))),
    )


def line_features(line: str, marks: tuple[float, ...] | None = None) -> list[float]:
    s = line.strip()
    words = s.split()
    caps = sum(w[:1].isupper() or w in ("and", "of", "the") for w in words) / max(1, len(words))
    return [*(line_marks(line) if marks is None else marks), caps, float(bool(_OPEN_END.search(s))), min(len(words), 20)]


def text_without_marks(trees: Boosted) -> bool:
    """Whether the trees call no line furniture that has none of the six marks: they are asked about every
    combination of the other features that their splits can tell apart."""
    cuts = sorted({c for t in trees.forest for j, c in _splits(t) if j == 6})
    caps = [0.0, *(x for c in cuts for x in (c, c + 1e-9)), 1.0]
    grid = np.array([[0, 0, 0, 0, 0, 0, x, o, n] for x in caps for o in (0, 1) for n in range(21)], float)
    return bool((trees.probability(grid) < 0.5).all())


def _splits(tree) -> Iterator[tuple[int, float]]:
    if isinstance(tree, tuple):
        yield tree[0], tree[1]
        yield from _splits(tree[2])
        yield from _splits(tree[3])


def fit_furniture(lexicon: dict[str, int], seed: int = 8) -> Boosted:
    """Trees over one line, trained on page numbers and running headers of many
    forms against headings, ends of wrapped headings, list entries, table rows and text.

    Titles and text are made of words of the lexicon.
    """
    rng = random.Random(seed)
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0])) if w.isalpha() and len(w) > 2][:TRAIN_WORDS] or ["word", "line", "text"]
    title = lambda: " ".join(rng.choice(words).capitalize() for _ in range(rng.randint(1, 4)))
    pos, neg = [], []
    for _ in range(1500):
        n, m = rng.randint(1, 999), rng.randint(1, 999)
        t = title()
        form = rng.choice([t, t.upper(), "   ".join(" ".join(w.upper()) for w in t.split())])
        pos.append(rng.choice([f"{n}", f"    {n}", f"- {n} -", f"— {n} —", f"~ {n} ~", f"• {n} •", f"[{n}]", f"p. {n}", f"Pg. {n}", f"Page {n}", f"Page {n} of {m}", f"{n}/{m}", f"{n % 30}-{m}"]))
        pos.append(rng.choice([f"{n}    {form}", f"{form}    {n}", f"{form}   [{n % 30}-{m}]", f"CHAPTER {n % 30}.{m % 50:02d} {form}", f"Title {n % 30} - {form}", f"{n % 30}.{m % 50:02d} {form}    {n}", "   ".join(" ".join(w.upper()) for w in t.split() if len(w) > 4) or f"{n}"]))
        k = rng.randint(1, 12)
        body = " ".join(rng.choice(words) for _ in range(k))
        neg += [
            rng.choice([body, body.capitalize() + ".", body.upper() + ".", body + ",", body.upper(), body.capitalize()]),
            rng.choice([f"{n % 30}.{m % 50:02d}.{n % 999:03d} {t}, {body}", f"11-{n:04d} § 2)", "§ 2)", f"11-{n:04d})", f"11-{n:04d}]", f"Ordinance 11-{n:04d}", f"Ord. 11-{n:04d} § 2)", f"{n % 30}.{m % 50:02d}.{n % 999:03d}"]),
            rng.choice([f"{n % 20}) fee of ${m}", f"({rng.choice('abcdef')}) {body}", f"{n % 20}. {body}", f"{body} | {n}% | no", f"{t}   {n} ft   yes   no", f"{body} ..... {n}  R-{n % 9}", f"{t} {body} {n}", f"{t} {n}", f"{n} {body}", "Submit all of these:", t]),
        ]
    x = np.array([line_features(v) for v in pos + neg])
    return Boosted(trees=40).fit(x, np.array([1] * len(pos) + [0] * len(neg)))


# -- flow of paragraphs -----------------------------------------------------------

def flow_features(line: str, nxt: str, width: int) -> list[float]:
    """A line, the one below it and the width of the text: does the sentence or paragraph go on?"""
    s, t = line.rstrip(), nxt.strip()
    first = t.split(" ", 1)[0]
    return [
        len(s) / max(1, width),
        float(width - len(s) > len(first)),  # the next word would have had room
        float(t[:1].islower()),
        float(t[:1].isdigit()),
        float(bool(_ENTRY.match(nxt))),
        float(bool(_ENTRY.match(line))),
        float(s[-1:] in ".!?"),
        float(s[-1:] == ":"),
        float(s[-1:] in ",;"),
        float(bool(_COLUMNS.search(s)) + bool(_COLUMNS.search(t))),
        float(bool(_HEADED.match(s))),
        float(bool(_HEADED.match(t))),
        float(bool(_KEYED.match(t))),
    ]


def fit_flow(lexicon: dict[str, int], seed: int = 9) -> Boosted:
    """Trees over line pairs, trained on generated pages: wrapped paragraphs, headings, lists, tables and fields of words of the lexicon."""
    rng = random.Random(seed)
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0])) if w.isalpha()][:TRAIN_WORDS] or ["word", "line", "text"]
    phrase = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    number = lambda: f"{rng.randint(1, 20)}.{rng.randint(1, 50):02d}.{rng.randint(1, 999):03d}"

    def sentence() -> str:
        ws = phrase(6, 22).capitalize().split()
        ws = [w.capitalize() if rng.random() < 0.08 else w for w in ws]
        for _ in range(rng.choice([0, 0, 1, 2])):
            ws.insert(rng.randint(1, len(ws)), rng.choice([str(rng.randint(2, 999)), f"Section {number()}"]))
        return " ".join(ws) + rng.choice("....;?")

    def wrapped(text: str, width: int) -> list[str]:
        out, cur = [], ""
        for w in text.split():
            if cur and len(cur) + 1 + len(w) > width:
                out.append(cur)
                cur = w
            else:
                cur = f"{cur} {w}" if cur else w
        return [*out, cur]

    xs, ys = [], []
    for _ in range(900):
        width = rng.randint(40, 100)
        page: list[tuple[str, bool]] = []  # (line, goes on into the next)
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.3:
                head = f"{number()} {phrase(2, 6).title()}" + rng.choice(["", "", f" (Ord. 11-{rng.randint(1, 9999):04d} § 2)", f" — Ordinance 11-{rng.randint(1, 9999):04d}"])
                ls = wrapped(head, width) if rng.random() < 0.5 else [head]
                page += [(x, i < len(ls) - 1) for i, x in enumerate(ls)]
            if kind < 0.65:
                # some paragraphs are not wrapped at all, or at another width
                own = width if rng.random() < 0.6 else rng.choice([30, 50, 70, 5000])
                ls = wrapped(" ".join(sentence() for _ in range(rng.randint(2, 6))), own)
                page += [(x, i < len(ls) - 1) for i, x in enumerate(ls)]
            elif kind < 0.8:
                page.append((phrase(2, 6).capitalize() + ":", False))
                for i in range(rng.randint(2, 5)):
                    ls = wrapped(rng.choice(["- ", f"{i + 1}. ", f"({chr(97 + i)}) "]) + phrase(2, 14) + rng.choice(",;"), width)
                    page += [(x, j < len(ls) - 1) for j, x in enumerate(ls)]
            elif kind < 0.9:
                sep = rng.choice([" | ", "   ", " ..... "])
                page += [(sep.join(rng.choice([phrase(1, 2), f"{rng.randint(1, 99)}%", "no"]) for _ in range(3)), False) for _ in range(4)]
            else:
                page += [(f"{phrase(1, 2).title()}: {phrase(1, 5)}", False) for _ in range(4)]
        w = text_width([x for x, _ in page])
        for (a, on), (b, _) in zip(page, page[1:]):
            xs.append(flow_features(a, b, w))
            ys.append(int(on))
    return Boosted(trees=60, depth=4).fit(np.array(xs), np.array(ys))


def text_width(lines: list[str]) -> int:
    """The length that nine of ten lines do not exceed."""
    sizes = sorted(len(x.rstrip()) for x in lines if x.strip())
    return sizes[min(len(sizes) - 1, len(sizes) * 9 // 10)] if sizes else 0


@dataclass
class NoiseModel:
    """What the row-local pass needs: the bounded lexicon and the two line classifiers."""

    lexicon: dict[str, int]
    joiner: Boosted
    furniture: Boosted
    flow: Boosted | None  # only ``repair`` needs and fits it
    fixes: DataFrame | None
    safe: frozenset


def fit(tables: list[tuple[DataFrame, str]]) -> NoiseModel:
    """Count the words of all texts, fit the classifiers and find the corrections.

    All training lines and words are generated from the TRAIN_WORDS most frequent words of the lexicon.
    """
    counts = None
    for df, text in tables:
        c = count_words(df, text)
        counts = c if counts is None else counts.unionByName(c)
    counts = cut(counts.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    need = max(MIN_COUNT, MIN_SHARE * total)
    lexicon = {r.word: r.n for r in counts.where((F.col("n") >= need) & F.col("word").rlike(r"^\p{L}[\p{L}'.-]*$")).collect()}
    fixes = cut(corrections(counts, lexicon, fit_ranker(lexicon)))
    wrong = {r.word for r in fixes.select("word").join(counts.where(F.col("n") >= need), "word").collect()}
    return NoiseModel(lexicon, fit_joiner(lexicon), fit_furniture(lexicon), None, fixes, frozenset(w for w in lexicon if w not in wrong))


def _held(df: DataFrame, model: NoiseModel):
    """The model without its corrections, sent to every executor once."""
    return df.sparkSession.sparkContext.broadcast(NoiseModel(model.lexicon, model.joiner, model.furniture, model.flow, None, model.safe))


class _Reader:
    """Finds events in one text: furniture lines, breaks, and words outside the lexicon."""

    def __init__(self, m: NoiseModel):
        self.lexicon, self.joiner, self.trees, self.flow, self.safe = m.lexicon, m.joiner, m.furniture, m.flow, m.safe
        self.memo: dict[str, tuple[str, ...]] = {}
        self.lines: dict[tuple, bool] = {}
        self.joins: dict[tuple, bool] = {}
        self.flows: dict[tuple, bool] = {}
        self.plain = text_without_marks(m.furniture)

    def suspects(self, raw: str) -> tuple[str, ...]:
        got = self.memo.get(raw)
        if got is None:
            a, b = plain(raw), inner(raw)
            got = () if a in self.safe or b in self.safe or all(p in self.safe for p in a.split("-")) else tuple(u for u in dict.fromkeys((b, a)) if _wordlike(u))
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[raw] = got
        return got

    def is_furniture(self, line: str) -> bool:
        marks = line_marks(line)
        if self.plain and not any(marks):
            return False
        f = tuple(line_features(line, marks))
        got = self.lines.get(f)
        if got is None:
            got = self.lines[f] = bool(self.trees.probability(np.array([f]))[0] >= 0.5)
            if len(self.lines) > 1_000_000:
                self.lines.clear()
        return got

    def goes_on(self, line: str, nxt: str, width: int) -> bool:
        f = flow_features(line, nxt, width)
        f[0] = round(f[0], 2)
        got = self.flows.get(tuple(f))
        if got is None:
            got = self.flows[tuple(f)] = bool(self.flow.probability(np.array([f]))[0] >= 0.5)
            if len(self.flows) > 1_000_000:
                self.flows.clear()
        return got

    def is_break(self, left: str, right: str, mark: str) -> bool:
        n = self.lexicon.get
        a, b = plain(left), plain(right)
        if not a or not b or not b[0].isalpha() or not a[-1].isalpha():
            return False
        key = (n(a + b, 0), n(f"{a}-{b}", 0), n(a, 0), n(b, 0), mark in "-‐")
        got = self.joins.get(key)
        if got is None:
            got = self.joins[key] = bool(self.joiner.probability(np.array([join_features(*key[:4], mark)]))[0] >= 0.5)
            if len(self.joins) > 1_000_000:
                self.joins.clear()
        return got

    def read(self, text: str) -> list[tuple[int, str, str]]:
        """(line number, event, word): furniture, break, or a suspect with its word."""
        raws = set(text.split())
        odd = {r for r in raws if self.suspects(r)}
        lines = text.split("\n")
        if len(lines) == 1 and not odd:
            return []
        out: list[tuple[int, str, str]] = []
        wall = [len(lines) > 1 and bool(x.strip()) and self.is_furniture(x) for x in lines]
        out += [(i + 1, "furniture", "") for i, w in enumerate(wall) if w]
        used: set[tuple[int, str]] = set()
        for i, x in enumerate(lines):
            if wall[i] or not x or x.rstrip()[-1:] not in _MARKS:
                continue
            end = split_end(x)
            if not end:
                continue
            j = i + 1
            while j < len(lines) and (wall[j] or not lines[j].strip()):
                j += 1
            if j == len(lines):
                continue
            right = lines[j].split()[0]
            if self.is_break(end[1], right, end[2]):
                out.append((i + 1, "break", ""))
                whole = end[1] + right
                used |= {(i, end[1] + end[2]), (j, right)}
                for u in self.suspects(whole):
                    # the misread character stands in the half that is no beginning or end of a word by itself
                    out.append((i + 1, "half", f"{u}\t{len(plain(end[1]))}\t{j + 1}"))
        if odd:
            for i, x in enumerate(lines):
                if wall[i]:
                    continue
                for r in set(x.split()):
                    if r in odd and (i, r) not in used:
                        out += [(i + 1, "word", u) for u in self.suspects(r)]
        return out


def find_noise(df: DataFrame, key: str, text: str, model: NoiseModel) -> DataFrame:
    """(key, line_no, kind): each line with a kind of noise, once per kind.

    ``break``: the line ends in the first half of a word that goes on in the
    next line of text; ``glyph``: a word with a misread character; ``furniture``:
    a running header or page number.  Null and empty texts give no rows.  The
    text pass is row-local; only words outside the lexicon meet the corrections,
    in a join on the word.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())

    held = _held(df, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(held.value)
        for b in batches:
            rows = [(k, *e) for k, t in zip(b["_k"].to_numpy(), b["_t"].to_numpy()) for e in reader.read(t)]
            yield pd.DataFrame(rows, columns=["_k", "line_no", "event", "word"])

    events = src.mapInPandas(run, f"_k {dict(src.dtypes)['_k']}, line_no int, event string, word string")
    events = cut(events)
    sure = events.where("event in ('furniture', 'break')").select("_k", "line_no", F.col("event").alias("kind"))
    parts = F.split("word", "\t")
    words = events.where("event in ('word', 'half')").select(
        "_k", "line_no", parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).cast("int").alias("at"), F.try_element_at(parts, F.lit(3)).cast("int").alias("next_line")
    )
    hit = words.join(model.fixes, "word")
    # of a broken word, the line that holds the first letter that differs
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring("word", i, F.lit(1)) == F.substring("fix", i, F.lit(1))), i).otherwise(acc),
    )
    line = F.when(F.col("at").isNotNull() & (same >= F.col("at")), F.col("next_line")).otherwise(F.col("line_no"))
    glyph = hit.select("_k", line.alias("line_no"), F.lit("glyph").alias("kind"))
    return sure.unionByName(glyph).distinct().withColumnRenamed("_k", key)


def repair(df: DataFrame, key: str, text: str, model: NoiseModel) -> DataFrame:
    """(key, text, n_fixed): texts as continuous paragraphs.

    Furniture lines go, broken words are joined, misread words replaced in the
    case of the original, and lines of a paragraph become one.  A text without
    noise stays as it is; null stays null.  Only (word, replacement) pairs that
    occur in a document meet its text, by its key.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    model.flow = model.flow or fit_flow(model.lexicon)
    held = _held(df, model)
    kt = dict(src.dtypes)["_k"]

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(held.value)
        for b in batches:
            rows = ((k, w.split("\t")[0]) for k, t in zip(b["_k"].to_numpy(), b["_t"].to_numpy()) if t for _, e, w in reader.read(t) if w)
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=["_k", "word"])

    need = src.mapInPandas(odd, f"_k {kt}, word string").join(model.fixes.select("word", "fix"), "word")
    maps = need.groupBy("_k").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("_m"))
    both = src.join(maps, "_k", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(held.value)
        for b in batches:
            rows = []
            for k, t, m in zip(b["_k"].to_numpy(), b["_t"].to_numpy(), b["_m"].to_numpy()):
                rows.append((k, *(_repair_text(t, dict(m) if m is not None else {}, reader) if t else (t, 0))))
            yield pd.DataFrame(rows, columns=[key, text, "n_fixed"])

    return both.mapInPandas(run, f"`{key}` {kt}, `{text}` string, n_fixed int")


def _repair_text(text: str, fixes: dict[str, str], reader: _Reader) -> tuple[str, int]:
    lines = text.split("\n")
    wall = [len(lines) > 1 and bool(x.strip()) and reader.is_furniture(x) for x in lines]
    kept = [x for x, w in zip(lines, wall) if not w]
    marks = [i for i, x in enumerate(kept[:-1]) if split_end(x)]
    n = sum(wall)
    if not n and not marks and not fixes:
        return text, 0
    out: list[str] = []
    width, above = text_width(kept), ""
    for x in kept:
        end = split_end(out[-1]) if out else None
        if end and x.strip():
            first, _, rest = x.lstrip().partition(" ")
            joined = reader.is_break(end[1], first, end[2]) and (first[0].islower() or end[1].isupper())
            n += joined
            out[-1] = end[0] + end[1] + ("" if joined else "-") + first + (" " + rest if rest else "")
        elif above.strip() and x.strip() and reader.goes_on(above, x, width):
            out[-1] = out[-1].rstrip() + " " + x.lstrip()
        elif not (end and not x.strip()):
            out.append(x)
        above = x if x.strip() or not end else above

    def fixed(m: re.Match) -> str:
        nonlocal n
        raw = m.group(0)
        for u in reader.suspects(raw):
            v = fixes.get(u)
            at = raw.lower().replace("‐", "-").replace("’", "'").find(u)
            if v and at >= 0:
                n += 1
                v = v.upper() if raw.isupper() and len(raw) > 2 else v.capitalize() if raw[at : at + 1].isupper() else v
                return raw[:at] + v + raw[at + len(u) :]
        return raw

    joined = "\n".join(out)
    return (re.sub(r"\S+", fixed, joined) if fixes else joined), n
