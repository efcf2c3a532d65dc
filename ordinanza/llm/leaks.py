"""Evaluation passages inside a corpus: latent semantic retrieval, then exact run checks.

Texts are tokenised once, into codes of the item vocabulary; the passes over
the corpus read the codes.  Products with the TF-IDF matrix stay sparse: a
batch of passages is a list of (passage, term, weight) triples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

RUN, STRIDE, MARGIN = 12, 12, 12
#: Items are held in blocks of at most this many characters: their latent vectors, runs and codes, sent to every task, take at most about 60 MB.
MAX_ITEM_CHARS = 4_000_000
#: Share of the rarest third of a passage's words, the ones that answer it, that a paraphrase must hold.
ANSWER_SHARE = 0.6
_WORD = re.compile(r"[^\W_]+")
_MIX = np.random.default_rng(12).integers(1, 2**63, RUN, dtype=np.uint64) | np.uint64(1)


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the RUN codes from every place on; 0 where one of them is no word of the items."""
    if len(codes) < RUN:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - RUN + 1, np.uint64)
    for i in range(RUN):
        h += (codes[i : len(codes) - RUN + 1 + i] + 2).astype(np.uint64) * _MIX[i]
    known = np.concatenate([[0], np.cumsum(codes >= 0)])
    h[known[RUN:] - known[:-RUN] < RUN] = 0
    return h


@dataclass
class Items:
    """A block of evaluation items: codes, passages of 24 words at stride 12, sorted run hashes with their places."""

    ids: list
    texts: list[str]
    vocab: dict[str, int] = field(default_factory=dict)
    codes: list[np.ndarray] = field(default_factory=list)
    passages: list[np.ndarray] = field(default_factory=list)
    owner: np.ndarray | None = None
    place: np.ndarray | None = None
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None

    def __post_init__(self):
        owner, place = [], []
        for n, t in enumerate(self.texts):
            c = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(t)], np.int64)
            self.codes.append(c)
            for at in range(0, max(1, len(c) - STRIDE), STRIDE):
                self.passages.append(c[at : at + 2 * STRIDE])
                owner.append(n)
                place.append(at)
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        hs = [run_hashes(c) for c in self.codes]
        flat = np.concatenate([*hs, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.run_hash = flat[order]
        self.run_item = np.repeat(np.arange(len(hs)), [len(h) for h in hs])[order]
        self.run_at = np.concatenate([*[np.arange(len(h)) for h in hs], np.zeros(0, np.int64)])[order]


def read_items(items: DataFrame, item_id: str, text: str) -> Items:
    """The held-out items of one block, whose total size is checked against MAX_ITEM_CHARS first; null texts are left out."""
    x = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = x.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"items of {size} characters; read them by item_blocks")
    rows = sorted(x.collect(), key=lambda r: (r.i is not None, r.i, r.t) if r.i is not None else (False, r.t))
    return Items([r.i for r in rows], [r.t for r in rows])


def item_blocks(items: DataFrame, item_id: str, text: str, max_chars: int = MAX_ITEM_CHARS) -> Iterator[Items]:
    """All items, block by block; one block is on the driver at a time."""
    x = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = x.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-2 * size // max_chars)) if size > max_chars else 1
    for b in range(n):
        yield read_items(x.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else x, "i", "t")


def encode(docs: DataFrame, doc_id: str, text: str, items: Items) -> DataFrame:
    """(_d, codes): the texts as codes of the item vocabulary, -1 for any other word; materialised once."""
    held = docs.sparkSession.sparkContext.broadcast(items.vocab)
    src = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_d"), F.col(text).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                yield pd.DataFrame({"_d": part["_d"], "codes": [np.array([get(w, -1) for w in words(t)], np.int32) for t in part["_t"]]})

    return cut(src.mapInPandas(run, f"_d {dict(src.dtypes)['_d']}, codes array<int>"))


def _sparse(table: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of unit TF-IDF rows, sorted by row, of a table of codes; those below 0 are no terms."""
    t = np.sort(table, 1)
    new = np.ones(t.shape, bool)
    new[:, 1:] = t[:, 1:] != t[:, :-1]
    start = np.flatnonzero(new)
    c, tf = t.ravel()[start], np.diff(np.append(start, t.size))
    ok = c >= 0
    r, c, tf = start[ok] // max(1, t.shape[1]), c[ok], tf[ok]
    w = tf * idf[c]
    norm = np.sqrt(np.bincount(r, w * w, minlength=len(table)))
    return r, c, (w / np.maximum(norm[r], 1e-9)).astype(np.float32)


def _times(a, n: int, x: np.ndarray) -> np.ndarray:
    """A X for A as triples sorted by row."""
    r, c, w = a
    out = np.zeros((n, x.shape[1]), np.float32)
    if len(r):
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[start]] = np.add.reduceat(x[c] * w[:, None], start, axis=0)
    return out


def _times_t(a, y: np.ndarray, into: np.ndarray) -> None:
    """Adds A' Y to ``into``."""
    r, c, w = a
    if len(r):
        order = np.argsort(c, kind="stable")
        r, c, w = r[order], c[order], w[order]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        into[c[start]] += np.add.reduceat(y[r] * w[:, None], start, axis=0)


def _windows(codes: list[np.ndarray]):
    """(document, first word, table of codes) of the 24-word windows at stride 12 with two words of the vocabulary or more; -1 fills."""
    size = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([*codes, np.full(2 * STRIDE, -1)]).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    count = np.maximum(1, -(-np.maximum(size - STRIDE, 1) // STRIDE))
    doc = np.repeat(np.arange(len(size)), count)
    first = STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    known = np.concatenate([[0], np.cumsum(flat >= 0)])
    a = begin[doc] + first
    z = np.minimum(a + 2 * STRIDE, begin[doc] + size[doc])
    keep = known[z] - known[a] >= 2
    doc, first, a, z = doc[keep], first[keep], a[keep], z[keep]
    at = a[:, None] + np.arange(2 * STRIDE)
    return doc, first, np.where(at < z[:, None], flat[at], -1)


def _item_triples(items: Items):
    table = np.full((len(items.passages), 2 * STRIDE), -1, np.int64)
    for n, p in enumerate(items.passages):
        table[n, : len(p)] = p
    return _sparse(table, items.idf)


def fit_space(coded: DataFrame, items: Items, rank: int = 64, extra: int = 16, seed: int = 11) -> Items:
    """Document frequencies and a randomised SVD of the TF-IDF passages of the whole corpus (``encode``).

    Terms are those of the items; others cannot contribute to a product with an
    item.  Each pass multiplies its passages A with a thin matrix and adds up
    A'(A X) by term, partially per task, so that the driver sees one row per
    term: pass 1 with a random X finds the range, pass 2 the small Gram matrix.
    """
    v = len(items.vocab)
    sc = coded.sparkSession.sparkContext

    def df_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(v + 1, np.int64)
        for b in batches:
            for x in b["codes"]:
                u = np.unique(x)
                c[u[u >= 0]] += 1
            c[v] += len(b)
        yield pd.DataFrame({"i": np.arange(v + 1), "n": c})

    df = np.zeros(v + 1)
    for r in coded.select("codes").mapInPandas(df_counts, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r.i] = r.n
    items.idf = (np.log((1 + df[v]) / (1 + df[:v])) + 0.5).astype(np.float32)
    width = min(rank + extra, max(1, v))
    if v <= width:
        items.basis = np.eye(v, dtype=np.float32)
        return items

    def product(x: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over all passages of A'(A X), or of (A X)'(A X)."""
        held = sc.broadcast((x.astype(np.float32), items.idf))
        rows, k = x.shape[1] if gram else v, x.shape[1]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, idf = held.value
            out = np.zeros((rows, k))
            for b in batches:
                codes = list(b["codes"])
                for lo in range(0, len(codes), 500):
                    doc, _, table = _windows(codes[lo : lo + 500])
                    a = _sparse(table, idf)
                    y = _times(a, len(doc), x)
                    if gram:
                        out += y.T @ y
                    else:
                        _times_t(a, y, out)
            yield pd.DataFrame({"i": np.arange(rows, dtype=np.int32)} | {f"c{j}": out[:, j] for j in range(k)})

        cols = [f"c{j}" for j in range(k)]
        sums = coded.select("codes").mapInPandas(part, "i int, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols])
        m = np.zeros((rows, k))
        for r in sums.collect():
            m[r.i] = r[1:]
        held.unpersist()
        return m

    own, n = _item_triples(items), len(items.passages)
    omega = np.random.default_rng(seed).normal(size=(v, width)).astype(np.float32)
    y = product(omega, False)
    _times_t(own, _times(own, n, omega), y)
    q, _ = np.linalg.qr(y)
    z = _times(own, n, q.astype(np.float32))
    val, vec = np.linalg.eigh(product(q, True) + z.T @ z)
    items.basis = (q @ vec[:, ::-1][:, :rank]).astype(np.float32)
    return items


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words."""
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


class Stretches:
    """For every item passage: the words around it, and count and weight of every stretch of 24 consecutive ones (of all, if there are fewer)."""

    def __init__(self, items: Items, weight: np.ndarray):
        wide = 2 * STRIDE + 2 * MARGIN
        n, pad = len(items.passages), len(weight)
        self.weight = np.append(weight, 0.0)
        self.words = np.full((n, wide), pad, np.int64)
        self.size = np.zeros(n, np.int64)
        for c, (o, at) in enumerate(zip(items.owner, items.place)):
            t = items.codes[o][max(0, at - MARGIN) : at + 2 * STRIDE + MARGIN]
            self.words[c, : len(t)] = t
            self.size[c] = len(t) if len(items.codes[o]) >= RUN else 0
        self.long = np.minimum(2 * STRIDE, self.size)
        self.total = self._sums(self.weight[self.words], np.arange(n))

    def _sums(self, x: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """Sums of every stretch of the passages ``cs``; those past the end are -1."""
        s = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
        at = np.arange(2 * MARGIN + 1)[None]
        end = at + self.long[cs][:, None]
        out = np.take_along_axis(s, np.minimum(end, s.shape[1] - 1), 1) - np.take_along_axis(s, np.broadcast_to(at, end.shape), 1)
        return np.where(end <= self.size[cs][:, None], out, -1.0)

    def cover(self, doc: np.ndarray, cs: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(passage, largest share) of the passages that have a stretch of which a common subsequence with ``doc``
        covers ``least`` of the words and of their weight, and which pass the answer check.

        A stretch whose words in ``doc`` do not reach a bound without regard to
        order cannot reach it, so only the others are compared.
        """
        doc = doc[doc >= 0]
        held = np.zeros(len(self.weight), bool)
        held[doc] = True
        x = held[self.words[cs]]
        n, w = self._sums(x, cs), self._sums(self.weight[self.words[cs]] * x, cs)
        ok = (n >= least * self.long[cs][:, None]) & (w >= least * self.total[cs] - 1e-9) & (self.size[cs] > 0)[:, None] & (n >= 0)
        out, there = [], doc.tolist()
        for k in np.flatnonzero(ok.any(1)):
            size, best = int(self.long[cs[k]]), 0.0
            for at in np.flatnonzero(ok[k]):
                stretch = self.words[cs[k], at : at + size]
                if n[k, at] <= best * size:
                    continue
                u = np.unique(stretch)
                key = u[np.argsort(-self.weight[u], kind="stable")][: -(-len(u) // 3)]
                if held[key].sum() < ANSWER_SHARE * len(key):
                    continue
                share = common_share(there, stretch.tolist())
                if share > best and share >= least and weighted_cover(there, stretch.tolist(), self.weight) >= least:
                    best = share
            if best:
                out.append((int(cs[k]), best))
        return out


def common_share(doc, item) -> float:
    """Length of the longest common subsequence as a share of ``item``, bit-parallel."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = v = (1 << len(item)) - 1
    for w in doc:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (len(item) - v.bit_count()) / max(1, len(item))


def weighted_cover(doc, item, weight) -> float:
    """Share of the item's weight in its heaviest common subsequence with ``doc``."""
    prev = [0.0] * (len(item) + 1)
    for x in doc:
        cur = [0.0]
        for j, y in enumerate(item, 1):
            cur.append(max(prev[j], cur[-1], prev[j - 1] + weight[y] if x == y else 0.0))
        prev = cur
    return prev[-1] / max(1e-9, sum(weight[y] for y in item))


def longest_runs(doc: np.ndarray, hits, items: Items) -> dict[int, int]:
    """item -> length of its longest run of words that ``doc`` has too; ``hits`` are (place in doc, index of a run)."""
    lines: dict[tuple[int, int], list[int]] = {}
    for i, r in hits:
        n, j = int(items.run_item[r]), int(items.run_at[r])
        if np.array_equal(doc[i : i + RUN], items.codes[n][j : j + RUN]):
            lines.setdefault((n, i - j), []).append(i)
    best: dict[int, int] = {}
    for (n, _), at in lines.items():
        at.sort()
        run = 1
        best[n] = max(best.get(n, 0), RUN)
        for x, y in zip(at, at[1:]):
            run = run + 1 if y == x + 1 else run if y == x else 1
            best[n] = max(best[n], RUN + run - 1)
    return best


def find_leaks(coded: DataFrame, doc_id: str, items: Items, *, min_cosine: float = 0.4, item_type: str = "long", paraphrase: float | None = None) -> DataFrame:
    """(doc_id, item_id, run_words, lcs_share) of encoded documents: items of which a document holds a passage.

    Every document is cut into 24-word passages at stride 12, so any run of 12
    words lies whole in one.  Passages are projected into the latent space;
    those with a cosine of at least ``min_cosine`` to an item passage are
    candidates.  A candidate leaks if document and item share 12 consecutive
    words; run_words is the length of the longest shared run in the whole document.

    With ``paraphrase``, a candidate also leaks if (1) the longest common
    subsequence covers that share of 24 consecutive words of the item (of all,
    if it has fewer) and that share of the weight of its passage, a word weighing
    log(1 / share of the item passages that have it), so that the words of a
    common phrasing count little, and (2) the answer check holds: of the heaviest
    third of the passage's words, ANSWER_SHARE stand in the document's passage.
    Both passages are compared with MARGIN words more on either side, so that
    their places do not matter.  lcs_share is that cover; null without
    ``paraphrase`` and where a shared run is no such stretch.

    Row-local after the fit: no shuffle.  Null and empty texts and items of
    fewer than 12 words give no rows.
    """
    spark = coded.sparkSession
    n_items = len(items.passages)
    latent = _times(_item_triples(items), n_items, items.basis) if n_items else np.zeros((0, 1), np.float32)
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    have = np.zeros(max(1, len(items.vocab)))
    for p in items.passages:
        have[np.unique(p)] += 1
    weight = np.log(max(2, n_items) / np.maximum(have, 1)) + 0.05
    slim = Items([], [])
    for k in ("ids", "codes", "passages", "owner", "place", "run_hash", "run_item", "run_at", "idf", "basis"):
        setattr(slim, k, getattr(items, k))
    held = spark.sparkContext.broadcast((slim, latent, weight if paraphrase else None))

    def search(codes: list[np.ndarray], items: Items, latent: np.ndarray, stretches: Stretches | None) -> list[tuple]:
        doc, first, table = _windows(codes)
        p = _times(_sparse(table, items.idf), len(doc), items.basis)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        runs: dict[int, list[tuple[int, int]]] = {}
        for n, c in enumerate(codes):
            h = run_hashes(np.asarray(c, np.int64))
            lo, hi = np.searchsorted(items.run_hash, h, "left"), np.searchsorted(items.run_hash, h, "right")
            for i in np.flatnonzero((hi > lo) & (h > 0)):
                runs.setdefault(n, []).extend((int(i), r) for r in range(lo[i], hi[i]))
        wanted = {(n, i // STRIDE) for n, hs in runs.items() for i, _ in hs}
        gate, alike = set(), []
        step = max(1, 4_000_000 // max(1, n_items))
        for at in range(0, len(doc), step):
            close = p[at : at + step] @ latent.T >= min_cosine
            for k in np.flatnonzero(close.any(1)):
                n, place = int(doc[at + k]), int(first[at + k])
                if (n, place // STRIDE) in wanted:
                    gate.update((n, place // STRIDE, int(i)) for i in np.unique(items.owner[close[k]]))
                if stretches is not None:
                    around = codes[n][max(0, place - MARGIN) : place + 2 * STRIDE + MARGIN]
                    alike += [(n, int(items.owner[c]), share) for c, share in stretches.cover(np.asarray(around), np.flatnonzero(close[k]), paraphrase)]
        found: dict[tuple[int, int], list] = {}
        for n, hs in runs.items():
            longest = longest_runs(codes[n], hs, items)
            passed = {int(items.run_item[r]) for i, r in hs if (n, i // STRIDE, int(items.run_item[r])) in gate}
            for item in passed & longest.keys():
                found[n, item] = [longest[item], None]
        for n, item, share in alike:
            got = found.setdefault((n, item), [0, None])
            got[1] = max(got[1] or 0.0, share)
        return [(n, item, run, share) for (n, item), (run, share) in found.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, latent, weight = held.value
        stretches = None if weight is None else Stretches(items, weight)
        for b in batches:
            keys, codes, rows = b["_d"].to_numpy(), list(b["codes"]), []
            for lo in range(0, len(codes), 500):
                rows += [(keys[lo + n], items.ids[i], r, s) for n, i, r, s in search(codes[lo : lo + 500], items, latent, stretches)] if n_items else []
            yield pd.DataFrame(rows, columns=[doc_id, "item_id", "run_words", "lcs_share"])

    dt = dict(coded.dtypes)["_d"]
    return coded.mapInPandas(run, f"`{doc_id}` {dt}, item_id {item_type}, run_words int, lcs_share double")


def leaks(docs: DataFrame, doc_id: str, text: str, eval_items: DataFrame, item_id: str, item_text: str, *, rank: int = 64, paraphrase: float | None = None) -> DataFrame:
    """``find_leaks`` of all documents against all items, in blocks of items of bounded size."""
    out = None
    for items in item_blocks(eval_items, item_id, item_text):
        coded = encode(docs, doc_id, text, items)
        got = find_leaks(coded, doc_id, fit_space(coded, items, rank), item_type=dict(eval_items.dtypes)[item_id], paraphrase=paraphrase)
        out = got if out is None else out.unionByName(got)
    return out
