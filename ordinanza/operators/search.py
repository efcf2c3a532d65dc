"""Nearest neighbours, multi-query search with first-wins removal of repeats, and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..session import cut

MAX_BROADCAST = 64 << 20
#: Above so many wanted neighbours a first pass over one item in _SHARE bounds the distances.
BOUNDED = 1 << 16
_ROWS, _QUERIES, _SHARE, _PENDING = 2048, 256, 4, 1 << 22
#: Up to so many hashes of hits, of 8 bytes each, go to every task to choose the texts that are read.
MAX_KEYS = 2_000_000


def _plain(a: np.ndarray):
    """Ids as a column of plain objects, unless they are numbers."""
    return pd.Series(a, dtype=object) if a.dtype == object else a


def _best(b: pd.DataFrame, ks: np.ndarray) -> pd.DataFrame:
    """The ks[q] first rows of every q by distance, then by x."""
    b = b.sort_values(["q", "dist", "x"], kind="stable", ignore_index=True)
    return b[b.groupby("q").cumcount().to_numpy() < ks[b["q"].to_numpy()]]


def _nearest(v: np.ndarray, ks: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], bound: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of all items of the batches for every row of ``v``: (q, x, dist).

    ``bound`` holds distances above which an item is not wanted, where they are known.

    A single-precision product selects, with a margin above its error; the
    selected pairs are measured again in double precision.  Queries go in blocks
    of 256 and items in blocks of 2,048, so that a product holds 2 MB.  Selected
    pairs are put in order once there are more of them than of the best so far,
    or within a block once they are millions, as with items that are all alike.
    """
    best = pd.DataFrame({"q": np.zeros(0, np.int64), "x": [], "dist": np.zeros(0)})
    v64, vv = v.astype(np.float64), (v.astype(np.float64) ** 2).sum(1).astype(np.float32)
    v32 = np.hstack([v.astype(np.float32), np.ones((len(v), 1), np.float32)])
    bound = np.full(len(v), np.inf) if bound is None else bound.astype(np.float64)
    new, held = [], 0

    def settle() -> None:
        nonlocal best, new, held
        best = _best(pd.concat([best, *new] if len(best) else new, ignore_index=True), ks)
        last = best.groupby("q")["dist"].agg(["max", "size"])
        full = last[last["size"].to_numpy() >= ks[last.index]]
        bound[full.index] = np.minimum(bound[full.index], full["max"])
        new, held = [], 0

    for ids, w in batches:
        for at in range(0, len(ids), _ROWS):
            x, y = ids[at : at + _ROWS], w[at : at + _ROWS].astype(np.float64)
            yy = (y * y).sum(1).astype(np.float32)
            y32 = np.ascontiguousarray(np.hstack([-2 * y.astype(np.float32), yy[:, None]]).T)
            for lo in range(0, len(v), _QUERIES):
                hi = min(len(v), lo + _QUERIES)
                d, limit = v32[lo:hi] @ y32, bound[lo:hi] - vv[lo:hi]
                if np.isinf(limit).any():
                    k = min(int(ks[lo:hi].max()), len(x))
                    limit = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], limit)
                at_most = (limit + 1e-4 * (1 + vv[lo:hi] + yy.max())).astype(np.float32)
                r, c = np.divmod(np.flatnonzero(d <= at_most[:, None]), len(x))
                if len(r):
                    t = v64[lo + r] - y[c]
                    new.append(pd.DataFrame({"q": lo + r, "x": _plain(x[c]), "dist": np.round((t * t).sum(1), 6)}))
                    held += len(r)
                if held > max(2 * len(best), _PENDING):
                    settle()
            if new and held > max(len(best), len(v)):
                settle()
    if new:
        settle()
    return best


def _bounds(x: DataFrame, held, n: int, matrix) -> np.ndarray:
    """For each of n queries a distance within which it has its k items, from one item in _SHARE by a hash of its id; infinite if those are fewer.

    Each task gives the distances of its k best, packed by blocks of queries, and the tasks' blocks are merged.
    """
    some = x.where(F.pmod(F.xxhash64("_x"), F.lit(_SHARE)) == 0).select("_w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, v, ks = held.value
        b = _nearest(v, ks, ((np.zeros(len(b), np.int8), matrix(b["_w"])) for b in batches if len(b)))
        most = int(ks.max())
        d = np.full((len(v), most), np.inf, np.float32)
        q = b["q"].to_numpy()
        d[q, b.groupby("q").cumcount().to_numpy()] = b["dist"].to_numpy()
        if len(b):
            blocks = range(0, len(v), _QUERIES)
            yield pd.DataFrame({"block": list(blocks), "d": [d[lo : lo + _QUERIES].tobytes() for lo in blocks]})

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        ks = held.value[2][b["block"][0] :][:_QUERIES]
        d = np.sort(np.hstack([np.frombuffer(t, np.float32).reshape(len(ks), -1) for t in b["d"]]), axis=1)
        return pd.DataFrame({"block": b["block"][:1], "d": [d[np.arange(len(ks)), ks - 1].tobytes()]})

    out = np.full(n, np.inf)
    for r in some.mapInPandas(run, "block int, d binary").groupBy("block").applyInPandas(merge, "block int, d binary").collect():
        d = np.frombuffer(r.d, np.float32)
        out[r.block : r.block + len(d)] = d
    return out


def knn(queries: DataFrame, index: DataFrame, *, query_id: str, item_id: str, query_vector: str, item_vector: str, k: int | str,
        max_broadcast: int = MAX_BROADCAST, query_block: int = 512, item_block: int = 50_000, bounded: int = BOUNDED) -> DataFrame:
    """Exact k nearest items of every query by squared L2: (query_id, item_id, dist, rank).

    The queries are materialised once, which gives their exact size.  Up to
    ``max_broadcast`` bytes of vectors (or ``query_block`` queries, if those are
    more) go to every task, and the index streams through once, unshuffled; more
    queries go in several groups, for each of which the index streams through
    again, so that no item is copied per query.  Each task keeps its k best, and
    a window the k best of those.  Where more than ``bounded`` neighbours are
    wanted, a part of the items is measured before, whose k best distances bound
    what tasks give; the result stays exact.  ``k`` is a number or a column of
    the queries; items are taken in blocks of at most ``item_block``.  Distances
    are rounded to 6 decimals, ties go to the smaller item id.  Null vectors
    match nothing; repeated query ids count once each.
    """
    kcol = F.lit(k) if isinstance(k, int) else F.col(k)
    kind = lambda df, c: "array<float>" if dict(df.dtypes)[c] == "array<float>" else "array<double>"
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).cast(kind(queries, query_vector)).alias("_v"), kcol.cast("int").alias("_k"))
    x = index.select(F.col(item_id).alias("_x"), F.col(item_vector).cast(kind(index, item_vector)).alias("_w")).where("_w is not null")
    q = cut(q).where("_v is not null and _k > 0")  # behind the cut, so that a model that gives _v runs once
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("_v")).alias("s")).first()
    qt, xt = dict(q.dtypes)["_q"], dict(x.dtypes)["_x"]
    out = f"_q {qt}, _x {xt}, dist double, _k int"
    matrix = lambda c: np.stack(c.to_numpy())
    most = max(1, query_block, max_broadcast * size.n // (8 * size.s) if size.s else 1)

    def near(q: DataFrame) -> DataFrame:
        got = q.toPandas()
        ks = got["_k"].to_numpy()
        held = queries.sparkSession.sparkContext.broadcast((got["_q"].to_numpy(), matrix(got["_v"]) if len(got) else np.zeros((0, 1)), ks))
        bound = _bounds(x, held, len(got), matrix) if ks.sum() > bounded else None
        bound = None if bound is None else queries.sparkSession.sparkContext.broadcast(bound)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, v, ks = held.value
            if len(ids):
                parts = (b[lo : lo + item_block] for b in batches for lo in range(0, len(b), item_block))
                b = _nearest(v, ks, ((b["_x"].to_numpy(), matrix(b["_w"])) for b in parts), bound and bound.value)
                for lo in range(0, len(b), 5000):
                    c = b.iloc[lo : lo + 5000]
                    yield pd.DataFrame({"_q": _plain(ids[c["q"].to_numpy()]), "_x": _plain(c["x"].to_numpy()), "dist": c["dist"].to_numpy(), "_k": ks[c["q"].to_numpy()]})

        return x.mapInPandas(run, out)

    n = -(-size.n // most)
    if n <= 1:
        found = near(q)
    else:
        q = cut(q.repartition(n))
        found = reduce(DataFrame.unionAll, (near(q.where(F.spark_partition_id() == i)) for i in range(n)))
    w = Window.partitionBy("_q").orderBy("dist", "_x")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= _k").select(F.col("_q").alias(query_id), F.col("_x").alias(item_id), "dist", "rank")


def first_wins(hits: DataFrame, question: str, order: list[str], content: str, prefix: int = 100) -> DataFrame:
    """Of hits of one question whose contents agree in the first ``prefix``
    characters, the first in ``order``; adds first_seen, its place in the question."""
    same = Window.partitionBy(question, F.left(F.col(content), F.lit(prefix))).orderBy(*order)
    kept = hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return kept.withColumn("first_seen", F.row_number().over(Window.partitionBy(question).orderBy(*order)))


def rerank(hits: DataFrame, question: str, text: str, k: int) -> DataFrame:
    """Stable order by relevance, best first, at most k per question."""
    return best_scored(hits.withColumn("score", scores.relevance(F.col(text), F.col("section"), F.col("content"))), question, k)


def best_scored(scored: DataFrame, question: str, k: int) -> DataFrame:
    """At most k hits per question by score, best first, then as first seen; adds rank."""
    w = Window.partitionBy(question).orderBy(F.desc("score"), "first_seen")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_questions(questions: DataFrame, k: int) -> DataFrame:
    """(question_id, question, query_ord, query, k): the searches of every question; null questions have none."""
    q = questions.where(F.col("question").isNotNull()).withColumn("_qs", scores.expand(F.col("question")))
    q = q.withColumn("k", scores.k_per_query(F.col("_qs"), k))
    return q.select("question_id", "question", "k", F.posexplode("_qs").alias("query_ord", "query"))


def exclude_seen(new: DataFrame, seen: DataFrame, question: str, order: list[str], once: bool) -> DataFrame:
    """New hits whose section the question has not seen, null counting as a section.

    ``once`` keeps only the first hit of every new section.
    """
    s = seen.select(F.col(question).alias("_sq"), F.col("section").alias("_ss")).distinct()
    out = new.join(s, (F.col(question) == F.col("_sq")) & F.col("section").eqNullSafe(F.col("_ss")), "left_anti")
    if once:
        w = Window.partitionBy(question, "section").orderBy(*order)
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out


def search_index(questions: DataFrame, index: DataFrame, k: int, embed) -> DataFrame:
    """(question_id, question, rank, chunk_id, section, content, score): a smart search of a stored index.

    Questions are expanded, every distinct query is embedded once by the model
    that embedded the index and searched once, the hits are cleared of repeats
    and ranked again.  ``index`` is what ``index.read_index`` returns: chunk_id,
    section, content, embedding.  Only chunks that are hits leave their scan with
    their text, and what needs the text is computed before hits are shuffled.
    """
    asked = expand_questions(questions, k)
    texts = cut(asked.groupBy("query").agg(F.max("k").alias("k")).withColumn("query_id", F.monotonically_increasing_id()))
    hits = knn(texts.withColumn("query_vector", embed(F.col("query"))), index, query_id="query_id", item_id="chunk_id", query_vector="query_vector", item_vector="embedding", k="k")
    hits = cut(hits.select("query_id", "chunk_id", F.col("rank").alias("hit_rank")))
    found = index.select("chunk_id", "section", "content")
    keys = hits.select(F.xxhash64("chunk_id").alias("_h")).distinct()
    if keys.count() <= MAX_KEYS:
        found = found.withColumn("_h", F.xxhash64("chunk_id")).join(F.broadcast(keys), "_h", "left_semi").drop("_h")
    asked = asked.join(texts.select("query_id", "query"), "query").select("query_id", "question_id", "question", "query_ord", "k")
    hits = hits.join(found, "chunk_id").join(asked, "query_id").where("hit_rank <= k")
    hits = hits.withColumn("score", scores.relevance(F.col("question"), F.col("section"), F.col("content"))).withColumn("_start", F.md5(F.left("content", F.lit(100))))
    seen = first_wins(hits.repartition("question_id"), "question_id", ["query_ord", "hit_rank"], "_start")
    return best_scored(seen, "question_id", k).select("question_id", "question", "rank", "chunk_id", "section", "content", "score")
