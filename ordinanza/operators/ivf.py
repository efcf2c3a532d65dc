"""Approximate nearest neighbours: an inverted index of cells around centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .search import _nearest, _plain

SAMPLE = 20_000
MAX_CENTROIDS = 64 << 20


def _matrix(c) -> np.ndarray:
    return np.stack(c.to_numpy()).astype(np.float32)


def _sample(index: DataFrame, item_id: str, vector: str, n: int) -> np.ndarray:
    rows = index.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).orderBy(F.xxhash64(item_id), item_id).limit(n).toPandas()
    return _matrix(rows["v"]) if len(rows) else np.zeros((0, 1), np.float32)


def probes_for(index: DataFrame, item_id: str, vector: str, centroids: np.ndarray, k: int, recall: float = 0.95, sample: int = SAMPLE) -> int:
    """The fewest cells to probe with which ``recall`` of the k nearest are found, measured on the sample.

    Up to 500 vectors of the sample are its queries.  Vectors without clusters need most cells.
    """
    x = _sample(index, item_id, vector, sample)
    if not len(centroids) or len(x) <= 1:
        return max(1, len(centroids))
    q = x[:500]
    near = np.argsort((x * x).sum(1)[None] - 2 * q @ x.T, axis=1)[:, 1 : k + 1]
    cell = ((centroids * centroids).sum(1)[None] - 2 * x @ centroids.T).argmin(1)
    order = np.argsort((centroids * centroids).sum(1)[None] - 2 * q @ centroids.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    needed = np.take_along_axis(place, cell[near], 1).ravel()  # probes before the cell of each true neighbour
    return int(np.quantile(needed, recall, method="higher")) + 1


def fit_centroids(index: DataFrame, item_id: str, vector: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 4) -> np.ndarray:
    """Centroids of k-means on at most ``sample`` vectors, chosen by a hash of the id, on the driver.

    ``cells`` is the square root of the sample size by default.  Only the fit is
    on a sample; every row is indexed.  An empty index gives no centroids.
    """
    x = _sample(index, item_id, vector, sample)
    if not len(x):
        return x
    k = min(len(x), cells or max(1, round(math.sqrt(len(x)))))
    if 4 * k * x.shape[1] > MAX_CENTROIDS:
        raise ValueError(f"{k} centroids take more than {MAX_CENTROIDS} bytes")
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def build(index: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """Every row with its ``cell``, the nearest centroid; rows without a vector are left out. Row-local."""
    held = index.sparkSession.sparkContext.broadcast(centroids)
    fields = ", ".join(f"`{c}` {t}" for c, t in index.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for b in batches:
            if len(b) and len(c):
                yield b.assign(cell=((c * c).sum(1)[None] - 2 * _matrix(b[vector]) @ c.T).argmin(1).astype(np.int32))

    return index.where(F.col(vector).isNotNull()).mapInPandas(run, f"{fields}, cell int")


def search(queries: DataFrame, built: DataFrame, centroids: np.ndarray, *, query_id: str, item_id: str, query_vector: str, item_vector: str, k: int,
           probes: int, query_block: int = 512, item_block: int = 50_000) -> DataFrame:
    """(query_id, item_id, dist, rank): the k nearest among the items of each query's ``probes`` nearest cells.

    ``built`` should be stored (``build`` and a write partitioned by cell, or a
    checkpoint).  Cells are cut into blocks of bounded size on both sides, so a
    hot cell is many tasks.  Distances and ties are those of the exact search;
    with as many probes as cells the result is exact.
    """
    held = queries.sparkSession.sparkContext.broadcast(centroids)
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v"))
    x = built.select(F.col(item_id).alias("_x"), F.col(item_vector).alias("_w"), "cell")
    qt, xt, vt = dict(q.dtypes)["_q"], dict(x.dtypes)["_x"], dict(q.dtypes)["_v"]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for b in batches:
            if len(b) and len(c):
                d = (c * c).sum(1)[None] - 2 * _matrix(b["_v"]) @ c.T
                n = min(probes, len(c))
                cells = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield b.assign(cells=[r.astype(np.int32) for r in cells])

    asked = cut(q.mapInPandas(route, f"_q {qt}, _v {vt}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells"))
    # one row per cell, of which there are at most as many as centroids
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_block).alias("_nq")).join(x.groupBy("cell").agg(F.ceil(F.count("*") / item_block).alias("_nx")), "cell")
    blocks = F.broadcast(cut(blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = asked.join(blocks, "cell").withColumn("_bq", F.pmod(F.xxhash64("_q"), F.col("_nq"))).withColumn("_bx", each(F.col("_nx"))).drop("_nq", "_nx")
    b = x.join(blocks, "cell").withColumn("_bx", F.pmod(F.xxhash64("_x"), F.col("_nx"))).withColumn("_bq", each(F.col("_nq"))).drop("_nq", "_nx")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_q": a["_q"][:0], "_x": b["_x"][:0], "dist": np.zeros(0)})
        r = _nearest(_matrix(a["_v"]).astype(np.float64), np.full(len(a), k), [(b["_x"].to_numpy(), _matrix(b["_w"]).astype(np.float64))])
        return pd.DataFrame({"_q": _plain(a["_q"].to_numpy()[r["q"].to_numpy()]), "_x": _plain(r["x"].to_numpy()), "dist": r["dist"].to_numpy()})

    near = a.groupBy("cell", "_bq", "_bx").cogroup(b.groupBy("cell", "_bq", "_bx")).applyInPandas(pair, f"_q {qt}, _x {xt}, dist double")
    w = Window.partitionBy("_q").orderBy("dist", "_x")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_x").alias(item_id), "dist", "rank")
