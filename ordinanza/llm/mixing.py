"""Mixing sources to target weights by Pfair scheduling of token blocks."""

from __future__ import annotations

import heapq
import math
import os
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = os.environ.get("ORDINANZA_TOKENIZERS", "/opt/tokenizers")
MAX_SOURCES, MAX_BLOCKS, PERIOD = 10_000, 200_000, 100_000


def count_tokens(df: DataFrame, key: str, text: str, folder: str = TOKENIZER, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, n_tokens) of whole texts by a public tokenizer file; a null text has 0."""
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    path = os.path.join(folder, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            t = b["_t"].fillna("").tolist()
            n = []
            for lo in range(0, len(t), 256):
                n += [len(e) for e in tok.encode_batch_fast(t[lo : lo + 256], add_special_tokens=False)]
            yield pd.DataFrame({key: b["_k"], "n_tokens": n})

    return src.mapInPandas(run, f"`{key}` {dict(src.dtypes)['_k']}, n_tokens long")


def pfair(weights: list[float], n_slots: int) -> list[tuple[int, int]]:
    """(source, block number from 0) of each slot.

    Block j of a source with weight w is released at floor(j / w) and due by
    ceil((j + 1) / w).  Released blocks run earliest deadline first; ties go to
    the one whose deadline and next release overlap, then to the heavier source.
    After every slot each source is less than one block away from its weight.
    """
    total = sum(Fraction(w).limit_denominator(10**9) for w in weights)
    ws = [Fraction(w).limit_denominator(10**9) / total for w in weights]

    def entry(i: int, j: int):
        due = math.ceil((j + 1) / ws[i])
        overlap = 0 if (j + 1) / ws[i] == due else 1
        return (due, -overlap, -ws[i], i, j)

    waiting = [(0, i, 0) for i, w in enumerate(ws) if w > 0]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(n_slots):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, entry(i, j))
        if not ready:  # cannot be while the weights sum to one; kept for rounding
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, entry(i, j))
        *_, i, j = heapq.heappop(ready)
        out.append((i, j))
        heapq.heappush(waiting, (math.floor((j + 1) / ws[i]), i, j + 1))
    return out


def whole_shares(weights: list[float], n: int) -> list[int]:
    """Whole numbers in proportion to the weights that add up to ``n``, by largest remainders, at least 1 each."""
    total = sum(weights)
    exact = [w / total * n for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    for k in range(abs(n - sum(out))):
        if sum(out) < n:
            out[order[k % len(out)]] += 1
        else:
            out[max(range(len(out)), key=lambda i: (out[i] - exact[i], out[i]))] -= 1
    return out


def running_total(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, without one task holding a group.

    Rows are range-partitioned by group and order; each partition sums its own
    rows, and the totals of earlier partitions, one row per partition and group,
    are added by a join.  ``order`` must be unique within a group.
    """
    d = cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    t = d.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("_part", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return d.join(t, ["_part", group]).withColumn(out, F.col("_in") + F.col("_base")).drop("_part", "_in", "_base")


def mix(sizes: DataFrame, targets: DataFrame, key: str, source: str = "source", size: str = "n_tokens", block_tokens: int | None = None, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(schedule, report).

    schedule: (slot, source, key, copy, n_tokens, source_offset), the mixture in
    the order of slot and source_offset, a record at most ``max_repeat`` times.
    report: one row per source of either side with weight (0 where it is no
    target), reachable weight, tokens, reached share, the largest number of uses
    and the block size.

    A block is ``block_tokens`` tokens, at least the largest record, which is
    the default.  A record belongs to the block that holds its middle.  Blocks
    are scheduled by ``pfair``, so that after every block each source is less
    than one block, and half a record for whole records, away from its share.
    The schedule of ``period`` slots, in which every source has a whole number
    of blocks by largest remainders, is computed once and repeated, so its size
    does not grow with the corpus; shares are rounded to 1 / period only if
    there are more slots than that.

    The total is the largest for which no source runs out: the smallest
    tokens x max_repeat / weight.  Target sources without tokens cannot be met;
    their weight goes to the others in proportion and the report says so.
    Records of unlisted or null sources, and records without tokens, are not
    used.  Repeats come after every record of the source has been used once more.
    """
    if period > MAX_BLOCKS:
        raise ValueError(f"at most {MAX_BLOCKS} slots in a period")
    spark = sizes.sparkSession
    tg = targets.where(F.col(source).isNotNull() & (F.col("weight") > 0) & (F.col("max_repeat") > 0)).groupBy(source).agg(F.sum("weight").alias("weight"), F.min("max_repeat").alias("max_repeat")).limit(MAX_SOURCES + 1).collect()
    if len(tg) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    recs = cut(sizes.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(source).alias("_s"), F.col(key).alias("_k"), F.col(size).cast("long").alias("_n")))
    listed = sorted(r[source] for r in tg)
    sums = recs.where(F.col("_s").isin(listed)).groupBy("_s").agg(F.sum("_n").alias("t"), F.max("_n").alias("m")).collect() if listed else []
    have = {r["_s"]: r["t"] for r in sums}
    use = sorted((r for r in tg if have.get(r[source])), key=lambda r: r[source])
    total_w = sum(r["weight"] for r in use)
    goal = {r[source]: r["weight"] / total_w for r in use}
    total = min((have[r[source]] * r["max_repeat"] / goal[r[source]] for r in use), default=0)
    block = max(block_tokens or 1, max((r["m"] for r in sums), default=1))
    n_slots = max(1, math.ceil(total / block))
    turn = period
    if n_slots <= period:
        turn, counts = n_slots + len(use), None
        slots = pfair([goal[r[source]] for r in use], turn) if use else []
    else:
        counts = whole_shares([goal[r[source]] for r in use], period)
        slots = pfair(counts, period)
    plan = spark.createDataFrame([(use[i][source], j, n) for n, (i, j) in enumerate(slots)], "_s string, _turn long, _slot long")
    need = [(s, g * total, min(next(int(r["max_repeat"]) for r in use if r[source] == s), math.ceil(g * total / have[s] - 1e-9)), int(counts[i]) if counts else turn + 1) for i, (s, g) in enumerate(goal.items())]
    need = spark.createDataFrame(need, "_s string, _goal double, _passes int, _per long")
    x = recs.join(F.broadcast(need), "_s").withColumn("copy", F.explode(F.sequence(F.lit(1), "_passes"))).withColumn("_h", F.xxhash64("copy", "_k"))
    x = running_total(x.drop("_passes"), "_s", ["copy", "_h", "_k"], "_n", "_at").withColumn("_mid", F.col("_at") + F.col("_n") / 2).where("_mid < _goal")
    x = x.withColumn("_block", F.floor(F.col("_mid") / F.lit(float(block))).cast("long"))
    x = x.withColumn("_turn", F.col("_block") % F.col("_per")).withColumn("_round", F.floor(F.col("_block") / F.col("_per")))
    used = x.join(F.broadcast(plan), ["_s", "_turn"], "left")
    # the last, partial block of a light source may lie behind the planned slots
    slot = (F.col("_round") * F.lit(turn) + F.coalesce("_slot", F.lit(turn) + F.col("_turn"))).cast("long")
    schedule = cut(used.select(slot.alias("slot"), F.col("_s").alias(source), F.col("_k").alias(key), "copy", F.col("_n").alias(size), F.col("_at").alias("source_offset")))
    got = schedule.groupBy(source).agg(F.sum(size).alias("tokens"), F.max("copy").alias("max_used"), F.count("*").alias("n_records"))
    all_tokens = schedule.agg(F.sum(size)).first()[0] or 0
    wanted = spark.createDataFrame([(r[source], float(r["weight"]), goal.get(r[source], 0.0), int(r["max_repeat"])) for r in tg], f"{source} string, weight double, reachable_weight double, max_repeat int")
    every = wanted.select(source).unionByName(recs.select(F.col("_s").alias(source))).distinct()
    report = every.join(wanted, source, "left").join(got, source, "left").na.fill({"tokens": 0, "max_used": 0, "n_records": 0, "weight": 0.0, "reachable_weight": 0.0, "max_repeat": 0})
    report = report.withColumn("share", F.round(F.col("tokens") / F.lit(float(max(1, all_tokens))), 6)).withColumn("block_tokens", F.lit(int(block)))
    return schedule, report
