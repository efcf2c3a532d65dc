"""Cases for the findings of FINDINGS_r03.md."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinanza.operators import index, models, search


@pytest.mark.parametrize("bounded", [0, 1 << 16])
@pytest.mark.parametrize("n", [3, 700])
def test_knn_of_more_queries_than_go_to_a_task(spark, bounded, n):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    v[n // 2] = v[1]
    w = np.concatenate([v[:1], rng.normal(size=(49, 8)).astype(np.float32)])
    df = spark.createDataFrame([(f"i{i:03d}", x.tolist()) for i, x in enumerate(v)], "i string, v array<float>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist(), 1 + i % 5) for i, x in enumerate(w)] + [(77, None, 3), (78, w[0].tolist(), 0)], "q int, w array<float>, k int")
    got = search.knn(q, df, query_id="q", item_id="i", query_vector="w", item_vector="v", k="k", max_broadcast=0, query_block=20, item_block=90, bounded=bounded)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan  # no copy of the items per block of queries
    have = {(r.q, r["rank"]): (r.i, r.dist) for r in got.collect()}
    want = {}
    for i, x in enumerate(w.astype(float)):
        d = np.round(((v - x) ** 2).sum(1), 6)
        want |= {(i, k + 1): (f"i{j:03d}", d[j]) for k, j in enumerate(np.lexsort((np.arange(n), d))[: 1 + i % 5])}
    assert have == want


def test_a_query_of_many_questions_is_embedded_and_searched_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"1.1.{i}", f"{w} rules {i}. " * 40) for i, w in enumerate(["fence", "animal", "noise"] * 9)], "k int, section string, t string")
    at = str(tmp_path / "store")
    index.load_index(docs, at, "one", models.embed, key="k", text="t")
    idx = index.read_index(spark, at + "/index", "one")
    calls = spark.sparkContext.accumulator(0)

    def counted(t):
        calls.add(1)
        return models.hashed_bag(t)

    q = spark.range(40).repartition(8).select(F.col("id").alias("question_id"), F.lit("noise rules").alias("question"))
    n = search.expand_questions(q, 4).select("query").distinct().count()
    hits = search.search_index(q, idx, 4, lambda c: models.embed(c, counted)).collect()
    assert calls.value == n
    by = {}
    for r in hits:
        by.setdefault(r.question_id, {})[r["rank"]] = (r.chunk_id, r.score)
    assert len(by) == 40 and all(x == by[0] for x in by.values()) and all("noise" in r.content for r in hits)


def test_search_with_more_hits_than_keys_go_to_a_task(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f"1.1.{i}", f"{w} rules {i}. " * 40) for i, w in enumerate(["fence", "animal", "noise"] * 9)], "k int, section string, t string")
    at = str(tmp_path / "store")
    index.load_index(docs, at, "one", models.embed, key="k", text="t")
    q = spark.createDataFrame([(1, "noise rules"), (2, "Is a fence near an animal allowed?"), (3, None), (4, "")], "question_id int, question string")
    found = lambda: sorted(map(tuple, search.search_index(q, index.read_index(spark, at + "/index", "one"), 6, models.embed).collect()))
    few = found()
    monkeypatch.setattr(search, "MAX_KEYS", 0)
    assert few == found() and {r[0] for r in few} == {1, 2, 4}


def test_load_index_stores_every_document_once(spark, tmp_path):
    keys = [f"k{i:03d}" for i in range(130)] + ["k120", None]
    docs = spark.createDataFrame([(k, "1.1.1", f"text of {k}") for k in keys], "k string, section string, t string").repartition(6)
    at = str(tmp_path / "store")
    out = {r.batch_no: (r.n_docs, r.n_written, r.ok) for r in index.load_index(docs, at, "one", models.embed, key="k", text="t").collect()}
    kept = index.read_index(spark, at + "/parents", "one").collect()
    assert sorted(r.parent_id for r in kept) == sorted(k for k in keys if k)
    assert sum(n for n, _, _ in out.values()) == 131 and all(n == w and ok for n, w, ok in out.values())
    in_order = sorted((r.parent_id, r.batch_no) for r in kept)
    assert [b for _, b in in_order] == sorted(b for _, b in in_order) and set(out) == {0, 1, 2}
