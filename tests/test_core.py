"""Golden cases for parsing, scores, search, merges, context and answers."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinanza import sources
from ordinanza.functions import lexicon, scores, text
from ordinanza.operators import answer, chunks, context, index, models, search, sections, selfquery


def one(spark, c, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names))
    return df.select(c.alias("x")).first()["x"]


def test_split_inline_boundaries(spark):
    df = spark.createDataFrame([(1, "pre 1.2.3 aaa 20.16.0301 bbb 120.16.030 tail 7.1.2"), (2, None), (3, ""), (4, "none")], "k int, t string")
    got = [(r.section, r.content) for r in sections.split_inline(df, "k", "t").orderBy("ordinal").collect()]
    assert got == [("1.2.3", " aaa "), ("20.16.030", "1 bbb 1"), ("20.16.030", " tail "), ("7.1.2", "")]


def test_split_inline_length_is_strict(spark):
    df = spark.createDataFrame([(1, "1.2.3" + "a" * 100 + "1.2.4" + "b" * 101)], "k int, t string")
    assert [r.section for r in sections.split_inline(df, "k", "t", 100).collect()] == ["1.2.4"]


def test_split_lines_state(spark):
    lines = ["pre", " 1.2.3 T one", "", "body a", "1.2.3 again", "  x", "9.9 no", "12.3.4x tail", "end"]
    df = spark.createDataFrame([("d", i // 4, i, x) for i, x in enumerate(lines)], "doc string, page int, pos int, t string")
    got = [(r.section, r.content) for r in sections.split_lines(df, "doc", "page", ["pos"], "t").orderBy("header_no").collect()]
    assert got == [("1.2.3", "1.2.3 T one\nbody a"), ("1.2.3", "1.2.3 again\nx\n9.9 no"), ("12.3.4", "12.3.4x tail\nend")]


def test_split_lines_against_loop(spark):
    rng = random.Random(3)
    rows, want = [], []
    for d in range(12):
        cur = None
        for i in range(40):
            x = rng.choice(["", "  ", "text", " 3.4.5 head", "10.20.300 more", "4.5 no", "x 1.2.3"])
            rows.append((d, i // 7, i, x))
            s = x.strip()
            if not s:
                continue
            m = re.match(r"\d+\.\d+\.\d+", s)
            if m:
                cur = [d, m.group(), [s]]
                want.append(cur)
            elif cur:
                cur[2].append(s)
    df = spark.createDataFrame(rows, "doc int, page int, pos int, t string")
    got = sorted((r.doc, r.section, r.content) for r in sections.split_lines(df, "doc", "page", ["pos"], "t").collect())
    assert got == sorted((d, s, "\n".join(c)) for d, s, c in want)


def test_python_space(spark):
    assert one(spark, text.strip(F.col("a")), a=" \x1c x y\u3000") == "x y"
    assert one(spark, text.tokens(F.col("a")), a="\u00a0a\x1fb  c ") == ["a", "b", "c"]


@pytest.mark.parametrize("s,n", [("20.16.030", 15), ("20.160.1", 15), ("20.15.1", 0), ("18.1.1", 10), ("17.1.1", 0), ("7.1.1", 8), ("10.1.1", 12), ("9.1.1", 14), ("8.1.1", 16), (None, 0)])
def test_section_bonus(spark, s, n):
    assert one(spark, scores.section_bonus(F.col("a")), a=s) == n


@pytest.mark.parametrize("s,n", [("shall not", 11), ("disallowed", 3), ("Unlawful; public place; excrete; required", 27), (None, 0)])
def test_quality_bonus(spark, s, n):
    assert one(spark, scores.quality_bonus(F.col("a")), a=s) == n


def test_word_match_keeps_punctuation(spark):
    assert one(spark, scores.word_match(F.col("a"), F.col("b")), a="Fence? wall WALL", b="fence wall wall") == 1


@pytest.mark.parametrize("q,n", [("hello", 1), ("a fence", 3), ("fence and pet", 5), ("bathroom fence", 6), ("fence pet store", 6)])
def test_expansion_and_k(spark, q, n):
    assert len(one(spark, scores.expand(F.col("a")), a=q)) == n
    assert one(spark, scores.k_per_query(scores.expand(F.col("a")), 12), a=q) == {1: 12, 3: 4, 5: 2, 6: 2}[n]


def test_references(spark):
    t = "See Section 10.16.090 and chapter 7.04, 8.1.2.3x and 9.9.9.9. v1.2.3 1.2.3.4.5"
    assert one(spark, scores.section_refs(F.col("a")), a=t) == ["10.16.090", "8.1.2", "9.9.9.9", "1.2.3.4.5"]
    assert "7.04" in one(spark, scores.section_refs_all(F.col("a")), a=t)
    assert one(spark, scores.search_terms(F.col("a")), a="SEARCH: a b \nsearch:\nSearch: c") == ["a b", "Search: c"]


def test_strict_phrase_with_capital_never_matches(spark):
    assert one(spark, scores.needs_more(F.col("a"), ["I would need to see other sections"]), a="I would need to see other sections") is False
    assert one(spark, scores.needs_more(F.col("a"), lexicon.NEEDS_MORE_STRICT), a="I would need to see other sections") is True


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(150, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "i int, v array<double>")
    got = search.knn(df.where("i < 20").select(F.col("i").alias("q"), F.col("v").alias("w")), df, query_id="q", item_id="i", query_vector="w", item_vector="v", k=5, query_block=6, item_block=40)
    have = {(r.q, r["rank"]): r.i for r in got.collect()}
    for q in range(20):
        d = np.round(((v - v[q]) ** 2).sum(1), 6)
        assert [have[q, k + 1] for k in range(5)] == np.lexsort((np.arange(150), d))[:5].tolist()


def test_first_wins_and_rerank(spark):
    same = "c" * 100
    rows = [(1, 1, 1, same + "x", None), (1, 0, 2, same + "y", None), (1, 0, 1, "fence shall", "7.1.1")]
    df = spark.createDataFrame(rows, "q int, o int, r int, content string, section string")
    got = search.first_wins(df, "q", ["o", "r"], "content")
    assert {r.content[-1]: r.first_seen for r in got.collect()} == {"l": 1, "y": 2}
    top = search.rerank(got.withColumn("question", F.lit("fence")), "q", "question", 1).collect()
    assert [(r.section, r.score) for r in top] == [("7.1.1", 12)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "qid int, rank int, section string, content string")


def test_merges(spark):
    docs = _docs(spark, [(1, 1, "a", "x"), (1, 2, None, "y")])
    new = _docs(spark, [(1, 1, "b", "p"), (1, 2, "b", "q"), (1, 3, None, "r"), (1, 4, "a", "s")])
    assert [r.content for r in answer.fallback_merge(docs, new, "qid").orderBy("rank").collect()] == ["x", "y", "p", "q"]
    assert [r.content for r in answer.second_pass_merge(docs, new, "qid").orderBy("rank").collect()] == ["x", "y", "p"]


def test_context(spark):
    rows = [(1, i, f"s{i}", "c") for i in range(1, 10)] + [(2, 1, None, "a" * 1000), (2, 2, "z", "b" * 1001), (2, 3, "z", "never"), (2, 4, "e", None)]
    got = {r.qid: r.context for r in context.format_context(_docs(spark, rows), "qid").collect()}
    assert got[1].count("Section ") == 8
    assert got[2] == "Section Unknown:\n" + "a" * 1000 + "\n\nSection z:\n" + "b" * 1000 + "...\n\nSection e:\n"


def test_ask_outcomes(spark):
    qs = spark.createDataFrame([(1, "fence"), (2, "x"), (3, "wall"), (4, "y"), (5, "see 1.1.1"), (6, "animal")], "question_id int, question string")
    full = [(7, i, f"s{i}", "t") for i in range(1, 6)]
    docs = spark.createDataFrame([(1, 1, "a", "t"), (3, 1, "a", "t"), (4, 1, "b", "t"), (6, 1, "b", "t"), *full], "question_id int, rank int, section string, content string")
    qs = qs.unionByName(spark.createDataFrame([(7, "many")], "question_id int, question string"))
    fb = spark.createDataFrame([(5, 1, "1.1.1", "u"), (4, 1, "b", "seen"), (4, 2, "1.1.1", "v"), (7, 1, "1.1.1", "w")], "question_id int, rank int, section string, content string")

    def reply(i, prompt, ctx):
        text = F.when(i.isin(1, 3, 6), F.concat(ctx, F.lit(" additional information"))).otherwise(ctx)
        fails = (i == 4) | (i == 6) & ctx.contains("new")
        return F.struct(F.when(~fails, text).alias("answer"), F.when(fails, F.lit("down")).alias("error"))

    def second(terms):
        return terms.where("question_id in (1, 6)").select("question_id", F.lit(1).alias("rank"), F.lit("n").alias("section"), F.lit("new").alias("content")).distinct()

    got = {r.question_id: r for r in answer.ask(qs, docs, second, reply, lambda d: d, fb).collect()}
    assert [got[i].iterations for i in range(1, 8)] == [2, 0, 1, 1, 1, 1, 1]
    assert [got[i].success for i in range(1, 8)] == [True, False, True, False, True, False, True]
    assert [got[i].n_documents for i in range(1, 8)] == [2, 0, 1, 2, 1, 1, 5]
    assert [(d.section, d.content) for d in got[1].documents] == [("a", "t"), ("n", "new")] and got[2].documents == [] and got[5].documents[0].content == "u"
    assert got[3].note == "Comprehensive search completed" and not any(got[i].note for i in (1, 2, 4, 5, 6, 7))
    assert got[4].error == got[6].error == "Error generating response: down" and got[4].answer is None and got[2].error == "No relevant documents found"


def test_reading_of_answers(spark):
    q = lambda a, b: one(spark, scores.quick_terms(F.col("a"), F.col("b")), a=a, b=b)
    assert q("a fence, see 1.1.1, 2.2.2 and 3.3.3", "may I?") == ["1.1.1", "2.2.2"]
    assert q("none", "Is a WALL fine?") == ["fence height zoning"] and q("none", None) == []
    assert one(spark, scores.section_refs_all(F.col("a")), a="Chapter 7.04.010") == ["7.04", "7.04.010"]
    assert one(spark, scores.search_terms(F.col("a")), a="SEARCH:\nnoise rules\nsearch: \n\n b \nSEARCH:") == ["noise rules", "b"]


def test_merge_leaves_questions_with_enough_documents(spark):
    docs = _docs(spark, [(1, i, f"s{i}", "x") for i in range(1, 6)] + [(2, 1, "a", "x")])
    new = _docs(spark, [(1, 1, "n", "p"), (2, 1, "n", "q"), (3, 1, "n", "r")])
    got = [(r.qid, r.content) for r in answer.fallback_merge(docs, new, "qid").orderBy("qid", "rank").collect()]
    assert got == [(1, "x")] * 5 + [(2, "x"), (2, "q"), (3, "r")]


def test_models_that_fail(spark):
    def bad(t):
        if "x" in t:
            raise ValueError("no")
        return np.ones(2)

    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", models.embed(F.col("t"), bad).alias("v"), models.generate(F.col("t"), lambda t: str(bad(t))).alias("g")).collect()}
    assert got[1].v == [1, 1] and got[2].v is None and got[3].v is None
    assert got[2].g.error == "no" and got[2].g.answer is None and got[1].g.error is None and got[3].g.answer is None


def test_stored_index_end_to_end(spark, tmp_path):
    texts = [(i, f"1.1.{i}", f"{w} rules. " * 40) for i, w in enumerate(["fence", "animal", "noise", "business"] * 15)] + [(99, None, None)]
    df = spark.createDataFrame(texts, "k int, section string, t string")
    at = str(tmp_path / "store")
    rep = {r.batch_no: r for r in index.load_index(df, at, "one", models.embed, key="k", text="t").collect()}
    assert {b: (r.n_docs, r.n_written, r.ok) for b, r in rep.items()} == {0: (50, 50, True), 1: (10, 10, True)} and rep[1].message == "Batch 2 (10 docs) added"
    fails = index.load_index(df, str(tmp_path / "bad"), "one", lambda c: models.embed(c, lambda t: 1 / 0), key="k", text="t").collect()
    assert not any(r.ok for r in fails) and "without vector" in fails[0].message
    idx = index.read_index(spark, at + "/index", "one")
    q = spark.createDataFrame([(1, "noise rules"), (2, None)], "question_id int, question string")
    hits = search.search_index(q, idx, 4, models.embed).collect()
    assert hits and all("noise" in r.content for r in hits) and {r.question_id for r in hits} == {1}
    best = search.search_index(q, idx, 4, models.embed).join(idx.select("chunk_id", "parent_id"), "chunk_id")
    up = index.parents_of(best, index.read_index(spark, at + "/parents", "one")).collect()
    assert up and all(r.content == texts[r.parent_id][2] for r in up)
    d = index.describe_path(spark, at + "/index", "one", models.embed, "business")
    assert d["status"] == "POPULATED" and d["sample_content"].startswith("business") and len(d["sample_content"]) == 100
    assert index.describe_path(spark, at + "/none", "one", models.embed)["error"] == "Directory does not exist"
    assert index.describe_path(spark, at + "/index", "two", models.embed)["status"] == "EMPTY"
    (tmp_path / "junk").mkdir()
    assert index.describe_path(spark, str(tmp_path / "junk"), "one", models.embed)["error"]


def test_pages_and_preflight(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj<</Type /Pages /Kids [2 0 R 3 0 R] /Count 2>>\n2 0 obj<</Type /Page>>\n3 0 obj<</Type /Page>>")
    (tmp_path / "b.pdf").write_bytes(b"x" * 300 + b"\n\fsecond")
    files = sources.read_files(spark, str(tmp_path))
    assert sorted(r.pages for r in sources.page_counts(files).collect()) == [2, 2]
    got = {(r.path[-5:], r.page): r for r in sources.load_pages(files.where("path like '%b.pdf'"), sources.text_extractor).collect()}
    assert got["b.pdf", 1].preview == "x" * 200 and got["b.pdf", 1].n_chars == 300 and got["b.pdf", 2].text == "second"
    checks = sources.preflight(spark, {"text": str(tmp_path / "a.pdf"), "index": str(tmp_path / "no")}, ["NO_SUCH_SETTING"])
    assert [ok for _, ok, _ in checks] == [True, False, False] and "not found at" in checks[1][2]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_knn_paths_agree(spark, bound):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    v[9] = v[4]
    df = spark.createDataFrame([(f"i{i:03d}", x.tolist()) for i, x in enumerate(v)], "i string, v array<float>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist(), 1 + i % 4) for i in range(30)] + [(77, None, 3)], "q int, w array<float>, k int")
    got = search.knn(q, df, query_id="q", item_id="i", query_vector="w", item_vector="v", k="k", max_broadcast=bound, query_block=7, item_block=90)
    have = {(r.q, r["rank"]): r.i for r in got.collect()}
    v = v.astype(np.float32).astype(float)
    for i in range(30):
        d = np.round(((v - v[i]) ** 2).sum(1), 6)
        assert [have[i, k + 1] for k in range(1 + i % 4)] == [f"i{j:03d}" for j in np.lexsort((np.arange(400), d))[: 1 + i % 4]]
    assert len(have) == sum(1 + i % 4 for i in range(30))


def test_chunks_invariants():
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "x" * 30, "\n", "\n\n", " ", "Long sentence here. "]) for _ in range(rng.randint(0, 120)))
        got = chunks.chunk_text(t, 100, 30)
        assert all(0 < len(c) <= 100 and c == c.strip() for c in got)
        assert re.sub(r"\s", "", t) == "" or got
        assert set(re.findall(r"\S+", t)) and all(c in t for c in got) or not got
    assert chunks.chunk_text("") == [] and chunks.chunk_text("   ") == []


def test_children_keep_columns(spark):
    df = spark.createDataFrame([(1, "s", "a b " * 300), (2, None, None)], "k int, sec string, t string")
    got = chunks.expand_children(df, "k", "t", "sec").collect()
    assert {r.sec for r in got} == {"s"} and [r.chunk_no for r in got] == list(range(len(got)))


def test_batches_and_report(spark):
    df = spark.range(120).withColumn("ok", F.col("id") % 60 != 0)
    got = index.batches(df, "id")
    assert {r.id: r.batch_no for r in got.collect()} == {i: i // 50 for i in range(120)}
    rep = {r.batch_no: (r.n_docs, r.ok, r.n_failed) for r in index.batch_report(got.join(df, "id"), "batch_no", F.col("ok")).collect()}
    assert rep == {0: (50, False, 1), 1: (50, False, 1), 2: (20, True, 0)}


def test_index_round_trip(spark, tmp_path):
    p = str(tmp_path / "index")
    a = spark.createDataFrame([(1, "x")], "i int, c string")
    index.write_index(a, p, "one")
    index.write_index(a, p, "two")
    index.write_index(a.withColumn("i", F.lit(5)), p, "one")
    assert [r.i for r in index.read_index(spark, p, "one").collect()] == [5]
    assert [r.i for r in index.read_index(spark, p, "two").collect()] == [1]


def test_filters(spark):
    df = spark.createDataFrame([("1.1.1", 1), ("2.2.2", 2), (None, 3)], "section string, n int")
    f = selfquery.compile_filter('{"or": [{"eq": ["section", "1.1.1"]}, {"and": [{"gt": ["n", 1]}, {"lt": ["n", 3]}]}]}')
    assert [r.n for r in df.where(f).collect()] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo\f three ")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = sources.extract_elements(sources.read_files(spark, str(tmp_path)), sources.text_extractor).collect()
    assert sorted((r.page, r.text) for r in got if not r.error) == [(1, "one"), (1, "two"), (2, " three ")]
    assert sum(bool(r.error) for r in got) == 1
    d = spark.createDataFrame([("x", 10), ("y", 3)], "doc string, pages int")
    r = sources.page_ranges(d, "pages", 8).where("doc = 'x'").orderBy("range_no").collect()
    assert [(x.start_page, x.end_page) for x in r] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    calls = []
    make = lambda: calls.append(1) or d
    for _ in range(2):
        assert sources.cached(spark, str(tmp_path / "cache"), make).count() == 2
    assert calls == [1]
    for n in ("chroma_db", "my_chroma", "db2", "other"):
        (tmp_path / "w" / n).mkdir(parents=True)
    assert sources.discover_indexes(spark, str(tmp_path / "w")) == ["chroma_db", "db2", "my_chroma"]


def test_display(spark):
    assert one(spark, text.highlight(F.col("a")), a="see section 1.2.3 and 4.5.6") == "see [section 1.2.3] and 4.5.6"
    assert one(spark, text.strip_ansi(F.col("a")), a="\x1b[1;34mx\x1b[0m") == "x"
    assert one(spark, text.wrap(F.col("a"), 7), a="aa bbb cc dddddddddd") == ["aa bbb", "cc", "dddddddddd"]
    assert one(spark, text.wrap(F.col("a"), 6), a="aa bbb cc ddd") == ["aa", "bbb cc", "ddd"]
    assert one(spark, text.preview(F.col("a"), 3), a="abcd") == "abc..."


def test_models(spark):
    df = spark.createDataFrame([("a fence",), (None,)], "q string")
    v = [r.v for r in df.select(models.embed(F.col("q")).alias("v")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[1] is None


def test_streaming(spark, tmp_path):
    from ordinanza import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("can I?\nquit\n")
    q = streaming.question_stream(spark, str(tmp_path / "in"))
    streaming.answer_stream(q, lambda b: b.withColumn("answer", F.lit("yes")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.question for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["can I?"]


def test_inverted_index(spark):
    from ordinanza.operators import ivf

    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 16)) * 3
    v = hubs[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "i long, v array<float>").repartition(5)
    q = df.where("i % 20 = 0").select(F.col("i").alias("q"), F.col("v").alias("w"))
    c = ivf.fit_centroids(df, "i", "v")
    built = ivf.build(df, "v", c)
    assert built.count() == 1500
    how = dict(query_id="q", item_id="i", query_vector="w", item_vector="v", k=8)
    rows = lambda d: {(r.q, r["rank"]): (r.i, r.dist) for r in d.collect()}
    exact = rows(search.knn(q, df, **how))
    assert rows(ivf.search(q, built, c, probes=len(c), query_block=20, item_block=40, **how)) == exact
    probes = ivf.probes_for(df, "i", "v", c, 8)
    assert 1 <= probes < len(c)
    some = rows(ivf.search(q, built, c, probes=probes, **how))
    hit = {(k[0], x[0]) for k, x in some.items()} & {(k[0], x[0]) for k, x in exact.items()}
    assert len(hit) / len(exact) >= 0.9
    none = df.where("i < 0")
    assert ivf.search(q, ivf.build(none, "v", ivf.fit_centroids(none, "i", "v")), ivf.fit_centroids(none, "i", "v"), probes=3, **how).count() == 0
