"""Cases added in the second round: values never seen in training, and size-independent rules."""

import os

import pytest
from pyspark.sql import functions as F

from ordinanza.llm import pii


# -- 9 personal information ----------------------------------------------------------

UNSEEN = [
    ("Harold Whitcombe called about the fence.", [("name", "Harold Whitcombe")]),
    ("John Smith lives at 12 Oak Street.", [("name", "John Smith"), ("address", "12 Oak Street")]),
    ("Emily Johnson and Michael Brown own 77 Sycamore Circle.", [("name", "Emily Johnson"), ("name", "Michael Brown"), ("address", "77 Sycamore Circle")]),
    ("My name is Wei Zhang; SSN 123-45-6789.", [("name", "Wei Zhang"), ("id", "123-45-6789")]),
    ("Yours, Robert Wilson", [("name", "Robert Wilson")]),
    ("Return it to Tom Baker, 4500 Willow Bend Trail, by May 4.", [("name", "Tom Baker"), ("address", "4500 Willow Bend Trail")]),
    ("The applicant June Carter spoke in June 2004.", [("name", "June Carter")]),
    ("The City Council met on Main Street in Springfield.", []),
]


def test_values_never_seen_in_training():
    texts = [t for t, _ in UNSEEN]
    got = [[(k, t[a:b]) for a, b, k in s] for t, s in zip(texts, pii.find_spans(texts, pii.load()))]
    assert got == [w for _, w in UNSEEN]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no test tables")
def test_recall_with_all_values_exchanged():
    import pandas as pd

    from ordinanza.llm import pii_training as P

    texts = [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna().unique()]
    names = P.Names(texts, least=1)
    make = P.Maker(991)
    rows = [P.exchange(t, P.label(t, names), make, 1.0) for t in texts[:300]]
    want = [{(a, k) for a, b, k in s} for _, s in rows]
    got = [{(a, k) for a, b, k in s} for s in pii.find_spans([t for t, _ in rows], pii.load())]
    hit, n = sum(len(g & w) for g, w in zip(got, want)), sum(map(len, want))
    assert n > 200 and hit / n >= 0.9


def test_forms_longer_than_the_first_margin():
    mail = "a" * 300 + "@" + "b" * 100 + ".example.com"
    text = f"write to {mail} today"
    at = text.index(mail)
    assert pii.check_span(text, at + 250, at + 310, "email") == (at, at + len(mail))


# -- 3 lines of a site -----------------------------------------------------------

def test_templates_open_slots_and_merge_over_partitions(spark):
    from ordinanza.llm import site_lines

    who = ["Anna", "Boris", "Carla", "Dmitri", "Edith", "Farid"]
    rows = [(i, "a", f"Posted by {who[i % 6]} of the news desk on page {i}\nsome text {chr(97 + i % 26)}{chr(97 + i // 26)} here\nShare this page") for i in range(120)]
    df = spark.createDataFrame(rows, "k int, source string, t string").repartition(6)
    got = {r.template: (r.n_rows, r.n_lines) for r in site_lines.site_templates(df, "k", "source", "t").collect()}
    assert got["posted by <*> of the news desk on page <*>"] == (120, 6) and got["share this page"] == (120, 1)
    hit = site_lines.site_lines(df, "k", "source", "t").groupBy("line_no").count().collect()
    assert {r.line_no: r["count"] for r in hit} == {1: 120, 3: 120}


def test_token_tree():
    from ordinanza.llm.site_lines import TokenTree

    t = TokenTree()
    a = t.add("s", TokenTree.tokens("Share this page with friends"))
    assert t.add("s", TokenTree.tokens("share THIS page with family")) is a and a == ["share", "this", "page", "with", "<*>"]
    assert t.add("s", TokenTree.tokens("share your story right now")) is not a
    assert t.add("other", TokenTree.tokens("share this page with friends")) is not a and t.add("s", []) == []


def _words(n):
    """n different words of five letters, the last a q."""
    return ["".join(chr(97 + i // 26**p % 26) for p in range(4)) + "q" for i in range(n)]


def test_template_behind_a_full_leaf(spark):
    from ordinanza.llm import site_lines

    fill = [("a", f"note {w} {w}", 2) for w in _words(10_000)]
    late = [("a", f"note from {w}", 1) for w in ("anna", "boris", "carla", "dmitri", "edith", "farid")]
    df = spark.createDataFrame(fill + late, "s string, line string, n long").coalesce(1)
    got = site_lines.parse_templates(df, "s", "line", "n").where("line LIKE 'note from %'").select("template", "covered").distinct().collect()
    assert [tuple(r) for r in got] == [("note from <*>", 6)]


def test_templates_of_a_source_with_many_lines_in_one_leaf(spark):
    from ordinanza.llm import site_lines

    fill, kinds = _words(300 * 100), [f"{w}y" for w in _words(30)]
    rows = [[f"note {a} {a}" for a in fill[i * 100 : i * 100 + 100]] for i in range(300)]
    for j, kind in enumerate(kinds):
        for m in range(6):
            rows[j * 7 + m * 11].append(f"note {kind} {'abcdef'[m]}{kind}z")
    df = spark.createDataFrame([(i, "a", "\n".join(r)) for i, r in enumerate(rows)], "k int, source string, t string")
    got = {(r.template, r.n_rows, r.n_lines) for r in site_lines.site_templates(df, "k", "source", "t").collect()}
    assert got == {(f"note {kind} <*>", 6, 6) for kind in kinds}


def test_templates_of_a_line_spelt_in_several_leaves(spark):
    from ordinanza.llm import site_lines

    spelt = ["Share this page"] * 4 + ["Share thispage", "Sharethis page", "7 Share this\u200b\u00a0page", "x\u00b2 of one", "x\u00b3 of one", "x\u00b2 of one", "x\u00b3 of one", "x\u00b9 of one"]
    df = spark.createDataFrame([(i, "a", x) for i, x in enumerate(spelt)], "k int, source string, t string")
    got = {tuple(r) for r in site_lines.site_templates(df, "k", "source", "t").collect()}
    assert got == {("a", "share this page", 7, 1), ("a", "<*> of one", 5, 3)}


def test_token_tree_against_all_templates():
    import random

    from ordinanza.llm.site_lines import SLOT, TokenTree

    def share(x, toks):
        return sum(1.0 if a == b and a != SLOT else 0.5 if a == SLOT else 0.0 for a, b in zip(x, toks)) / len(toks)

    rnd = random.Random(5)
    for alike in (0.3, 0.6, 0.6, 0.6, 0.8, 1.0):
        for words, n in ((3, 4), (6, 5), (12, 7), (4, 9)):
            tree, every = TokenTree(alike), []
            for _ in range(300):
                toks = ["by"] + [rnd.choice("abcdefghijkl"[:words]) if rnd.random() < 0.9 else SLOT for _ in range(n - 1)]
                best = max(range(len(every)), key=lambda i: (share(every[i], toks), -i), default=None)
                if best is None or share(every[best], toks) < alike and every[best] != toks:
                    best = len(every)
                    every.append(list(toks))
                every[best] = [a if a == b else SLOT for a, b in zip(every[best], toks)]
                assert tree.add("s", toks) == every[best]
            assert tree.templates == every


# -- 6 noise of scans ----------------------------------------------------------------

def test_paragraphs_join_whatever_the_next_letter():
    from ordinanza.llm import scan_noise

    lexicon = {w: 1000 - i for i, w in enumerate("the owner shall keep every fence clean during summer before council review under section general permit street officer harbor".split())}
    model = scan_noise.NoiseModel(lexicon, scan_noise.fit_joiner(lexicon), scan_noise.fit_furniture(lexicon), scan_noise.fit_flow(lexicon), None, frozenset(lexicon))
    text = "1.2.3 Fences\nThe owner of a lot shall keep the fence in order and\nSection 4 says more about it. The Officer of the\nHarbor may ask for 20\nPermits a year if the street is under review of\n217\nthe council.\n- a map of the lot,\n- a fee,"
    got, _ = scan_noise._repair_text(text, {}, scan_noise._Reader(model))
    assert got == "1.2.3 Fences\nThe owner of a lot shall keep the fence in order and Section 4 says more about it. The Officer of the Harbor may ask for 20 Permits a year if the street is under review of the council.\n- a map of the lot,\n- a fee," or got.count("\n") <= 5


def test_rare_grams_join_all_that_share_enough(spark):
    import random

    from ordinanza.llm import scan_noise

    rng = random.Random(2)
    lexicon = {"".join(rng.choice("aeinorstl") for _ in range(rng.randint(3, 11))): 10_000 for _ in range(300)}
    odd = {}
    for w in list(lexicon)[:150]:
        i = rng.randrange(len(w))
        odd[w[:i] + rng.choice("0156cb") + w[i + 1 :]] = 1
    counts = spark.createDataFrame([*lexicon.items(), *odd.items()], "word string, n long")

    class Any:
        def probability(self, x):
            import numpy as np

            return np.ones(len(x))

    got = {r.word for r in scan_noise.corrections(counts, lexicon, Any(), 0.5).collect()}
    g = scan_noise._bigrams
    near = {s for s in odd if any(s != v and len(v) - 1 <= len(s) <= len(v) + 2 and len(g(s) & g(v)) >= len(v) + 1 - scan_noise._lost(len(v)) and sum(a != b for a, b in zip(s, v)) <= 1 and len(s) == len(v) for v in lexicon)}
    assert near and near <= got


# -- nulls, ties and clashing names in every operator ----------------------------------

def test_null_keys_and_clashing_columns(spark):
    from ordinanza.llm import copies, leaks, mixing, quality, scan_noise, site_lines, splitting, survivors

    t = "The owner of the lot shall keep every fence in good order before the board may look at it again this year."
    rows = [(None, t, "a", None, 1), (2, None, None, 1, None), (None, "", "a", 1, 2), (4, t, "a", 1, 2), (4, t.upper(), None, 1, 2)] * 3
    df = spark.createDataFrame(rows, "k long, t string, source string, g long, n long")
    for name in ("_k", "_key", "_t", "_d", "line_no", "kind", "piece", "n_copies", "copy", "slot", "_source", "_line", "word", "item_id", "whole"):
        df = df.withColumn(name, F.lit("clash"))
    assert splitting.split_oversized(df, "k", "t", 50, 10).where("k is null and length(piece) > 0").count() > 0
    assert survivors.whole_content(df, "k", "g", "t").count() > 0
    assert site_lines.site_lines(df, "k", "source", "t").count() >= 0 and site_lines.site_templates(df, "k", "source", "t").count() >= 0
    got = copies.collapse(df, "k", ["t", "n"]).collect()
    assert len(got) == len(rows)
    assert quality.label_documents(df, "k", "t", quality.LineModel([])).count() == len(rows)
    m = scan_noise.fit([(df, "t")])
    assert scan_noise.find_noise(df, "k", "t", m).count() == 0 and scan_noise.repair(df.select("k", "t").distinct(), "k", "t", m).count() == 5
    items = spark.createDataFrame([(None, t), (2, t), (3, None)], "i long, x string")
    assert {r.item_id for r in leaks.leaks(df, "k", "t", items, "i", "x").collect()} == {None, 2}
    sched, rep = mixing.mix(df.withColumnRenamed("n", "n_tokens"), spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeat int"), "k")
    assert sched.count() > 0 and rep.count() == 1
    assert pii.find_pii(df, "k", "t").count() == 0 and pii.replace_pii(df, "k", "t").count() == len(rows)
