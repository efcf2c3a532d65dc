"""Small fixtures, brute force and edge cases for the training-data operators."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinanza.llm import boosting, charcrf, copies, leaks, mixing, pii, quality, scan_noise, site_lines, splitting, survivors

LONG = "word " * 40_000


# -- 1 splitting -----------------------------------------------------------------

def _random_text(rng):
    return "".join(rng.choice(["word ", "x" * 37, "\n", "\n\n", "  ", "A sentence ends here. ", "é ", "! "]) for _ in range(rng.randint(0, 90)))


def test_split_round_trip_limit_and_overlap():
    rng = random.Random(2)
    for t in [_random_text(rng) for _ in range(150)] + ["", " ", "y" * 1234, LONG, " " * 900]:
        spans, _ = splitting.split_spans(t, 100, 20)
        assert "".join(t[a:b] for a, b, _ in spans) == t
        assert all(b - a <= (100 if len(spans) == 1 else 80) for a, b, _ in spans)


def test_split_merges_weakest_first():
    t = "a" * 30 + ". " + "b" * 30 + "\n\n" + "c" * 30 + ". " + "d" * 30
    assert [t[a:b].strip() for a, b, _ in splitting.split_spans(t, 80, 10)[0]] == [t[:62].strip(), t[64:].strip()]


@pytest.mark.parametrize("t,level", [("a" * 9 + "\n \n" + "b" * 9, 4), ("a" * 9 + "\n" + "b" * 9, 3), ("a" * 8 + ". " + "b" * 9, 2), ("a" * 9 + " " + "b" * 9, 1), ("a" * 11, 0)])
def test_cut_level(t, level):
    assert splitting.split_spans(t, 10, 1)[1] == splitting.split_spans(t, 10, 5)[1] == level


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a " * 300, "x"), (1, "short", "y"), (2, None, None), (3, "", "z")], "k int, piece string, piece_no string")
    got = splitting.split_oversized(df.select("k", F.col("piece").alias("t"), "piece_no"), "k", "t").collect()
    assert sum(r.oversized for r in got) == 2 and {r.k for r in got} == {1, 3}
    assert splitting.split_oversized(df.where("k = 9"), "k", "piece").count() == 0


# -- 2 survivors -------------------------------------------------------------------

def test_survivors(spark):
    whole = "1.2.3 Fences\nThe owner shall keep a fence in order and the board may look at it every year."
    rows = [
        (1, 1, "1.2.3", whole, 1, 10), (2, 1, "§ 1.2.3", whole[:60], 5, 20), (3, 1, "n/a", whole.upper(), 2, 30), (4, 1, None, None, 5, 40), (5, 1, "1.2", "tbd", 5, 50),
        (6, 2, "9.9.9", whole, None, None), (7, None, "1.1.1", whole, 1, 1), (8, 3, None, None, 1, 1), (9, 3, "x", "", 1, 2),
    ]
    df = spark.createDataFrame(rows, "ordinal int, provision_id int, section string, content string, trust int, t int")
    w = survivors.whole_content(df, "ordinal", "provision_id", "content")
    ok = {r.ordinal: r.whole for r in w.collect()}
    assert ok[1] and ok[3] and not ok[2] and 4 not in ok and not ok[5]
    x = df.join(w.select("ordinal", "whole"), "ordinal", "left").withColumn("whole", F.coalesce("whole", F.lit(False))).withColumn("sok", survivors.section_ok(F.col("section")))
    got = {(r.provision_id, r.field_name): r.ordinal for r in survivors.survivors(x, "ordinal", "provision_id", {"section": "sok", "content": "whole"}, "trust", "t").collect()}
    assert got == {(1, "section"): 2, (1, "content"): 3}
    assert survivors.whole_content(df.where("ordinal > 90"), "ordinal", "provision_id", "content").count() == 0


def test_next_in_group_over_partitions(spark):
    rng = random.Random(1)
    vals = sorted({(rng.randint(0, 3), f"{rng.randint(0, 400):03d}") for _ in range(300)})
    df = spark.createDataFrame(vals, "g int, v string").repartition(7)
    got = {(r.g, r.v): r.n for r in survivors.next_in_group(df, "g", "v", "n").collect()}
    assert got == {x: (y[1] if y[0] == x[0] else None) for x, y in zip(vals, vals[1:] + [(None, None)])}


# -- 3 lines of a site -----------------------------------------------------------

def test_site_lines_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        site = [rng.choice(["Share this page:  12", "share THIS page: 7", "By staff, 3.2001", "rare line"]) for _ in range(rng.randint(0, 2))]
        lines = [f"text {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(3)] + site + ["12 34", ""]
        rng.shuffle(lines)
        rows.append((i, rng.choice(["a", "b", None]), "\n".join(lines) if i % 17 else None, "clash"))
    df = spark.createDataFrame(rows, "k int, source string, t string, line_no string")
    key = lambda x: re.sub(r"[\s\d]+", "", x.lower())
    n, seen = Counter(), defaultdict(set)
    for k, s, t, _ in rows:
        if s and t is not None:
            n[s] += 1
            for x in t.split("\n"):
                if re.search(r"[^\W\d_]", x):
                    seen[s, key(x)].add(k)
    bad = {x for x, ks in seen.items() if len(ks) >= max(5, 0.02 * n[x[0]])}
    want = sorted((k, i) for k, s, t, _ in rows if s and t is not None for i, x in enumerate(t.split("\n"), 1) if (s, key(x)) in bad)
    got = sorted((r.k, r.line_no) for r in site_lines.site_lines(df, "k", "source", "t").collect())
    assert got == want and want
    clean = {r.k: r for r in site_lines.remove_site_lines(df.drop("line_no"), "k", "source", "t").collect()}
    assert len(clean) == len(rows) and sum(r.n_lines_removed for r in clean.values()) == len(want)
    assert site_lines.site_lines(df.where("k < 0"), "k", "source", "t").count() == 0
    assert any("<*>" in r.template for r in site_lines.site_templates(df, "k", "source", "t").collect())


# -- 4 copies ------------------------------------------------------------------

def test_copies(spark):
    rows = [
        (1, "1.2.3", "The Fence, 3.5 feet — high!"), (2, "§1.2.3", "the  fence 3.5 feet\nhigh"), (3, None, "the fence 3.5 feet high"), (4, None, "The fence 3.5​ feet high"),
        (5, "1.2.3", "the fence 35 feet high"), (6, "x", "Key: one\nOther key: 2"), (7, "X", "other key = 2 | key = one"), (8, "x", None), (9, "x", None), (10, "x", ""), (11, "1.2.3", "high fence the 3.5 feet"), (11, "1.2.3", "HIGH fence the 3.5 feet"),
    ]
    df = spark.createDataFrame(rows, "id int, section string, content string").withColumn("n_copies", F.lit("clash"))
    got = defaultdict(list)
    for r in copies.collapse(df, "id", ["section", "content"], free_order=["content"]).collect():
        got[r.first_key].append((r.copy_key, r.n_copies))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 2), (2, 2)], 3: [(3, 2), (4, 2)], 5: [(5, 1)], 6: [(6, 2), (7, 2)], 8: [(8, 2), (9, 2)], 10: [(10, 1)], 11: [(11, 2), (11, 2)]}
    assert copies.collapse(df.where("id < 0"), "id", ["section", "content"]).count() == 0


# -- 5 quality -------------------------------------------------------------------

SAMPLES = {
    "list": "1.2.3 Fences\nSubmit all of these:\n- a fee of $3,\n- a map,\n- two copies,\n- a survey of the lot,",
    "table": "1.2.3 Fences\nZone | Use | Fee\nwood | R-4 | 26%\nbrick | $4,346 | yes\nglass | no | no",
    "junk": "kZvvQx9Rt2LmPqW7zzKxTbv4nGfDsRj3\nQw8ErTyUiOpZxCvBnM12qwErTy99\nPPqLxZzkTrW31mmNvBq",
    "prose": "1.2.3 Fences\nThe owner of a lot shall keep the fence in good order, and the board may inspect it once in every year.",
}


def _labelled():
    """A few labelled texts of every kind, other than the samples."""
    import random

    rng = random.Random(3)
    w = "the owner of a lot shall keep every fence and gate in good order before the board may inspect it".split()
    line = lambda n: " ".join(rng.choice(w) for _ in range(n))
    out = []
    for i in range(40):
        out.append(("prose", " ".join(rng.choice(["word", "street", "harbor", "permit"]) for _ in range(20))))
        out.append(("prose", "\n".join([f"1.2.{i} Title"] + [line(12) + "." for _ in range(rng.randint(1, 4))])))
        out.append(("list", "\n".join([f"1.2.{i} Title", line(4) + ":"] + [f"{rng.choice(['-', '1.', 'a)'])} {line(3)}," for _ in range(4)])))
        out.append(("list", "; ".join(f"{rng.choice(['Zone', 'Fee', 'Use'])}: {rng.choice(w)}" for _ in range(3))))
        out.append(("table", "\n".join([f"1.2.{i} Title"] + [f"{rng.choice(w)} | {rng.choice(['R-4', '$31', 'no'])} | {rng.randint(1, 99)}%" for _ in range(4)])))
        out.append(("junk", "\n".join("".join(rng.choice("kZvxQ9Rt2LmPqW7z") for _ in range(30)) for _ in range(3))))
    return out


def test_line_model(spark):
    model = quality.LineModel([(k, [quality.observe(x) for x in quality.units(t)]) for k, t in _labelled()])
    df = spark.createDataFrame([*SAMPLES.items(), ("null", None), ("empty", ""), ("fields", "Key: a; Zone: b; Fee: $3"), ("long", LONG)], "k string, t string")
    got = {r.k: r for r in quality.label_documents(df, "k", "t", model).collect()}
    assert {k: got[k].kind for k in SAMPLES} == {k: k for k in SAMPLES}
    assert got["null"].kind == got["empty"].kind == got["long"].kind == "prose" and got["fields"].kind == "list"
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(_labelled())], "i int, kind string, t string")
    assert quality.fit_lines(rows, "i", "t", rows.select("i", "kind")).decode([quality.observe("- a fee of $3,")]) == [1]
    assert quality.label_documents(df.where("k = '?'"), "k", "t", model).count() == 0
    none = quality.label_documents(df, "k", "t", quality.LineModel([]))
    assert {r.kind for r in none.collect()} == {"prose"}


# -- 6 noise of scans ----------------------------------------------------------------

def test_scan_noise(spark):
    rng = random.Random(9)
    vocab = "the owner shall keep every fence clean during summer before council review under section general permit street officer harbor district self-latching gate notice".split()
    clean = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(400)]
    noisy = "the owner shall keep a fen-\n    217\nce clean under gcneral notice of the self-\nlatching gate\nCHAPTER 8.04 N O I S E   C O N T R O L\nbefore council review"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean)] + [(1000, noisy), (1001, None), (1002, "")], "k int, t string").withColumn("word", F.lit("clash"))
    m = scan_noise.fit([(df, "t")])
    got = sorted((r.line_no, r.kind) for r in scan_noise.find_noise(df, "k", "t", m).collect() if r.k == 1000)
    assert got == [(1, "break"), (2, "furniture"), (3, "glyph"), (5, "furniture")]
    fixed = {r.k: r.t for r in scan_noise.repair(df, "k", "t", m).collect()}
    assert fixed[1000] == "the owner shall keep a fence clean under general notice of the self-latching gate before council review"
    assert fixed[1001] is None and fixed[1002] == "" and all(fixed[i] == t for i, t in enumerate(clean))
    none = df.where("k < 0")
    assert scan_noise.find_noise(none, "k", "t", scan_noise.fit([(none, "t")])).count() == 0


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    p = boosting.Boosted(trees=80).fit(x[:1500], y[:1500]).probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.9


def test_long_tokens_are_read_in_linear_time():
    t = "x" * 200_000 + "-\ny " + "a-" * 50_000
    assert list(scan_noise.broken_pairs(t)) == [("x" * 200_000, "y")] and scan_noise.split_end(t.split("\n")[0])[2] == "-"


# -- 7 leaks ---------------------------------------------------------------------

def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(20)]
    docs = []
    for _ in range(150):
        d = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        it = items[rng.randrange(20)].split()
        k = rng.randint(8, 16)
        at = rng.randint(0, max(0, len(it) - k))
        docs.append(" ".join(d[:30] + [w.upper() for w in it[at : at + k]] + d[30:]))
    docs += ["", items[0], items[0]]
    df = spark.createDataFrame([*enumerate(docs), (900, None)], "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([*enumerate(items), (77, None)], "item_id long, item_text string")
    rows = leaks.leaks(df, "doc_id", "text", it, "item_id", "item_text", rank=32).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    runs = {tuple(t.split()[i : i + 12]): n for n, t in enumerate(items) for i in range(len(t.split()) - 11)}
    want = {(n, runs[r]) for n, d in enumerate(docs) for ws in [leaks.words(d)] for i in range(len(ws) - 11) if (r := tuple(ws[i : i + 12])) in runs}
    assert got == want and want
    texts = {n: leaks.words(t) for n, t in enumerate(docs)}
    for r in rows:
        d, i = texts[r.doc_id], items[r.item_id].split()
        assert r.run_words == max(n for n in range(12, 61) if any(d[a : a + n] == i[b : b + n] for a in range(len(d) - n + 1) for b in range(len(i) - n + 1)))
    assert leaks.leaks(df, "doc_id", "text", it.where("item_id < 0"), "item_id", "item_text").count() == 0


def test_paraphrase_needs_a_long_subsequence(spark):
    item = " ".join(f"t{i}" for i in range(24))
    near = " ".join(f"t{i}" if i % 5 else "other" for i in range(24))
    df = spark.createDataFrame([(1, near), (2, " ".join(f"t{i}" for i in (3, 1, 2)))], "d int, t string")
    it = spark.createDataFrame([(1, item)], "i long, t string")
    got = leaks.leaks(df, "d", "t", it, "i", "t", paraphrase=0.6).collect()
    assert [(r.d, r.run_words) for r in got] == [(1, 0)] and got[0].lcs_share > 0.7


# -- 8 mixing ----------------------------------------------------------------------

def test_pfair_stays_within_one_block():
    w = [0.5, 0.3, 0.15, 0.05]
    done = [0] * 4
    for slot, (i, j) in enumerate(mixing.pfair(w, 2000), 1):
        assert j == done[i]
        done[i] += 1
        assert all(abs(done[s] - w[s] * slot) < 1 for s in range(4))


def test_mix(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 10)] * 900 + [("b", 10)] * 100 + [("c", 5)] * 10 + [(None, 3), ("a", 0), ("a", None)])]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    tg = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("gone", 0.1, 2)], "source string, weight double, max_repeat int")
    sched, rep = mixing.mix(sizes, tg, "doc_id")
    r = {x.source: x for x in rep.collect()}
    assert abs(r["a"].share - 2 / 3) < 0.01 and abs(r["b"].share - 1 / 3) < 0.01 and r["gone"].tokens == 0
    use = Counter(x.doc_id for x in sched.collect() if x.source == "b")
    assert max(use.values()) <= 3 and r["b"].max_used == 3
    assert set(r) == {"a", "b", "c", "gone"} and r["c"].tokens == 0 and r["c"].weight == 0 and {x.block_tokens for x in r.values()} == {10}
    sched, rep = mixing.mix(sizes.where("doc_id < 0"), tg, "doc_id")
    assert sched.count() == 0 and rep.count() == 3


@pytest.mark.parametrize("period", [100_000, 20])
def test_mix_deviates_by_less_than_one_block_and_half_a_record(spark, period):
    rng = random.Random(8)
    rows = [(i, rng.choice("aabcd"), rng.randint(1, 60)) for i in range(3000)]
    tg = spark.createDataFrame([("a", 0.45, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("d", 0.05, 5)], "source string, weight double, max_repeat int")
    sched, rep = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), tg, "doc_id", period=period)
    goal = {x.source: x.reachable_weight for x in rep.collect()}
    got, total, worst = Counter(), 0, 0.0
    for x in sorted(sched.collect(), key=lambda x: (x.slot, x.source_offset)):
        got[x.source] += x.n_tokens
        total += x.n_tokens
        worst = max(worst, *(abs(got[s] - goal[s] * total) for s in goal))
    assert worst < 1.5 * 60 and all(abs(got[s] / total - goal[s]) < 0.002 for s in goal)


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(1, 9)) for i in range(500)]
    got = {r.i: r.at for r in mixing.running_total(spark.createDataFrame(rows, "i int, g string, n int").repartition(9), "g", ["i"], "n", "at").collect()}
    acc = Counter()
    for i, g, n in rows:
        assert got[i] == acc[g]
        acc[g] += n


def test_count_tokens(spark):
    pytest.importorskip("tokenizers")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "k int, t string")
    n = {r.k: r.n_tokens for r in mixing.count_tokens(df, "k", "t").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1


# -- 9 personal information ----------------------------------------------------------

def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = charcrf.init(4, 3, rng)
    ids = rng.integers(1, 60, (7, 3)).astype(np.int16)
    ids[5:, 1] = 0
    gold = np.zeros((7, 3), np.int64)
    gold[2, 0], gold[3, 0] = 1, 2
    mask = (ids > 0).astype(np.float32)
    _, g = charcrf.loss_and_grads(p, ids, gold, mask)
    for k, at in (("Wo", (2, 3)), ("A", (0, 1)), ("bo", (1,)), ("Whf", (1, 13)), ("Wxb", (0, 2))):
        e = np.zeros_like(p[k])
        e[at] = 1e-2
        up, down = (charcrf.loss_and_grads(p | {k: p[k] + s * e}, ids, gold, mask)[0] for s in (1, -1))
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


def test_viterbi_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    s = rng.normal(size=(3, 2, len(charcrf.TAGS))).astype(np.float32)
    t = charcrf.allowed_transitions()
    got = charcrf.viterbi(s, t)
    for b in range(2):
        def score(path):
            return sum(s[i, b, x] for i, x in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])) - 1e4 * (path[0] > 0 and path[0] % 2 == 0)
        assert tuple(got[:, b]) == max(itertools.product(range(len(charcrf.TAGS)), repeat=3), key=score)


def test_find_and_replace(spark):
    t = "Applicant: Rev. Anneke Zonulka; phone 728 555 0118; mail azonulka@example.com. The parcel stands at 3361 Cinder Hill Road. SSN 938-17-5141 on the form is to be struck."
    pad = "The board met. " * 400
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, pad + t), (4, "See Section 12.04.150 and Ordinance 1993-041.")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = sorted((r.doc_id, r.start_pos, r.kind) for r in pii.find_pii(df, "doc_id", "text").collect())
    want = sorted((t.index(x) + 1, k) for x, k in (("Anneke", "name"), ("728", "phone"), ("azonulka", "email"), ("3361", "address"), ("938", "id")))
    assert got == [(1, *w) for w in want] + [(4, p + len(pad), k) for p, k in want]
    red = {r.text for r in pii.replace_pii(df, "doc_id", "text").where("doc_id = 1").collect()}
    assert red == {"Applicant: Rev. [NAME]; phone [PHONE]; mail [EMAIL]. The parcel stands at [ADDRESS]. SSN [ID] on the form is to be struck."}
    assert pii.find_pii(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_windows_cover_every_character():
    n = [0, 1, 255, 256, 257, 1000]
    doc, start = pii._windows([np.ones(k, np.int16) for k in n])
    for i, k in enumerate(n):
        seen = {c for d, s in zip(doc, start) if d == i for c in range(s, min(k, s + pii.WINDOW))}
        assert len(seen) == k
