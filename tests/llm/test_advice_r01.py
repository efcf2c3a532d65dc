
from ordinanza.llm import copies, leaks, splitting, survivors


def _round_trip(text, rows, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert "".join(r.piece[r.overlap_chars :] for r in rows) == text
    for before, r in zip([None, *rows], rows):
        assert r.start_pos >= 1 and r.n_chars == len(r.piece) and r.piece == text[r.start_pos - 1 : r.start_pos - 1 + r.n_chars]
        assert r.overlap_chars == (0 if before is None else min(overlap, len(before.piece)))
        assert before is None or before.piece.endswith(r.piece[: r.overlap_chars])


def test_pieces_after_a_short_first_piece(spark):
    texts = {1: "1.2.3 Fences\n\n" + "a" * 440, 2: "1.2.3\n\n" + "b " * 222 + "\n\n" + "c " * 222, 3: "x" * 49 + "\n" + "y" * 450, 4: "word " * 400}
    df = spark.createDataFrame([*texts.items()], "k int, t string")
    got = splitting.split_oversized(df, "k", "t", 450, 50).collect()
    for k, t in texts.items():
        rows = [r for r in got if r.k == k]
        assert len(rows) > 1 and all(len(r.piece) <= 450 for r in rows)
        _round_trip(t, rows, 50)


def test_wholeness_does_not_hang_on_counts(spark):
    start = "The owner of lot {} shall keep the fence in good order after the notice"
    cut_off = [(2 * i + j, i, start.format("abc"[i]) + rest) for i in range(3) for j, rest in enumerate(("", " is given by the board."))]
    ends = [(20 + i, 20 + i, f"The board may look at the {w} of every lot once a year without the notice.") for i, w in enumerate(("fence", "hedge"))]
    text = "The council may set a fee for each permit and shall publish it in March."
    noted = [(30, 30, text), (31, 30, text + " This section was carried over.")]
    listed = [(40, 40, "Bring these:\n1. a map of the lot,\n2. a survey of the lot,"), (41, 40, "Bring these:\n1. a map of the lot,\n2. a survey of the lot,\n3. the fee for it.")]
    df = lambda rows: spark.createDataFrame(rows, "k int, g int, t string")
    whole = lambda rows: {r.k: r.whole for r in survivors.whole_content(df(rows), "k", "g", "t").collect()}
    few, many = whole(cut_off[:2] + noted), whole(cut_off + ends + noted + listed)
    assert few == {0: False, 1: True, 30: True, 31: True}
    assert {k: many[k] for k in few} == few and not many[2] and not many[4]
    assert not many[40] and many[41]


def test_paraphrase_is_found_at_any_place(spark):
    item = [f"t{i}" for i in range(72)]
    stretch = lambda at: [w if i % 5 else "other" for i, w in enumerate(item[at : at + 24])]
    docs = [(12 * a + b, " ".join([f"d{i}" for i in range(b)] + stretch(6 * a) + ["end"] * 20)) for a in range(9) for b in range(12)]
    df = spark.createDataFrame([*docs, (900, " ".join(item[:60:5]))], "d int, t string")
    it = spark.createDataFrame([(1, " ".join(item)), (2, "t1 t2 t3")], "i long, t string")
    got = leaks.leaks(df, "d", "t", it, "i", "t", paraphrase=0.6).collect()
    assert {(r.d, r.item_id) for r in got} == {(d, 1) for d, _ in docs} and all(0.7 < r.lcs_share < 0.9 for r in got)


def test_cover_against_brute_force():
    import random

    import numpy as np

    rng = random.Random(6)
    item = [rng.randrange(40) for _ in range(70)]
    items = leaks.Items([1], [" ".join(f"t{w}" for w in item)])
    weight = np.random.default_rng(1).uniform(0.1, 3, len(items.vocab))
    st, codes = leaks.Stretches(items, weight), items.codes[0].tolist()
    n_found = 0
    for _ in range(60):
        at = rng.randint(0, 46)
        doc = [w if rng.random() > 0.25 else rng.choice([-1, rng.randrange(len(weight))]) for w in codes[at : at + 24]] + [rng.randrange(len(weight)) for _ in range(20)]
        got = dict(st.cover(np.array(doc), np.arange(len(items.passages)), 0.6))
        for c, place in enumerate(items.place):
            target, want = codes[max(0, place - 12) : place + 36], 0.0
            for x in range(len(target) - 23):
                s = target[x : x + 24]
                u = sorted(set(s), key=lambda k: (-weight[k], k))
                key = u[: -(-len(u) // 3)]
                share = leaks.common_subsequence([d for d in doc if d >= 0], s) / 24
                assert abs(leaks.common_share([d for d in doc if d >= 0], s) - share) < 1e-9
                if share >= 0.6 and leaks.weighted_cover(doc, s, weight) >= 0.6 and sum(k in doc for k in key) >= 0.6 * len(key):
                    want = max(want, share)
            assert abs(got.get(c, 0.0) - want) < 1e-9
            n_found += want > 0
    assert n_found > 20


def test_signs_between_numbers_separate_like_a_space():
    assert [copies.canonical(t) for t in ("rooms 5, 6", "rooms 5 6", "rooms 5 -- 6", "rooms 5.6")] == ["rooms 5 6"] * 3 + ["rooms 5.6"]
    assert copies.forms("\u200bFee:\u00a03 | Zone \u2013 a", True) == ["fee 3", "zone a"] and copies.canonical("Ca\u00adfé  №3") == "café 3"
