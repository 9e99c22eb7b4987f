"""Hand-worked BLEU / ROUGE cases (FIXTURES.md section 4)."""

import math
import sys

import pytest

from revel.functions.metrics import _lcs_one
from revel.operators import metrics as M

# reference, generated, bleu1, bleu4, rouge1 (p,r,f), rouge2 (p,r,f), rougeL (p,r,f)
CASES = [
    ("the room was clean", "the room was clean", 100, 100, (100, 100, 100), (100, 100, 100), (100, 100, 100)),
    ("the room was clean and quiet", "the room was dirty", 45.489799, 26.169874, (75, 50, 60),
     (66.666667, 40, 50), (75, 50, 60)),
    ("clean room", "clean", 36.787944, 36.787944, (100, 50, 66.666666), (0, 0, 0), (100, 50, 66.666666)),
    ("good food", "bad service", 0, 0, (0, 0, 0), (0, 0, 0), (0, 0, 0)),
    ("the cat", "the the the the", 25, 6.103322, (100, 50, 66.666666), (0, 0, 0), (25, 50, 33.333333)),
    ("the cat", "the the cat", 66.666667, 21.177974, (100, 100, 100), (50, 100, 66.666666), (66.666667, 100, 80)),
    ("clean. quiet.", "quiet. clean.", 100, 8.032424, (100, 100, 100), (0, 0, 0), (50, 50, 50)),
    ("the cat sat on mat", "cat the sat mat", 77.880078, 6.722142, (100, 80, 88.888888), (0, 0, 0), (75, 60, 66.666666)),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, r, g) for i, (r, g, *_rest) in enumerate(CASES)]
    rows.append((len(CASES), "any", "..."))
    df = spark.createDataFrame(rows, "pair_id long, reference string, generated string")
    return {r.pair_id: r for r in M.pair_scores(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_hand_worked(scored, i):
    _, _, b1, b4, r1, r2, rl = CASES[i]
    row = scored[i]
    assert row.bleu1 == pytest.approx(b1, abs=1e-4)
    assert row.bleu4 == pytest.approx(b4, abs=1e-4)
    for key, (p, r, f) in (("rouge_1", r1), ("rouge_2", r2), ("rouge_l", rl)):
        assert getattr(row, f"{key}_p") == pytest.approx(p, abs=1e-4)
        assert getattr(row, f"{key}_r") == pytest.approx(r, abs=1e-4)
        assert getattr(row, f"{key}_f") == pytest.approx(f, abs=1e-4)


def test_dots_only_not_scorable(scored):
    row = scored[len(CASES)]
    assert row.bleu1 == 0 and row.bleu4 == 0
    assert row.scorable is False and row.rouge_1_f is None


def test_report_counts(spark, scored):
    rows = [(i, r, g) for i, (r, g, *_rest) in enumerate(CASES)] + [(99, "any", "...")]
    df = spark.createDataFrame(rows, "pair_id long, reference string, generated string")
    rep = M.text_report(M.pair_scores(df)).collect()[0]
    assert rep.n_pairs == 9 and rep.n_scorable == 8
    # ROUGE averages use the scorable pairs only
    assert rep.rouge_1_p == pytest.approx(sum(c[4][0] for c in CASES) / 8, abs=1e-4)
    assert rep.bleu1 == pytest.approx(sum(c[2] for c in CASES) / 9, abs=1e-4)


def test_safe_average_empty(spark):
    df = spark.createDataFrame([], "pair_id long, reference string, generated string")
    rep = M.text_report(M.pair_scores(df)).collect()[0]
    assert rep.n_pairs == 0 and rep.bleu1 == 0.0 and rep.rouge_l_f == 0.0


def _lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_bit_parallel_lcs_matches_dp():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70))
    def check(a, b):
        assert _lcs_one(a, b) == _lcs_dp(a, b)

    check()


def test_bleu_unsmoothed_zero_terms(spark):
    df = spark.createDataFrame([(0, "the cat", "the the cat")], "pair_id long, reference string, generated string")
    row = M.bleu_scores(df, orders=(4,), smooth=False).collect()[0]
    # unsmoothed: p3 = p4 = 0 are replaced by the smallest double
    tiny = math.log(sys.float_info.min)
    expected = 100 * math.exp((math.log(2 / 3) + math.log(1 / 2) + 2 * tiny) / 4)
    assert row.bleu4 == pytest.approx(expected, abs=1e-6)


def test_clipped_counts_match_counter_on_long_texts(spark):
    """Multiset overlap (run-length tagging) equals sum_g min(count_h, count_r)."""
    import random
    from collections import Counter

    from revel.functions.metrics import bleu_count_stages

    rnd = random.Random(5)
    rows = []
    for i in range(40):
        h = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 400))]
        r = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 400))]
        rows.append((i, h, r))
    df = spark.createDataFrame(rows, "k int, hw array<string>, rw array<string>")
    for stage in bleu_count_stages("hw", "rw", 4):
        df = df.select("*", *[c.alias(n) for n, c in stage.items()])
    got = {r.k: [r[f"_num{n}"] for n in range(1, 5)] for r in df.collect()}
    for k, h, r in rows:
        want = []
        for n in range(1, 5):
            ch = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            cr = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            want.append(sum(min(c, cr[g]) for g, c in ch.items()))
        assert got[k] == want


def test_rouge_l_summary_mode_paper_example(spark):
    """ROUGE paper example: r = w1..w5, c1 = w1 w2 w6 w7 w8, c2 = w1 w3 w8 w9 w5
    -> union LCS = {w1, w2, w3, w5} = 4 words; R = 4/5, P = 4/10."""
    df = spark.createDataFrame([(0, "w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8. w1 w3 w8 w9 w5")],
                               "pair_id long, reference string, generated string")
    row = M.rouge_scores(df, rouge_l_mode="summary").first()
    assert row.rouge_l_r == pytest.approx(80.0) and row.rouge_l_p == pytest.approx(40.0)
    # single sentences: summary mode equals length mode
    one = spark.createDataFrame([(0, "the cat sat on mat", "cat the sat mat")], "pair_id long, reference string, generated string")
    a = M.rouge_scores(one, rouge_l_mode="summary").first()
    b = M.rouge_scores(one).first()
    assert (a.rouge_l_p, a.rouge_l_r) == pytest.approx((b.rouge_l_p, b.rouge_l_r))


def _walk_back(x, y):
    """The scoring package's rule on a whole table: a match, else up if greater, else left."""
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a == b else max(t[i - 1][j], t[i][j - 1])
    i, j, out = len(x), len(y), set()
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.add(x[i - 1])
            i, j = i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_lcs_word_sets_follow_the_walk_back():
    import random

    from revel.functions import metrics as FM

    r = random.Random(3)
    for k in range(600):
        a, b = ([r.choice("abcde"[:2 + k % 4]) for _ in range(r.randint(0, 14))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | (1 << i)
        assert FM._lcs_words(a, masks, b) == _walk_back(a, b), (a, b)
    refs, hyps = [["a b c a", "d e"], ["b a", "e d x", ""]]
    assert FM._set_lcs_one(refs, hyps) == len(set().union(*(_walk_back(x.split(" "), y.split(" ")) for x in refs for y in hyps)))


def test_rouge_l_set_hand_worked(spark):
    rows = [
        # one sentence each: LCS "the cat on mat", words of 5 and of 6 distinct
        ("the cat sat on the mat", "the big cat on a mat", 4, 6, 5),
        # a repeated word counts once: LCS "a a b" is the set {a, b}
        ("a a b", "a a b b", 2, 2, 2),
        # sentences pair up in any order; both orders of "x y" share one word with "y x"
        ("x y. p q", "p q. y x", 3, 4, 4),
        ("one two", "three four", 0, 2, 2),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "k int, reference string, generated string, common int, nh int, nr int")
    for row in M.rouge_scores(df).collect():
        p, r = row.common / row.nh, row.common / row.nr
        assert (row.rouge_l_set_p, row.rouge_l_set_r) == pytest.approx((100 * p, 100 * r))
        assert row.rouge_l_set_f == pytest.approx(200 * p * r / (p + r + 1e-8))
    empty = spark.createDataFrame([("...", "a"), ("a", "")], "reference string, generated string")
    assert all(row.rouge_l_set_f is None and not row.scorable for row in M.rouge_scores(empty).collect())
