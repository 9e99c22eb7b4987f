from collections import Counter

import pytest

from revel.operators import kneser_ney as KN

PAIRS = "item string, user string, prev long, next long"
TRAIN = [("a", "u", 2, 4), ("a", "u", 2, 4), ("a", "v", 2, 5), ("b", "v", 2, 5), ("b", "v", 4, 6), ("b", None, 4, 6), (None, "u", 5, 4), ("a", "u", 4, 4)]


def brute(train, row, vocab, d=0.75):
    item, user, prev, nxt = row
    p = 1 / vocab
    bigrams = {(x[2], x[3]) for x in train}
    ends = Counter(w for _, w in bigrams)
    for level in (ends, Counter(x[3] for x in train if x[2] == prev), Counter(x[3] for x in train if user and x[1] == user and x[2] == prev),
                  Counter(x[3] for x in train if item and x[0] == item and x[2] == prev)):
        if level:
            total = sum(level.values())
            p = max(level[nxt] - d, 0) / total + d * len(level) / total * p
    return p


def test_probabilities_match_brute_force_and_sum_to_one(spark):
    vocab = 9
    model = KN.fit(spark.createDataFrame(TRAIN, PAIRS), ["user", "item"], vocab)
    rows = [(i, u, v, w) for i in ("a", "b", "new", None) for u in ("u", "v", "new", None) for v in (2, 4, 7) for w in range(vocab)]
    got = KN.probability(spark.createDataFrame(rows, PAIRS), model).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for r in got:
        assert r.p == pytest.approx(brute(TRAIN, (r.item, r.user, r.prev, r.next), vocab))
        sums[r.item, r.user, r.prev] += r.p
    assert all(s == pytest.approx(1.0) for s in sums.values())


def test_conditioning_lowers_the_loss_where_items_differ(spark):
    import math

    train = [(f"i{k % 7}", f"u{k % 5}", 2, 4 + k % 7) for k in range(700)]
    model = KN.fit(spark.createDataFrame(train, PAIRS), ["user", "item"], 50)
    held = spark.createDataFrame([(f"i{k}", "u0", 2, 4 + k) for k in range(7)], PAIRS)
    assert all(-math.log(r.p) < 0.1 < math.log(7) for r in KN.probability(held, model).collect())


def test_conditioned_loss_is_below_the_bigram_models(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["expl_conditioned_loss"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.xe_conditioned < r.xe_bigram for r in rows)
