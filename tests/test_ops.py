"""Index, split, runs, vectors, tokens and sampling: hand-worked cases and properties."""

import math

import pytest
from pyspark.sql import functions as F

from revel.operators import explain as EX
from revel.operators import index as X
from revel.operators import runs as RU
from revel.operators import tokens as TK
from revel.operators import vectors as V


@pytest.mark.parametrize("n,train,val,test", [(10, 8, 1, 1), (11, 8, 1, 2), (99, 79, 10, 10), (100, 80, 10, 10),
                                              (101, 80, 10, 11)])
def test_split_sizes(n, train, val, test):
    assert X.split_sizes(n) == (train, val, test)


def test_exact_split_counts_disjoint_cover(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    s = X.exact_split(df, "k", 1702)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 80, "val": 10, "test": 11}
    assert s.select("k").distinct().count() == 101


@pytest.mark.parametrize("parts", [1, 17])
def test_dense_index_bijection_and_partition_invariance(spark, parts):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(parts)
    idx = X.dense_index(df, ["k"], "i")
    rows = idx.collect()
    assert sorted(r.i for r in rows) == list(range(5000))
    assert all(r.i == r.k for r in rows)  # k is a permutation of 0..4999, so rank == value


def test_dense_index_plan_has_no_single_partition_exchange(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    plan = X.dense_index(df, ["k"], "i")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_first_seen_index(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "pos long, user string")
    out = {r.user: r.user_idx for r in X.first_seen_index(df, "user", "pos").collect()}
    assert out == {"b": 0, "a": 1, "c": 2}


def test_early_stop_hand_worked(spark):
    vals = [5, 4, 4, 4.5, 4.1, 3]
    df = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(vals)], "run string, epoch long, val_loss double")
    tracked = RU.track(df, patience=3)
    epochs = sorted(r.epoch for r in tracked.collect())
    assert epochs == [1, 2, 3, 4, 5]          # epoch 6 is never run
    best = RU.best_epoch(tracked).first()
    assert best.best_epoch == 2 and best.epochs_seen == 5
    flags = {r.epoch: (r.is_best, r.counter) for r in RU.patience_counter(RU.best_so_far(df)).collect()}
    assert flags[3] == (False, 1)             # an equal loss is no improvement
    assert flags[5] == (False, 3)


def test_epoch_means(spark):
    df = spark.createDataFrame([("r", 0, 1.0), ("r", 0, 1.0), ("r", 1, 4.0)], "run string, batch long, loss double")
    r = RU.epoch_means(df, ["run"], "batch", "loss").first()
    assert r.mean_of_batch_means == pytest.approx(2.5) and r.row_weighted_mean == pytest.approx(2.0)


def test_contrastive_loss_equal_rows_is_ln2(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.1, 0.2])] * 4, "v array<double>, a array<double>")
    s = df.select(V.cosine("v", "a").alias("p")).select(V.contrastive_term("p", "p", 0.1).alias("l"))
    assert s.agg(F.avg("l")).first()[0] == pytest.approx(math.log(2), abs=1e-12)


def test_cosine_bounds_and_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [2.0, 4.0])],
                               "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine("a", "b").alias("c")).collect()]
    assert got[0] == pytest.approx(-1.0) and got[1] == 0.0 and got[2] == pytest.approx(1.0)


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 300.0), ("h", -5.0)], "g string, s double")
    p = EX.softmax(df, ["g"], "s")
    sums = {r.g: r["sum(prob)"] for r in p.groupBy("g").sum("prob").collect()}
    assert sums["g"] == pytest.approx(1.0) and sums["h"] == pytest.approx(1.0)


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(1, "the room was clean"), (2, "clean room , quiet"), (3, None)],
                               "k int, text string")
    vocab = TK.build_vocab(df, ["text"], 64)
    enc = TK.encode(df, "k", "text", vocab, 12)
    dec = {r.k: r.text for r in TK.decode(enc.select("k", "ids"), "k", "ids", vocab).collect()}
    assert dec == {1: "the room was clean", 2: "clean room , quiet", 3: ""}
    ids = {r.k: r.ids for r in enc.collect()}
    assert all(len(v) == 12 for v in ids.values())
    assert ids[3][:3] == [TK.START, TK.END, TK.PAD]


def test_encode_truncates_and_marks_unknown(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "zzz")], "k int, text string")
    vocab = spark.createDataFrame([("a", 9, 4), ("b", 8, 5)], "token string, cnt long, id long")
    ids = {r.k: r.ids for r in TK.encode(df, "k", "text", vocab, 5).collect()}
    assert ids[1] == [TK.START, 4, 5, TK.UNK, TK.END]
    assert ids[2] == [TK.START, TK.UNK, TK.END, TK.PAD, TK.PAD]
    clamped = spark.createDataFrame([([0, 3, 7, 99],)], "ids array<long>").select(TK.clamp("ids", 5).alias("c")).first()
    assert clamped.c == [0, 3, 4, 4]


def test_sampler_matches_counts_and_generation_invariants(spark):
    pairs = spark.createDataFrame([(2, 4)] * 3 + [(2, 5)] + [(4, 3)] + [(5, 3)], "prev long, next long")
    model = EX.ngram_model(pairs)
    cdf = EX.cdf_table(model, buckets=8)
    f = spark.range(0, 4000).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("prev"))
    drawn = EX.sample_next(f, cdf, X.hash_draw(7, F.col("k")), "prev", "next", buckets=8)
    counts = {r.next: r["count"] for r in drawn.groupBy("next").count().collect()}
    assert sum(counts.values()) == 4000                 # exactly one draw per row
    assert counts[4] / 4000 == pytest.approx(0.75, abs=0.03)
    seqs = EX.generate(f.select("k").limit(200), "k", cdf, max_len=6, seed=3, buckets=8).collect()
    for r in seqs:
        assert r.seq[0] == TK.START and r.seq[-1] == TK.END and len(r.seq) == 3


def test_generation_length_rule_without_end_token(spark):
    # a cycle 4 -> 5 -> 4 ... never reaches END: the per-row length rule stops it
    pairs = spark.createDataFrame([(2, 4), (4, 5), (5, 4)], "prev long, next long")
    cdf = EX.cdf_table(EX.ngram_model(pairs), buckets=4)
    start = spark.createDataFrame([(1, 2), (2, 5), (3, None)], "k long, target_len long")
    rows = {r.k: r.seq for r in EX.generate(start, "k", cdf, max_len=6, seed=1, buckets=4,
                                             length_col="target_len", stop_at_end=False).collect()}
    assert rows[1] == [TK.START, 4, 5] and rows[2] == [TK.START, 4, 5, 4, 5, 4] and len(rows[3]) == 7


def test_embed_batches_hook(spark):
    df = spark.createDataFrame([(1, "clean room"), (2, None)], "k int, text string")
    rows = {r.k: r.vec for r in V.embed_batches(df, "text", lambda texts: [[float(len(t))] * 8 for t in texts], 8).collect()}
    assert rows == {1: [10.0] * 8, 2: [0.0] * 8}


def test_hashed_text_counts_md5_buckets(spark):
    import hashlib

    df = spark.createDataFrame([(1, "clean Room clean"), (2, None), (3, "")], "k int, text string")
    rows = {r.k: r.vec for r in df.select("k", V.hashed_text("text", 8).alias("vec")).collect()}
    want = [0.0] * 8
    for w in ("clean", "room", "clean"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
    n = sum(x * x for x in want) ** 0.5
    assert rows[1] == pytest.approx([x / n for x in want]) and rows[2] == rows[3] == [0.0] * 8


def test_norm_is_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    out = V.l2_normalize(df, "v", "u")
    assert out.first().u == [0.6, 0.8]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_dense_index_within_groups(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("b", 7), ("a", 2)], "g string, v long")
    out = sorted((r.g, r.v, r.i) for r in X.dense_index_within(df, ["g"], ["v"], "i").collect())
    assert out == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 0), ("b", 7, 1)]


def test_fraction_split_and_sample_are_seeded(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in X.fraction_split(df, "k", 11).collect()}
    b = {r.k: r.split for r in X.fraction_split(df.repartition(7), "k", 11).collect()}
    assert a == b
    frac = sum(v == "train" for v in a.values()) / len(a)
    assert abs(frac - 0.8) < 0.02
    n = X.sample_fraction(df, "k", 0.1, seed=3).count()
    assert abs(n / 20000 - 0.1) < 0.01


def test_batches_cover_with_short_last(spark):
    df = spark.range(0, 130).withColumnRenamed("id", "k")
    s = X.assign_batches(X.shuffle_order(df, "k", 5), "shuffle_idx", 64)
    sizes = sorted((r.batch_id, r["count"]) for r in s.groupBy("batch_id").count().collect())
    assert sizes == [(0, 64), (1, 64), (2, 2)]


def test_greedy_next_ties_to_smallest(spark):
    pairs = spark.createDataFrame([(2, 9), (2, 5), (2, 9), (2, 5), (4, 3)], "prev long, next long")
    g = {r.prev: r.next for r in EX.greedy_next(EX.ngram_model(pairs)).collect()}
    assert g == {2: 5, 4: 3}


def test_permuted_partner_is_a_permutation_within_batch(spark):
    df = spark.range(0, 200).select(F.col("id").alias("k"), (F.col("id") / 64).cast("long").alias("b"))
    p = V.permuted_partner(df, "k", "b", seed=9).collect()
    by_batch = {}
    for r in p:
        by_batch.setdefault(r.b, []).append((r.k, r.neg_key))
    for rows in by_batch.values():
        assert sorted(k for k, _ in rows) == sorted(n for _, n in rows)


def test_sampler_exact_with_huge_counts(spark):
    # totals far above 2**21: a double-precision position could slip across an edge
    big = 3_000_000_007
    model = spark.createDataFrame([(2, 4, big, 2 * big + 1), (2, 5, big + 1, 2 * big + 1)],
                                  "prev long, next long, cnt long, total long")
    cdf = EX.cdf_table(model, buckets=256)
    f = spark.range(0, 20000).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("prev"))
    drawn = EX.sample_next(f, cdf, X.hash_draw(1, F.col("k")), "prev", "next", buckets=256)
    rows = drawn.collect()
    assert len(rows) == 20000 and all(r.next in (4, 5) for r in rows)
    # boundary draw: d = 2**31 lands at floor(2**31 * T / 2**32) = big exactly -> the second interval
    edge = spark.createDataFrame([(1, 2, 2 ** 31)], "k long, prev long, d long")
    got = EX.sample_next(edge.select("k", "prev"), cdf, F.lit(2 ** 31).cast("long"), "prev", "next", 256).first()
    assert got.next == 5


def test_aspect_phrases(spark):
    t = V.aspect_phrases(spark, ["trip"]).collect()
    assert len(t) == 6 and t[0].aspect == "Service"
    with pytest.raises(ValueError):
        V.aspect_phrases(spark, ["nope"])


def test_encode_oov_clamp(spark):
    df = spark.createDataFrame([(1, "a zzz")], "k int, text string")
    vocab = spark.createDataFrame([("a", 9, 4)], "token string, cnt long, id long")
    ids = TK.encode(df, "k", "text", vocab, 5, oov="clamp", vocab_size=50).first().ids
    assert ids == [TK.START, 4, 49, TK.END, TK.PAD]
    with pytest.raises(ValueError):
        TK.encode(df, "k", "text", vocab, 5, oov="clamp")


def test_restaurant_dedup_option(spark):
    from revel.plans.jobs import prepare_restaurants
    from tests.conftest import SF_SMALL

    fan_out = prepare_restaurants(spark, SF_SMALL, sink=False)
    dedup = prepare_restaurants(spark, SF_SMALL, sink=False, dedup=True)
    assert dedup.count() == fan_out.select("user", "item").distinct().count() < fan_out.count()


def test_prepare_hotels_frames_first_pair_and_defaults(spark):
    from revel.plans.jobs import prepare_hotels_frames

    reviews = spark.createDataFrame(
        [(1, "u1", "h1", "great", 5.0, {"Value": 4.0}), (2, "u1", "h1", "again", 3.0, {}),
         (3, "u2", "h2", "ok", 4.0, None)],
        "pos long, userID string, hotelID string, reviewText string, rating double, subRatings map<string,double>")
    expl = spark.createDataFrame([(10, "u1", "h1", ["a", "b", "first", "c"]), (11, "u1", "h1", ["a", "b", "second"]),
                                  (12, "u2", "h2", ["a", "b", "third", "d"]), (13, "u9", "h9", ["x", "y", "z", "w"])],
                                 "pos long, user string, item string, template array<string>")
    out = {(r.user, r.item): r for r in prepare_hotels_frames(reviews, expl, "pos", "pos").collect()}
    assert set(out) == {("u1", "h1"), ("u2", "h2")}
    r = out[("u1", "h1")]
    assert (r.explanation, r.text, r.value, r.service) == ("first", "great", 4.0, 0.0)
    assert out[("u2", "h2")].cleanliness == 0.0


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_depend_on_partitioning(spark, parts):
    from revel.operators import metrics as M
    from revel.operators import prep as P
    from revel.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    pairs = fx.pairs(spark, SF_SMALL)
    base = sorted(tuple(r) for r in M.pair_scores(pairs).select("pair_id", "bleu4", "rouge_l_f").collect())
    moved = sorted(tuple(r) for r in M.pair_scores(pairs.repartition(parts)).select("pair_id", "bleu4", "rouge_l_f")
                   .collect())
    assert base == moved
    rep = M.text_report(M.pair_scores(pairs.repartition(parts))).first()
    ref = M.text_report(M.pair_scores(pairs)).first()
    assert rep.n_pairs == ref.n_pairs and rep.bleu1 == pytest.approx(ref.bleu1, abs=1e-9)

    e = fx.explanations(spark, SF_SMALL).select(F.col("pos").alias("e_pos"), F.col("user_key").alias("user"),
                                                  F.col("item_key").alias("item"), "explanation")
    a = sorted(tuple(r) for r in P.keep_first(e, ["user", "item"], ["e_pos"]).collect())
    b = sorted(tuple(r) for r in P.keep_first(e.repartition(parts), ["user", "item"], ["e_pos"]).collect())
    assert a == b


def test_first_seen_indexes_match_single_key_version(spark):
    df = spark.createDataFrame([(0, "b", "x"), (1, "a", "y"), (2, "b", "y"), (3, "c", "z")],
                               "pos long, user string, item string")
    many = X.first_seen_indexes(df, ["user", "item"], "pos")
    for k in ("user", "item"):
        one = {r[0]: r[1] for r in X.first_seen_index(df, k, "pos").collect()}
        assert {r[0]: r[1] for r in many[k].collect()} == one


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_join_sorts_neither_side(spark):
    from revel.operators import prep as P

    left = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), (None, "x", 3), ("b", "y", 4)], "user string, item string, e int")
    right = spark.createDataFrame([("a", "x", "s"), ("a", "x", "t"), (None, "x", "u"), ("c", "z", "v")], "user string, item string, text string")
    for how in ("inner", "left"):
        hashed = P.join_on_keys(left, right, how=how, hashed=True)
        assert sorted(map(str, hashed.collect())) == sorted(map(str, P.join_on_keys(left, right, how=how).collect()))
        assert "ShuffledHashJoin" in _plan(hashed) and "Sort " not in _plan(hashed)


def test_distinct_rows_compares_only_rows_with_equal_hashes(spark):
    from revel.operators import prep as P

    rows = [("u", "a", 1.0), ("u", "a", 1.0), ("u", None, 1.0), ("u", None, 1.0), (None, "u", 1.0), ("v", "b", None), ("v", "b", 2.0), (None, None, None)]
    df = spark.createDataFrame(rows, "user string, text string, rating double")
    got = P.distinct_rows(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert "LeftAnti" in _plan(got)
    assert P.distinct_rows(df.limit(0)).count() == 0


def test_pairs_of_ids_and_their_text(spark):
    df = spark.createDataFrame([(1, "a", [2, 7, 3, 0, 0]), (2, "b", [2]), (3, "c", None), (4, "d", [2, 9, 9, 3])], "pos long, attribute string, ids array<long>")
    pairs = EX.bigram_pairs(df, "pos", "ids", ["attribute"])
    assert pairs.columns == ["pos", "attribute", "step", "prev", "next"]
    assert sorted(map(tuple, pairs.collect())) == [(1, "a", 0, 2, 7), (1, "a", 1, 7, 3), (4, "d", 0, 2, 9), (4, "d", 1, 9, 9), (4, "d", 2, 9, 3)]
    text = df.select("pos", TK.ids_text("ids").alias("t"))
    assert {r.pos: r.t for r in text.collect()} == {1: "2 7 3 0 0", 2: "2", 3: None, 4: "2 9 9 3"}
    # a cast of the whole array: no lambda a number
    assert "lambda" not in _plan(text) and "arrays_zip" not in _plan(pairs)
