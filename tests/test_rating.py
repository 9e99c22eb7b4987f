"""What must hold of the fitted rating models, beside the invariants of the catalog."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from revel.operators import metrics as M
from revel.operators import rating as RT
from revel.operators import prep as P
from revel.plans import q_vectors as Q
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def ratings(spark):
    """Ratings of a user taste plus an item level, with a text vector that tells the item level."""
    rows = [(u * 40 + i, u, i, float(1 + (u % 3) + (i % 2)), [float(i % 2), 1.0], "test" if (u * 7 + i) % 10 == 0 else "train",
             float(1 + i % 5)) for u in range(60) for i in range(40)]
    rows += [(10_000, 999, 1, 3.0, [1.0, 1.0], "test", 1.0), (10_001, 1, 999, 3.0, [1.0, 1.0], "test", 1.0)]
    return spark.createDataFrame(rows, "pos long, user_idx long, item_idx long, rating double, text_vec array<double>, split string, value double")


def test_predictions_beat_the_mean_and_cold_start_gets_it(spark, ratings):
    als = RT.fit_factors(ratings.where("split = 'train'"))
    got = {t: Q._test_frame(ratings, als, t) for t in (True, False)}
    mean = ratings.where("split = 'train'").agg(F.avg("rating")).first()[0]
    base = math.sqrt(ratings.where("split = 'test'").agg(F.avg((F.col("rating") - mean) ** 2)).first()[0])
    for frame in got.values():
        assert frame.count() == ratings.where("split = 'test'").count()
        assert M.rating_errors(frame).first().rmse < 0.5 * base
        cold = {r.pos: r.pred for r in frame.where("pos >= 10000").collect()}
        assert cold == pytest.approx({10_000: mean, 10_001: mean})


def test_factors_of_users_and_items_and_refit(spark, ratings):
    train = ratings.where("split = 'train'")
    a, b = ({(r.kind, r.id): r.features for r in RT.all_factors(RT.fit_factors(train)).collect()} for _ in range(2))
    assert {k for k, _ in a} == {"user", "item"} and len(a) == 100 and all(len(v) == 8 for v in a.values())
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_criteria_of_unseen_ids_are_the_means(spark, ratings):
    feats = RT.factor_features(ratings, RT.fit_factors(ratings.where("split = 'train'")))
    models = RT.fit_criteria(feats.where("split = 'train'"), ["value", "rating"])
    out = {r.pos: r.pred_criteria for r in RT.predict_criteria(models, feats.where("split = 'test'")).collect()}
    assert len(out) == ratings.where("split = 'test'").count() and all(len(v) == 2 for v in out.values())
    means = ratings.where("split = 'train'").agg(F.avg("value"), F.avg("rating")).first()
    assert out[10_000] == pytest.approx(list(means))


def test_queries_return_the_numbers_behind_their_checks(spark):
    run = E.queries()
    frames = {k: run[f"{k}_values"](spark, SF_SMALL).collect() for k in ("rate_predict", "rate_test_frame")}
    for k, rows in frames.items():
        assert rows[0].asDict().keys() == {"pos", "truth", "pred"} and len({r.pred for r in rows}) > 1
        assert {(r.pos, r.truth) for r in rows} == {(r.pos, r.truth) for r in run[k](spark, SF_SMALL).collect()}
        assert all(-1 <= r.pred <= 7 for r in rows)
    errors = {r.use_review_text: r for r in run["job_rating_eval_values"](spark, SF_SMALL).collect()}
    for text, rows in ((True, frames["rate_predict"]), (False, frames["rate_test_frame"])):
        d = [r.pred - r.truth for r in rows]
        mse = sum(x * x for x in d) / len(d)
        want = (len(d), mse, math.sqrt(mse), sum(map(abs, d)) / len(d))
        assert tuple(errors[text])[1:] == pytest.approx(want, rel=1e-4)
    criteria = run["rate_criteria_values"](spark, SF_SMALL)
    assert criteria.columns == ["pos", *(f"pred_{c}" for c in P.CRITERIA_ORDER[:5])]
    rows = criteria.collect()
    assert {r.pos for r in rows} == {r.pos for r in frames["rate_predict"]}
    assert all(v is not None and -2 <= v <= 7 for r in rows for v in tuple(r)[1:])
    factors = run["rate_user_item_factors_values"](spark, SF_SMALL).collect()
    assert {r.kind for r in factors} == {"user", "item"} and all(len(r.features) == 8 for r in factors)
    assert len({tuple(r.features) for r in factors}) > 2


def test_queries_of_outputs_and_cold_start(spark):
    run = E.queries()
    out = run["rate_outputs_values"](spark, SF_SMALL).collect()
    by = {o: {r.pos: r for r in out if r.outputs == o} for o in RT.OUTPUTS}
    assert len(by["plain"]) * 3 == len(out) and by["plain"].keys() == by["criteria"].keys() == by["aspect"].keys()
    criteria = [f"pred_{c}" for c in P.CRITERIA_ORDER[:5]]
    for r in out:
        assert r.pred == by["plain"][r.pos].pred and -1 <= r.pred <= 7
        assert all((r[c] is not None) == (r.outputs == "criteria") for c in criteria)
        assert (r.aspect_rep is not None) == (r.outputs == "aspect")
    for r in by["aspect"].values():
        assert sum(x * x for x in r.aspect_rep) == pytest.approx(1.0) or not any(r.aspect_rep)
    cold = run["rate_cold_start_values"](spark, SF_SMALL).collect()
    assert cold and len({r.pos for r in cold}) == len(cold) and len({r["mean"] for r in cold}) == 1
    assert {r.pos for r in cold} <= by["plain"].keys() and all(math.isfinite(r.pred) for r in cold)
    assert any(r.pred != r["mean"] for r in cold)


def test_texts_are_gathered_without_a_sort_and_small_factors_leave_rows_where_they_are(spark, ratings, monkeypatch):
    """Neither the sort of all rows with their texts nor a shuffle of rows to small factor tables."""
    plans = {}
    real = Q.materialized

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(Q, "materialized", spy)
    frame = Q._rating_frame(spark, SF_SMALL)
    assert "SortAggregate" not in plans["text-vectors"] and "HashAggregate" in plans["text-vectors"]
    assert frame.count() == Q.fx.interactions(spark, SF_SMALL).count()
    feats = RT.factor_features(ratings, RT.fit_factors(ratings.where("split = 'train'")))
    assert "hashpartitioning" not in feats._jdf.queryExecution().executedPlan().toString()
