"""Factors of unseen users against solutions on the driver, and what they are worth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revel.operators import rating as RT
from revel.operators.fold_in import dot_predictions, fold_in, with_new

SCHEMA = "user_idx long, item_idx long, rating double"


def test_fold_in_solves_each_id(spark):
    rng = np.random.default_rng(3)
    items = {i: rng.normal(size=4) for i in range(30)}
    fixed = spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], "id long, features array<double>")
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 8, 300), rng.integers(0, 40, 300), rng.integers(1, 6, 300))]
    # a hot user, null keys, null ratings, and a user with unknown items only
    rows += [(100, i % 30, float(i % 5)) for i in range(600)] + [(None, 1, 3.0), (200, 1, None), (300, 99, 4.0), (400, 2, float("nan"))]
    got = {r.id: r.features for r in fold_in(spark.createDataFrame(rows, SCHEMA).repartition(5), fixed, 4, reg=0.2).collect()}
    assert got.keys() == {*range(8), 100}
    for u, p in got.items():
        own = [(items[i], r) for w, i, r in rows if w == u and i in items]
        q, r = np.array([x for x, _ in own]), np.array([y for _, y in own])
        want = np.linalg.solve(q.T @ q + 0.2 * len(r) * np.eye(4), q.T @ r)
        assert p == pytest.approx(want.tolist(), rel=1e-6, abs=1e-8)
    assert fold_in(spark.createDataFrame([], SCHEMA), fixed, 4).count() == 0
    # one rating and no ridge: the solution of least norm
    one = fold_in(spark.createDataFrame([(1, 2, 3.0)], SCHEMA), fixed, 4, reg=0.0).first().features
    assert np.dot(one, items[2]) == pytest.approx(3.0)


def test_unseen_users_and_items_beat_the_mean(spark):
    rows = [(u, i, float(1 + (u % 3) + (i % 2))) for u in range(60) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    new = F.col("user_idx") >= 45
    als = RT.fit_factors(df.where(~new))
    known, asked = df.where(new & (F.col("item_idx") < 15)), df.where(new & (F.col("item_idx") >= 15))
    mean = df.where(~new).agg(F.avg("rating")).first()[0]
    users = with_new(als.userFactors, fold_in(known, als.itemFactors, 8))
    assert users.count() == 60

    def rmse(pred):
        return math.sqrt(pred.agg(F.avg((F.col("pred") - F.col("rating")) ** 2)).first()[0])

    out = dot_predictions(asked, users, als.itemFactors, mean)
    assert out.count() == asked.count()
    base = rmse(asked.withColumn("pred", F.lit(mean)))
    assert rmse(out) < 0.5 * base
    # without the fold-in they get the mean
    assert rmse(dot_predictions(asked, als.userFactors, als.itemFactors, mean)) == pytest.approx(base)
    # a known id keeps its factors
    again = with_new(als.userFactors, fold_in(df, als.itemFactors, 8))
    a, b = ({r.id: list(r.features) for r in t.where("id < 45").collect()} for t in (als.userFactors, again))
    assert all(b[k] == pytest.approx(v) for k, v in a.items())
