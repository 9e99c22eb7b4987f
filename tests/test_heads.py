"""Regressions fitted in one pass, against solutions on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revel.operators import rating as RT
from revel.operators.heads import fit_heads, predicted

SCHEMA = "features array<double>, y double, z double, pos long"


def solved(x, y, reg):
    """Ridge in the space of standardised features."""
    at, sd = x.mean(axis=0), x.std(axis=0)
    s = (x - at) / np.where(sd > 1e-6, sd, 1) * (sd > 1e-6)
    w = np.linalg.solve(s.T @ s / len(y) + (reg + 1e-12) * np.eye(x.shape[1]), s.T @ (y - y.mean()) / len(y))
    return y.mean() + s @ w


@pytest.mark.parametrize("reg", [0.0, 0.3])
def test_heads_equal_a_solution_on_the_driver(spark, reg):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(3, 2, (400, 5)), np.full((400, 1), 7.0)], axis=1)
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(0, 0.5, 400) + 4
    z = x[:, 1] ** 2
    has_z = rng.random(400) < 0.7
    rows = [(v.tolist(), float(a), float(b) if h else None, i) for i, (v, a, b, h) in enumerate(zip(x, y, z, has_z))]
    rows += [(None, 1e6, 1e6, 400), (rows[0][0], float("nan"), None, 401)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    heads = fit_heads(df, ["y", "z"], reg=reg)
    got = {r.pos: r for r in df.select("pos", predicted(heads, "y").alias("y"), predicted(heads, "z").alias("z")).collect()}
    assert [got[i].y for i in range(400)] == pytest.approx(solved(x, y, reg).tolist(), rel=1e-6, abs=1e-6)
    own = np.flatnonzero(has_z)
    assert [got[i].z for i in own] == pytest.approx(solved(x[own], z[own], reg).tolist(), rel=1e-6, abs=1e-6)
    # no features: the means of the rows that have the target
    assert (got[400].y, got[400].z) == pytest.approx((y.mean(), z[own].mean()))
    assert heads.weights[:, 5].tolist() == [0, 0]


def test_heads_without_rows_or_targets(spark):
    none = fit_heads(spark.createDataFrame([], SCHEMA), ["y", "z"])
    assert np.isnan(none.means).all()
    df = spark.createDataFrame([([1.0, 2.0], 3.0, None, 1), ([2.0, 2.0], 4.0, None, 2)], SCHEMA)
    heads = fit_heads(df, ["y", "z"], reg=0.0)
    assert [r[0] for r in df.orderBy("pos").select(predicted(heads, "y")).collect()] == pytest.approx([3.0, 4.0])
    assert np.isnan(heads.means[1]) and not np.isnan(heads.means[0])


def test_outputs_option(spark):
    rows = [(i, [float(i % 3), 1.0], [float(i % 2)], [3.0, 4.0], float(i % 3 + 1), float(i % 2)) for i in range(60)]
    rows += [(60, None, [1.0], [0.0, 0.0], 2.0, 1.0)]
    df = spark.createDataFrame(rows, "pos long, uf array<double>, if_ array<double>, text_vec array<double>, rating double, value double")
    heads = RT.fit_outputs(df, ["value", "rating"], reg=0.0)
    assert heads.targets == ["rating", "value"]
    base = df.columns
    frames = {o: RT.predict_outputs(heads, df, o) for o in RT.OUTPUTS}
    assert [f.columns[len(base):] for f in frames.values()] == [["pred"], ["pred", "pred_criteria"], ["pred", "aspect_rep"]]
    for f in frames.values():
        assert [r.pred for r in f.where("pos < 60").orderBy("pos").collect()] == pytest.approx([float(i % 3 + 1) for i in range(60)])
    cold = {o: f.where("pos = 60").first() for o, f in frames.items()}
    assert cold["plain"].pred == pytest.approx(2.0) and cold["criteria"].pred_criteria == pytest.approx([0.5])
    assert cold["aspect"].aspect_rep == [0.0, 0.0]
    assert frames["aspect"].where("pos = 1").first().aspect_rep == pytest.approx([0.6, 0.8])
    assert [r[0][0] for r in frames["criteria"].where("pos < 60").orderBy("pos").select("pred_criteria").collect()] == pytest.approx(
        [float(i % 2) for i in range(60)])
    with pytest.raises(ValueError):
        RT.predict_outputs(heads, df, "all")
