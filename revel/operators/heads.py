"""Several ridge regressions over the same features, fitted in one pass.

Each task adds its rows to a matrix of products (features by features and
features by targets); Spark sums the matrices and the driver solves one small
system for each target.  What reaches the driver is bounded by the features,
the targets and the combinations of missing targets, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Heads(NamedTuple):
    """``weights`` (a row for each target), ``intercepts`` and ``means`` of the targets' training rows."""

    targets: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    means: np.ndarray


def product_sums(df: DataFrame, features: str, targets: list[str]) -> DataFrame:
    """``missing, place, total``: sums of the products of ``[1, features, targets]`` with ``[1, features]``, row by row of the matrix,
    for each combination of missing targets (bit k of ``missing``).

    Rows without features are left out.  A null or NaN target counts as missing, and as 0 in the sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(targets))], axis=1)
            none = np.isnan(y)
            code = (none << np.arange(len(targets))).sum(axis=1)
            left = np.concatenate([np.ones((n, 1)), x], axis=1)
            both = np.concatenate([left, np.where(none, 0.0, y)], axis=1)
            for c in np.unique(code).tolist():
                own = code == c
                sums[c] = sums.get(c, 0.0) + both[own].T @ left[own]
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, c)), pa.array(np.arange(s.size)), pa.array(s.ravel())],
                                             ["missing", "place", "total"])

    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"),
                                                        *(F.col(t).cast("double").alias(f"y{k}") for k, t in enumerate(targets)))
    return rows.mapInArrow(add, "missing long, place long, total double").groupBy("missing", "place").agg(F.sum("total").alias("total"))


def fit_heads(df: DataFrame, targets: list[str], features: str = "features", reg: float = 0.01) -> Heads:
    """Ridge regression of each target on the array column ``features``, over the rows that have the target.

    Minimises half the mean squared error plus ``reg / 2`` times the squared weights of the standardised features; the intercept
    is free.  Constant features get weight 0.  A target that no row has predicts NaN."""
    sums = product_sums(df, features, targets).toArrow().sort_by([("missing", "ascending"), ("place", "ascending")])
    k = len(targets)
    if not sums.num_rows:
        return Heads(list(targets), np.zeros((k, 0)), np.full(k, np.nan), np.full(k, np.nan))
    codes, first = np.unique(sums.column("missing").to_numpy(), return_index=True)
    blocks = np.split(sums.column("total").to_numpy(), first[1:])
    # rows: 1 + features + targets; columns: 1 + features
    size = len(blocks[0])
    d = round(((k * k + 4 * size) ** 0.5 - k) / 2)
    blocks = [b.reshape(d + k, d) for b in blocks]
    weights, intercepts, means = np.zeros((k, d - 1)), np.full(k, np.nan), np.full(k, np.nan)
    for t in range(k):
        own = [b for c, b in zip(codes.tolist(), blocks) if not c >> t & 1]
        if not own:
            continue
        total = np.sum(own, axis=0)
        n, at = total[0, 0], total[0, 1:] / total[0, 0]
        means[t] = total[d + t, 0] / n
        cov = total[1:d, 1:] / n - np.outer(at, at)
        cross = total[d + t, 1:] / n - at * means[t]
        var = np.diag(cov)
        varies = var > 1e-12 * (1 + at**2)
        lhs = cov[np.ix_(varies, varies)] + reg * np.diag(var[varies])
        weights[t, varies] = np.linalg.lstsq(lhs, cross[varies], rcond=None)[0]
        intercepts[t] = means[t] - weights[t] @ at
    return Heads(list(targets), weights, intercepts, means)


def predicted(heads: Heads, target: str, features: str = "features") -> Column:
    """The head's prediction; without features the target's training mean."""
    k = heads.targets.index(target)
    own = F.array(*(F.lit(float(w)) for w in heads.weights[k])) if heads.weights.shape[1] else F.array().cast("array<double>")
    dot = F.aggregate(F.zip_with(features, own, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(dot + F.lit(float(heads.intercepts[k])), F.lit(float(heads.means[k])))
