"""Factors of users (or items) that the factor model was not fitted on.

A new user with some ratings gets the factors that fit these best against the
items' fixed factors: a ridge system of the size of the rank, whose matrix is
a sum over the user's ratings.  The sums are ordinary aggregates with partial
sums, so an id that holds a third of all ratings costs one row for each task;
the systems are solved in batches where their rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_in(ratings: DataFrame, fixed: DataFrame, rank: int, own: str = "user_idx", other: str = "item_idx", rating: str = "rating",
            reg: float = 0.1) -> DataFrame:
    """``id, features`` of each ``own`` id of ``ratings`` that rated something with factors in ``fixed`` (``id, features``).

    Solves ``(sum q q' + reg * n * I) p = sum r q`` over its ``n`` such ratings, the factor model's own step for one id.  Null ids
    and null or NaN ratings are left out; repeated ratings count each time."""
    pairs = [(i, j) for i in range(rank) for j in range(i + 1)]
    rows = ratings.select(F.col(own).cast("long").alias("id"), F.col(other).cast("long").alias("other"), F.col(rating).cast("double").alias("r"))
    rows = rows.where("id is not null and r is not null and not isnan(r)")
    q = [F.col("q")[i] for i in range(rank)]
    rows = rows.join(fixed.select(F.col("id").cast("long").alias("other"), F.col("features").cast("array<double>").alias("q")), "other")
    sums = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(q[i] * q[j]).alias(f"m{i}_{j}") for i, j in pairs),
                                  *(F.sum(q[i] * F.col("r")).alias(f"b{i}") for i in range(rank)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            left = np.zeros((batch.num_rows, rank, rank))
            for k, (i, j) in enumerate(pairs):
                left[:, i, j] = left[:, j, i] = cols[2 + k]
            left += (reg * cols[1])[:, None, None] * np.eye(rank)
            right = np.stack(cols[2 + len(pairs):], axis=1)
            # least squares of least norm: without reg the system may be singular
            found = (np.linalg.pinv(left, hermitian=True) @ right[:, :, None])[:, :, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rank), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "features"])

    return sums.mapInArrow(solve, "id long, features array<double>")


def with_new(known: DataFrame, new: DataFrame) -> DataFrame:
    """Factors of both tables; an id in both keeps its known ones."""
    known = known.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    return known.unionByName(new.join(known.select("id"), "id", "left_anti"))


def dot_predictions(df: DataFrame, users: DataFrame, items: DataFrame, fallback: Column | float, user: str = "user_idx",
                    item: str = "item_idx") -> DataFrame:
    """``df`` with ``pred``, the product of the user's and the item's factors; ``fallback`` where either has none."""
    for table, key, name in ((users, user, "_p"), (items, item, "_q")):
        df = df.join(table.select(F.col("id").cast("long").alias(key), F.col("features").cast("array<double>").alias(name)), key, "left")
    dot = F.aggregate(F.zip_with("_p", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("pred", F.coalesce(dot, fallback if isinstance(fallback, Column) else F.lit(fallback))).drop("_p", "_q")
