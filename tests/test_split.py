"""The exact split without a sort, against ranks on the driver."""

import hashlib
from collections import Counter

import pytest

from revel.operators import index as X


def ranked(keys, seed):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    train, val, _ = X.split_sizes(len(order))
    return {k: "train" if i < train else "val" if i < train + val else "test" for i, k in enumerate(order)}


@pytest.mark.parametrize("n, few", [(1, 10_000), (2, 10_000), (7, 1), (1001, 10_000), (3000, 1)])
def test_cuts_equal_ranks(spark, monkeypatch, n, few):
    monkeypatch.setattr(X, "FEW", few)
    df = spark.range(0, 3 * n, 3, 4).withColumnRenamed("id", "k")
    out = X.exact_split(df, "k", 5)
    assert {r.k: r.split for r in out.collect()} == ranked(range(0, 3 * n, 3), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_text_keys_empty_tables_and_repeated_keys(spark, monkeypatch):
    keys = [f"k{i}" for i in range(200)]
    out = X.exact_split(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 9)
    assert {r.k: r.split for r in out.collect()} == ranked(keys, 9)
    assert X.exact_split(spark.createDataFrame([], "k string"), "k").collect() == []
    for few in (10_000, 1):
        monkeypatch.setattr(X, "FEW", few)
        for rows in ([(1,)] * 50, [(None,)] * 30 + [(i,) for i in range(20)]):
            got = Counter(r.split for r in X.exact_split(spark.createDataFrame(rows, "k long"), "k").collect())
            assert got == {"train": 40, "val": 5, "test": 5}
