"""Registered queries: one Spark query per operator key, and the DuckDB
oracle SQL that recomputes it independently.

Every query reads the driver tables under ``sf_dir`` (through the fixture
views) over their whole extent; float outputs are rounded to 6 places on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: what fitted models predict, in full; no SQL can recompute it (rows check only)
VALUES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def register_values(key: str):
    def deco(fn):
        VALUES[key] = fn
        return fn
    return deco


def round6(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# Import the query modules so they register themselves.
from revel.plans import q_index, q_learn, q_metrics, q_prep, q_vectors  # noqa: E402,F401
