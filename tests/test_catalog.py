"""Every registered query against its DuckDB oracle on the smallest tables,
plus the entry smoke check."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

from revel.plans.catalog import ORACLE, QUERIES


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _duck_type(dt) -> str:
    from pyspark.sql import types as T

    if isinstance(dt, T.ArrayType):
        return _duck_type(dt.elementType) + "[]"
    return {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
            T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT"}.get(type(dt), str(dt))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_pairs > 0
    assert df.columns[:2] == ["n_pairs", "n_scorable"]


def test_every_query_has_an_oracle_and_is_registered():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k in ORACLE))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLE[key])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert {f.name: _duck_type(f.dataType) for f in sdf.schema.fields} == {c: str(t) for c, t in zip(ocols, rel.types)}
    assert _rows(sdf.columns, srows) == _rows(ocols, orows)
