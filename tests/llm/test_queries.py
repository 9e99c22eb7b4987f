import duckdb
import pytest

import __spark_entry__ as entry
from revel.llm import queries

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{k}" for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda columns, rows: sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows), key=repr)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op7_shards", "op9_lines"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
