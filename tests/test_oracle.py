"""Every catalogued query with an oracle gives the same values as DuckDB (sf0.001)."""

import pytest

from helpers import rows_of

import __spark_entry__ as E
from conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


_FAMILY = {"bigint": "int64", "int": "int32", "integer": "int32", "double": "double", "string": "string",
           "varchar": "string", "boolean": "bool"}


def _family(t: str) -> str:
    t = t.lower()
    return "decimal" if t.startswith("decimal") else _FAMILY.get(t, t)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(ORACLES[name])
    spark_types = {c: _family(t) for c, t in sdf.dtypes}
    duck_types = {c: _family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
    sp = sdf.toPandas()
    dp = rel.df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dp)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort_month", "purchase_month", "months_since_first_purchase", "num_customers"]
    assert df.count() > 0
