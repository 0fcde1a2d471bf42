"""Every registered key against its DuckDB oracle (the driver's gate, at sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as entry
from strata.registry import ORACLES, QUERIES
from strata.sources.files import TEST_TABLES
from tests.conftest import SF_SMALL



def _rows(df, digits=6):
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False, name=None):
        vals = []
        for v in rec:
            if v is None or (isinstance(v, float) and v != v):
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(repr(round(v, digits)))
            elif hasattr(v, "isoformat"):
                vals.append(str(v).replace("T", " "))
            else:
                vals.append(str(v))
        out.append(tuple(vals))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_key_matches_oracle(spark, duck, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[key]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["parent_table", "parent_col", "child_table", "child_col"]
    assert df.count() > 0
