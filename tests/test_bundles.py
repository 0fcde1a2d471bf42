"""Bundles by target size and ranking over ranges: one shuffle of the rows, hot groups, NULL keys."""

import math
import os

import pytest
from pyspark.sql import functions as F

from strata.operators.relational import rank_in_group
from strata.sinks import bundles as B


def bundles(path):
    out = {}
    for d, _, names in os.walk(path):
        parts = [n for n in names if n.startswith("part-")]
        if parts:
            out.setdefault(d.split("k=")[1].split("/")[0], []).append(len(parts))
    return out


def test_files_per_key_are_bytes_by_target(spark, tmp_path):
    # a hot key with two thirds of the rows, a NULL key, equal rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        (F.col("id") % 5).alias("v"), F.lit(10).cast("long").alias("n"))
    path = str(tmp_path / "b")
    B.pack_bundles(df, path, "k", [F.col("v")], 900, size=F.col("n"), parts=7)
    got = bundles(path)
    want = {("__HIVE_DEFAULT_PARTITION__" if r.k is None else r.k): math.ceil(r.b / 900) for r in df.groupBy("k").agg(F.sum("n").alias("b")).collect()}
    assert {k: len(v) for k, v in got.items()} == want and all(x == [1] * len(x) for x in got.values())
    back = spark.read.parquet(path)
    assert back.count() == 3000
    assert back.groupBy("k", "bundle_part").agg(F.sum("n").alias("b")).agg(F.max("b")).first()[0] <= 900
    # parts follow the order inside a key
    spans = back.groupBy("k", "bundle_part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("k = 'hot'").orderBy("bundle_part").collect()
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:], strict=False))


def test_long_rows_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "x" * 5000), ("a", "y"), ("b", None), ("b", "z" * 10)], "k string, t string")
    path = str(tmp_path / "b")
    B.pack_bundles(df, path, "k", [F.col("t")], 1000)
    assert spark.read.parquet(path).count() == 4
    B.pack_bundles(df.limit(0), str(tmp_path / "e"), "k", [F.col("t")], 1000)
    assert bundles(str(tmp_path / "e")) == {}


@pytest.mark.parametrize("parts", [1, 6])
def test_rank_shuffles_the_rows_once(spark, parts):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 11).alias("g"), "id")
    out = rank_in_group(df, "g", [F.col("id").desc()], parts=parts)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # from the window down to the scan of the ranges there is no exchange; the others are of edges and offsets
    window = plan[plan.index("Window ["):]
    first = window[: window.index("Scan parquet")]
    assert "Exchange" not in first and "Bucketed: true" in window
    seen = {}
    for r in sorted(rows, key=lambda r: (r.g, r.rnk)):
        seen.setdefault(r.g, []).append((r.rnk, r.id))
    for ids in seen.values():
        assert [k for k, _ in ids] == list(range(1, len(ids) + 1))
        assert [i for _, i in ids] == sorted((i for _, i in ids), reverse=True)
    assert sum(map(len, seen.values())) == 4000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("strata_ranged")]
