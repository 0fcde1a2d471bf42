"""Property tests: skew-safe and distributed paths against brute force on
random inputs with a hot key."""

import fnmatch
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import relational as R
from strata.operators import relationships as REL
from strata.plans.files import glob_regex
from strata.plans.routing import NUMBER_BANDS

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows_with_hot_key = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.integers(-50, 50),
              st.integers(0, 10_000)),
    min_size=1, max_size=120,
)


@SETTINGS
@given(rows_with_hot_key, st.integers(1, 7))
def test_rank_in_group_equals_window(spark, rows, parts):
    rows = [(k, v, i) for i, (k, v, _) in enumerate(rows)]  # unique tie-break
    df = spark.createDataFrame(rows, "k string, v int, id int")
    order = [F.col("v").desc(), F.col("id")]
    got = {(r.id, r.rnk) for r in R.rank_in_group(df, "k", order, parts=parts).collect()}
    want = {(r.id, r.rnk) for r in df.withColumn(
        "rnk", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    assert got == want


@SETTINGS
@given(rows_with_hot_key)
def test_latest_per_key_equals_brute_force(spark, rows):
    rows = [(k, v, i) for i, (k, v, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {r.k: r.id for r in R.latest_per_key(df.where("k IS NOT NULL"), "k", ["v", "id"]).collect()}
    want = {}
    for k, v, i in rows:
        if k is not None and (k not in want or (v, i) > want[k][0]):
            want[k] = ((v, i), i)
    assert got == {k: i for k, (_, i) in want.items()}


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["1", "2", "3", "x", "y", None, "01"]), min_size=1, max_size=30),
                min_size=2, max_size=4))
def test_overlaps_equal_set_arithmetic(spark, columns):
    tables = {f"t{i}": spark.createDataFrame([(v,) for v in col], "c string") for i, col in enumerate(columns)}
    rel = REL.infer_relationships(spark, tables, 0.0, 0.0)
    got = {(r.child_table, r.parent_table, r.sample_overlap) for r in rel.collect()}
    sets = {f"t{i}": {v for v in col if v is not None} for i, col in enumerate(columns)}
    want = set()
    for c, cs in sets.items():
        for p, ps in sets.items():
            if c != p and cs and ps and len(cs & ps) > 0:
                want.add((c, p, len(cs & ps)))
    assert {g for g in got if g[2] > 0} == want


@given(st.text(alphabet="ab.*?", min_size=1, max_size=6), st.text(alphabet="ab.", max_size=8))
def test_glob_regex_matches_fnmatch(pattern, name):
    assert bool(re.match(glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


@given(st.integers(-10_000, 10_000))
def test_number_bands_are_ordered_and_total(n):
    codes = [c for upper, c in NUMBER_BANDS if n <= upper]
    expected = None if n > 2999 else ("0" if n <= 999 else "1" if n <= 1999 else "2")
    assert (codes[0] if codes else None) == expected
