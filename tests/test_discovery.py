"""Columns ruled out by statistics: the same relationships, less shuffled; bounds that hold."""

import random

import numpy as np
from pyspark.sql import functions as F

from strata.operators import relationships as RL
from strata.sources.files import TEST_TABLES, load_tables
from tests.conftest import SF_MID


def test_pruned_discovery_gives_the_same_rows_and_shuffles_less(spark):
    tables = load_tables(spark, SF_MID, TEST_TABLES)
    cat = RL.catalog_rows(tables)
    keep = RL.viable_columns(tables, 0.8, 0.9)
    gone = {(t, c) for i, _, t, c in cat if i not in keep}
    assert {("customer", "c_name"), ("pages", "html"), ("lineitem", "l_linestatus")} <= gone
    size = lambda values: values.distinct().agg(F.sum(F.length("v"))).first()[0]
    assert size(RL.column_values(tables, keep)) + size(RL.sampled_values(tables)) < size(RL.column_values(tables))
    got, want = (sorted(map(tuple, RL.infer_relationships(spark, tables, prune=p).collect())) for p in (True, False))
    assert got == want and len(got) > 100


def test_random_tables_lose_nothing(spark):
    rng = random.Random(3)
    for _ in range(3):
        tables = {}
        for t in range(4):
            n = rng.choice([1, 30, 4000])
            kinds = [rng.choice(["int", "text", "short", "null", "neg"]) for _ in range(3)]
            make = {"int": lambda n=n: rng.randrange(n), "text": lambda n=n: f"k{rng.randrange(n)}", "short": lambda: rng.choice("ABC"),
                    "null": lambda n=n: None if rng.random() < 0.5 else str(rng.randrange(n)), "neg": lambda n=n: rng.randrange(-n, n + 1)}
            rows = [tuple([i, *[make[k]() for k in kinds]]) for i in range(n)]
            types = {"int": "long", "neg": "int"}
            tables[f"t{t}"] = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} {types.get(k, 'string')}" for j, k in enumerate(kinds)))
        tables["empty"] = spark.createDataFrame([], "id long, s string")
        for overlap, unique in ((0.8, 0.9), (0.0, 0.5), (1.0, 1.0)):
            got, want = (sorted(map(tuple, RL.infer_relationships(spark, tables, overlap, unique, prune=p).collect())) for p in (True, False))
            assert got == want


def test_nothing_viable_is_an_empty_result(spark):
    tables = {"a": spark.createDataFrame([("x",)], "s string"), "b": spark.createDataFrame([("long text",)], "s string")}
    assert RL.viable_columns(tables, 0.8, 0.9) == set()
    assert RL.infer_relationships(spark, tables, prune=True).collect() == []


def test_unlikely_is_a_bound():
    rng = np.random.default_rng(0)
    n = np.full(200_000, 40)
    hits = rng.binomial(n, 0.8)
    assert not RL._unlikely(hits, n, 0.8).any()                 # a true share is not ruled out
    assert RL._unlikely(np.array([0, 10]), np.array([40, 40]), 0.8).all()
    assert not RL._unlikely(np.array([0, 3, 0]), np.array([3, 3, 0]), 0.8).any()
