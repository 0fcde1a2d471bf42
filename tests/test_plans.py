"""Plan guards over every job of every registered key, jobs inside operators
included (read from Spark's event log): no cartesian or nested-loop joins, no
row-wise or grouped Python, and no window over rows that one task holds."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.registry import QUERIES
from tests.conftest import SF_SMALL
from tests.events import EventLog, operators

FORBIDDEN = {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInPandas"}


def _run(spark, make):
    log = EventLog(spark)
    make().write.format("noop").mode("overwrite").save()
    return [node for plan in log.plans().values() for node in operators(plan)]


def _offences(nodes):
    bad = sorted({op for op, _ in nodes if op in FORBIDDEN})
    # Arguments: [functions], [keys], [order]; without keys all rows are one task's
    return bad + [f"Window without keys: {a}" for op, a in nodes if op == "Window" and "], [" in a and a.count("], [") < 2]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_job_has_forbidden_operators(spark, key):
    nodes = _run(spark, lambda: QUERIES[key](spark, SF_SMALL))
    assert nodes
    assert _offences(nodes) == []


def test_the_guard_sees_jobs_inside_an_operator(spark):
    def operator():
        a = spark.range(5)
        a.crossJoin(a.toDF("b")).write.format("noop").mode("overwrite").save()
        a.select(F.sum("id").over(Window.orderBy("id")).alias("s")).collect()
        return a

    found = _offences(_run(spark, operator))
    assert any(x in FORBIDDEN for x in found) and any(x.startswith("Window") for x in found)


def test_rank_in_group_never_windows_by_the_bare_key(spark):
    nodes = _run(spark, lambda: QUERIES["rank_in_group"](spark, SF_SMALL))
    windows = [a for op, a in nodes if op == "Window" and "c_mktsegment" in a]
    assert windows and all("_pid" in a for a in windows)
