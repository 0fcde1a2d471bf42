"""Unit tests: semantic traps, skew paths against brute force,
properties, and plan shape."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import paths as PT
from strata.functions.text import percent_text
from strata.operators import cleaning as CL
from strata.operators import documents as DOC
from strata.operators import insight as I
from strata.operators import relational as R
from strata.operators import relationships as REL
from strata.plans import files as P
from strata.plans import routing as RT
from strata.registry import QUERIES
from strata.registry_io import inv_frame
from strata.session import literal_ts, scratch_path, temp_output, path_exists
from strata.sinks import writers as W
from strata.sources import files as S
from strata.sources import synth as SY
from tests.conftest import SF_MID, SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ traps

def test_headerless_csv_needs_schema(spark):
    with pytest.raises(ValueError):
        S.read_csv(spark, "/nowhere", header=False)


def test_contradiction_is_folded_to_empty(spark):
    df = QUERIES["contradiction"](spark, SF_SMALL)
    assert df.count() == 0
    assert "LocalTableScan" in plan_text(df) or "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()


def test_percent_text_rounds_half_even(spark):
    row = spark.range(1).select(percent_text(F.lit(0.8125), 1).alias("a"),
                                percent_text(F.lit(1.0), 0).alias("b")).first()
    assert (row.a, row.b) == ("81.2%", "100%")


def test_try_divide_by_zero_files(spark):
    stats = spark.createDataFrame([("f", 0, 0, "error")], "file string, rows_in long, rows_out long, status string")
    row = CL.run_summary(stats, 3.0).first()
    assert row.files_ok == 0 and row.seconds_per_file is None


def test_repair_only_partitioned(spark):
    with temp_output(spark, "cat") as base:
        W.ensure_db(spark, "strata_t", location=f"{base}/db", use=False)
        W.ensure_table(spark, "strata_t.flat", "id INT, name STRING, value DOUBLE", location=f"{base}/flat")
        W.ensure_table(spark, "strata_t.parted", "id INT, value DOUBLE, category INT", ["category"],
                       location=f"{base}/parted")
        W.insert_partition(spark, "strata_t.parted", {"category": 1},
                           spark.createDataFrame([(1, 100.0)], "id int, value double"))
        assert W.repair(spark, "strata_t.flat") is False
        assert W.repair(spark, "strata_t.parted") is True
        assert spark.sql("SELECT * FROM strata_t.parted WHERE category = 1").count() == 1


def test_named_aggregates_do_not_depend_on_dict_order(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 2.0)], "k string, v double, w double")
    assert R.avg_max(df, "k", "v", "w").columns == ["k", "avg_v", "max_w"]


def test_last_two_parts(spark):
    rows = spark.createDataFrame([("/var/tmp/projects/3/client1",), ("solo",), ("/a/",)], "p string").select(
        PT.last_two_parts(F.col("p")).alias("x")).collect()
    assert [r.x for r in rows] == ["3_client1", "solo", "a"]


def test_dead_window_is_pruned(spark):
    df = SY.synth_measures(spark, 1000, 2)
    w = Window.partitionBy("group").orderBy(F.col("value").desc())
    out = df.withColumn("rank", F.row_number().over(w)).groupBy("group").agg(F.avg("value"))
    assert "Window" not in plan_text(out)


# ------------------------------------------------------------------ skew paths vs brute force

def test_rank_in_group_hot_key_matches_window(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.col("id") * 7919 % 1000).cast("double").alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    got = R.rank_in_group(df, "k", order, parts=6)
    want = df.withColumn("rnk", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("int"))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.count() == n


def test_top_in_group_uses_partial_group_limit(spark):
    df = spark.read.parquet(f"{SF_MID}/customer.parquet")
    out = R.top_in_group(df, "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString() or out.count() == 15


def test_latest_per_key_is_an_aggregate(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "x"), (None, 9, "n")], "k int, t int, body string")
    out = R.latest_per_key(df, "k", ["t"])
    assert sorted((r.k, r.body) for r in out.collect() if r.k is not None) == [(1, "c"), (2, "x")]
    assert "Window" not in plan_text(out)


def test_children_counts_with_repeated_parent_keys(spark):
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pk int")
    child = spark.createDataFrame([(1,), (1,), (3,), (None,)], "fk int")
    got = {(r.pk, r.n) for r in I.children_counts(parent, child, "pk", "fk", "n").collect()}
    parent.createOrReplaceTempView("p_t")
    child.createOrReplaceTempView("c_t")
    want = {(r.pk, r.n) for r in spark.sql(
        "SELECT p.pk, count(c.fk) AS n FROM p_t p LEFT JOIN c_t c ON c.fk = p.pk GROUP BY p.pk").collect()}
    assert got == want


def test_orphans_keep_null_keys(spark):
    parent = spark.createDataFrame([(1,)], "pk int")
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "fk int, x string")
    assert sorted(r.x for r in I.orphans(parent, child, "pk", "fk").collect()) == ["b", "c"]


# ------------------------------------------------------------------ relationships

def test_relationship_properties(spark):
    tables = S.load_tables(spark, SF_MID)
    rel = REL.infer_relationships(spark, tables).cache()
    assert rel.where((F.col("overlap_ratio") < 0.8) | (F.col("uniqueness") < 0.9)).count() == 0
    assert rel.where(F.col("parent_table") == F.col("child_table")).count() == 0
    keys = {(r.parent_table, r.parent_col, r.child_table, r.child_col, r.sample_overlap) for r in rel.collect()}
    for expected in [("orders", "o_orderkey", "lineitem", "l_orderkey", 14743),
                     ("customer", "c_custkey", "orders", "o_custkey", 1500),
                     ("region", "r_regionkey", "nation", "n_regionkey", 5),
                     ("documents", "doc_id", "labels", "doc_id", 399)]:
        assert expected in keys
    assert rel.count() == 177


def test_long_values_compare_by_digest(spark):
    long_text = "x" * 500
    a = spark.createDataFrame([(long_text,), ("short",)], "v string")
    b = spark.createDataFrame([(long_text,), ("short",), ("other",)], "w string")
    rel = REL.infer_relationships(spark, {"a": a, "b": b}, 0.8, 0.5)
    got = {(r.child_table, r.sample_overlap) for r in rel.collect()}
    assert ("a", 2) in got


def test_ddl_best_only_dedupes_constraint_names(spark):
    rel = spark.createDataFrame(
        [("p1", "id", "c", "fk", 1.0), ("p2", "id", "c", "fk", 0.95)],
        "parent_table string, parent_col string, child_table string, child_col string, confidence double")
    assert REL.fk_ddl(rel, 0.9).count() == 2
    assert REL.fk_ddl(rel, 0.9, best_only=True).count() == 1
    lines = [r.line for r in REL.ddl_script_lines(REL.fk_ddl(rel, 0.9)).collect()]
    assert lines[0].startswith("-- Confidence: 100.0%") and lines[2] == ""


# ------------------------------------------------------------------ files and plans

def test_ledger_append_is_idempotent(spark):
    path = scratch_path(spark, "ledger_t")
    ids = spark.createDataFrame([(" a ",), ("b",), ("b",), ("",)], "identifier string")
    W.ledger_append(spark, ids, path)
    out = W.ledger_append(spark, ids, path)
    assert sorted(r.identifier for r in out.collect()) == ["a", "b"]


def test_pending_and_ledger_are_disjoint(spark):
    inv = inv_frame(spark, SF_SMALL)
    man = P.manifest(inv, literal_ts("2024-01-01 12:00:00"))
    ledger = man.where(F.col("dir").contains("client1")).select("identifier")
    pend = P.pending(man, ledger)
    assert pend.join(ledger, "identifier").count() == 0
    assert pend.count() + ledger.distinct().count() == man.count()


def test_dynamic_overwrite_keeps_other_partitions(spark):
    path = scratch_path(spark, "dyn")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    W.write(df, path, partition_by=["k"])
    W.write(spark.createDataFrame([(9, "a")], "v int, k string"), path, partition_by=["k"], dynamic=True)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_session_dirs_prefix_names(spark):
    inv = spark.createDataFrame([
        ("/logs/prod/alpha/alpha-user-1/x.log.gz", 1),
        ("/logs/prod/alpha-regional/alpha-regional-user-2/y.log.gz", 1),
        ("/logs/prod/alpha/other/z.log.gz", 1),
    ], "path string, length long").withColumn("mtime", literal_ts("2024-01-01 00:00:00"))
    ws = spark.createDataFrame([("alpha",)], "workspace string")
    dirs = [r.dir for r in P.session_dirs(inv, "/logs/prod", ws).collect()]
    assert dirs == ["/logs/prod/alpha/alpha-user-1"]


def test_route_numbers_bands(spark):
    lines = spark.createDataFrame([(x,) for x in
                                   ["", "  ", " 5 ", "-7", "999", "1000", "1999", "2000", "2999", "3000", "abc", "12x"]],
                                  "value string")
    got = {r.line: (r.code, r.reason) for r in RT.route_numbers(lines, "/b").collect()}
    assert got["5"] == ("0", None) and got["-7"] == ("0", None) and got["999"] == ("0", None)
    assert got["1000"] == ("1", None) and got["1999"] == ("1", None)
    assert got["2000"] == ("2", None) and got["2999"] == ("2", None)
    assert got["3000"] == (None, "out of range") and got["abc"] == (None, "not a number")
    assert len(got) == 10


def test_route_projects_reference_sample(spark):
    rows = [("alice", "Giga_Plan", "1001"), ("bob", "Beta_Initiative", "102"), ("x", "Big", "12000"),
            ("y", "Bad", "n/a")]
    mapping = spark.createDataFrame(rows, "username string, project_name string, project_id string")
    existing = spark.createDataFrame([("/src/0",)], "dir string")
    got = {r.project_id: (r.band, r.action, r.target) for r in
           RT.route_projects(mapping, 9999, "/src", "/dst", existing).collect()}
    assert got == {1001: (1, "warn_missing_source", "/dst/alice/Giga_Plan/1001"),
                   102: (0, "copy", "/dst/bob/Beta_Initiative/102"),
                   None: (None, "reject_not_a_number", None), 12000: (None, "reject_above_limit", None)}


def test_inventory_lists_one_level_and_recursive(spark):
    base = scratch_path(spark, "inv_t")
    spark.range(10).write.parquet(f"{base}/top")
    spark.range(10).select("id", (F.col("id") % 3).alias("b")).write.partitionBy("b").parquet(f"{base}/deep")
    from strata.sources.inventory import inventory
    rec = inventory(spark, [f"{base}/top", f"{base}/deep"]).count()
    one = inventory(spark, [f"{base}/top", f"{base}/deep"], recursive=False).count()
    assert rec > one > 0
    assert all(not r.path.startswith("file:") for r in inventory(spark, f"{base}/top").collect())


def test_compaction_preserves_rows(spark):
    src, dst = scratch_path(spark, "sf_src"), scratch_path(spark, "sf_dst")
    df = spark.range(2000).select((F.col("id") * 3).alias("k"))
    W.small_files(df, src, "bucket", 7, "k")
    W.compact(spark, src, dst, target_bytes=1 << 20, partition_by=["bucket"])
    back = spark.read.parquet(dst)
    assert back.count() == 2000
    assert back.agg(F.sum("k")).first()[0] == df.agg(F.sum("k")).first()[0]


def test_temp_output_removed_on_failure(spark):
    kept = {}
    with pytest.raises(RuntimeError):
        with temp_output(spark, "boom") as p:
            spark.range(3).write.parquet(p)
            kept["p"] = p
            raise RuntimeError("fail")
    assert not path_exists(spark, kept["p"])


def test_fan_out_counts_once_per_sink(spark):
    base = scratch_path(spark, "fan")
    n = W.fan_out(spark.range(50), [(f"{base}/a", "parquet"), (f"{base}/b", "orc"),
                                     (f"{base}/c", "csv", {"header": True})])
    assert n == 50 and spark.read.orc(f"{base}/b").count() == 50


# ------------------------------------------------------------------ cleaning, documents, synth

def test_clean_csv_dir_drift(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text("id,user,email,extra\n1,Ann,a@x.com,9\n2,Bob,,9\n")
    (d / "b.csv").write_text("user,id\nCid,3\n,\n")
    (d / "c.csv").write_text("other\nz\n")
    rows, stats = CL.clean_csv_dir(spark, str(d), ["id", "user", "email"])
    got = sorted((r.id, r.user, r.email) for r in rows.collect())
    assert got == [("1", "Ann", "a@x.com"), ("2", "Bob", None), ("3", "Cid", None)]
    st = {os.path.basename(r.file): (r.rows_in, r.rows_out, r.columns_removed, list(r.missing))
          for r in stats.collect()}
    assert st["a.csv"] == (2, 2, 1, [])
    assert st["b.csv"] == (2, 1, 0, ["email"])
    assert st["c.csv"] == (1, 0, 1, ["id", "user", "email"])


def test_upsert_replaces_and_keeps(spark):
    target = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep")], "id int, t int, body string")
    new = spark.createDataFrame([(1, 5, "new"), (1, 3, "mid"), (3, 1, "add")], "id int, t int, body string")
    out = {r.id: r.body for r in DOC.upsert_documents(target, new, "id", ["t"]).collect()}
    assert out == {1: "new", 2: "keep", 3: "add"}
    status = {r.status: r.n for r in DOC.load_status(target, new, "id").collect()}
    assert status == {"replaced": 1, "inserted": 1, "superseded": 1}


def test_synth_is_deterministic(spark):
    a = SY.synth_measures(spark, 500, 4, seed=3).collect()
    b = SY.synth_measures(spark, 500, 4, seed=3).collect()
    assert a == b
    assert sorted(a) == sorted(SY.synth_measures(spark, 500, 9, seed=3).collect())  # whatever the partitions
    assert sorted(a) == sorted(SY.with_measures(spark.range(500).repartition(3, "id"), seed=3).collect())
    assert len({r.value for r in a}) == 500 and SY.synth_measures(spark, 500, 4, seed=4).collect() != a
    spread = SY.with_measures(spark.range(20_000), max_val=1.0).agg(F.avg("value"), F.stddev("value"), F.corr("id", "value")).first()
    assert abs(spread[0] - 0.5) < 0.01 and abs(spread[1] - 12 ** -0.5) < 0.01 and abs(spread[2]) < 0.03
    users = SY.synth_users(spark, 100)
    assert users.count() == 100 and users.select("id").distinct().count() == 100


def test_hash_sample_is_stable(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    s1 = R.hash_sample(df, "k", 10).count()
    assert 800 < s1 < 1200 and s1 == R.hash_sample(df, "k", 10).count()


# ------------------------------------------------------------------ plans

def test_partition_filters_reach_the_scan(spark):
    path = scratch_path(spark, "pruned")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("event_type").alias("category"), F.to_date("ts").alias("date"), "value")
    W.write(ev, path, partition_by=["category", "date"])
    out = R.daily_metrics(spark.read.parquet(path), "category", "click", "date", "2024-01-10", "value", "value")
    plan = plan_text(out)
    assert "PartitionFilters: [isnotnull(category" in plan and "(date" in plan


def test_top_n_is_take_ordered(spark):
    out = QUERIES["top_parents"](spark, SF_SMALL)
    assert "TakeOrderedAndProject" in plan_text(out)


def test_pushed_filter_and_pruned_schema(spark):
    out = QUERIES["daily_metrics"](spark, SF_SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan or "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_attempt_outcomes(spark):
    log = spark.createDataFrame(
        [("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("c", 1, True),
         ("d", 4, True)], "item string, attempt int, ok boolean")
    got = {r.item: (r.status, r.attempts) for r in P.attempt_outcomes(log).collect()}
    assert got == {"a": ("uploaded", 2), "b": ("failed", 3), "c": ("uploaded", 1), "d": ("failed", 0)}


def test_export_relationships_and_ddl_script(spark):
    rel = REL.infer_relationships(spark, S.load_tables(spark, SF_SMALL, ["region", "nation"]))
    path = REL.export_relationships(rel, scratch_path(spark, "rel_csv"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == REL.RELATIONSHIP_COLUMNS and back.count() == rel.count()
    lines = W.write_lines(REL.ddl_script_lines(REL.fk_ddl(rel)), scratch_path(spark, "ddl"), "line")
    assert any("ALTER TABLE nation ADD CONSTRAINT" in r.value for r in spark.read.text(lines).collect())


def test_binary_file_watch_lists_each_file_once(spark):
    from strata.streaming.watch import read_watch, run_watch, watch
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("inbox_b", "out_b", "ckpt_b"))
    spark.range(30).select(F.col("id").cast("string").alias("value")).repartition(3).write.text(f"{inbox}/a")
    stream = watch(spark, inbox, glob="*.txt").select("path", "length")
    run_watch(stream, out, ckpt, once=True).awaitTermination()
    first = read_watch(spark, out).count()
    spark.range(5).select(F.col("id").cast("string").alias("value")).write.text(f"{inbox}/b")
    run_watch(watch(spark, inbox, glob="*.txt").select("path", "length"), out, ckpt, once=True).awaitTermination()
    rows = read_watch(spark, out)
    assert first == 3 and rows.count() == first + rows.where(F.col("path").contains("/b/")).count()
    assert rows.select("path").distinct().count() == rows.count()


def test_admit_ticks_admit_each_file_once(spark):
    from strata.streaming.admit import admit_tick
    inv = spark.createDataFrame([("/a", 1), ("/b", 1), ("/c", 1)], "path string, length long").withColumn(
        "mtime", F.expr("timestampadd(HOUR, cast(length as int) * 0, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
        + F.expr("make_dt_interval(0, CASE path WHEN '/a' THEN 0 WHEN '/b' THEN 3 ELSE 9 END, 0, 0)"))
    ledger = scratch_path(spark, "admit_t")
    t1 = admit_tick(spark, inv, ledger, 5, "2024-01-01 06:00:00").collect()
    t2 = admit_tick(spark, inv, ledger, 5, "2024-01-01 09:00:00").collect()
    t3 = admit_tick(spark, inv, ledger, 5, "2024-01-01 09:00:00").collect()
    assert [r.path for r in t1] == ["/a"] and [r.path for r in t2] == ["/b"] and t3 == [r for r in t2]
    assert spark.read.parquet(ledger).count() == 2


def test_stateful_age_gate_admits_young_files_later(spark, tmp_path):
    import time as _t
    from strata.streaming.admit import admit_stream
    from strata.streaming.watch import watch
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    now = _t.time()
    for name, mtime in (("old1.gz", 1_700_000_000), ("old2.gz", 1_700_000_100), ("young.gz", now + 3)):
        f = inbox / name
        f.write_text(name)
        os.utime(f, (mtime, mtime))
    out, ckpt = scratch_path(spark, "gate_out"), scratch_path(spark, "gate_ckpt")
    gated = admit_stream(watch(spark, str(inbox), glob="*.gz"), hours=2 / 3600)  # 2 seconds
    q = (gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(processingTime="1 second").start())
    try:
        deadline = _t.time() + 60
        rows = []
        while _t.time() < deadline:
            _t.sleep(2)
            if path_exists(spark, out):
                rows = spark.read.schema("path string, mtime_ms long, admitted_ms long").parquet(out).collect()
                if any(r.path.endswith("young.gz") for r in rows):
                    break
    finally:
        q.stop()
    by_name = {os.path.basename(r.path): r for r in rows}
    assert len(rows) == 3 and set(by_name) == {"old1.gz", "old2.gz", "young.gz"}
    assert by_name["young.gz"].admitted_ms > by_name["young.gz"].mtime_ms + 2000
    assert by_name["young.gz"].admitted_ms > by_name["old1.gz"].admitted_ms


def test_admitted_paths_are_forgotten_in_time(spark, tmp_path):
    """State rows fall to zero once what was admitted has expired."""
    import time as _t
    from strata.streaming.admit import admit_stream
    from strata.streaming.watch import watch
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(4):
        (inbox / f"f{i}.gz").write_text("x")
        os.utime(inbox / f"f{i}.gz", (1_700_000_000, 1_700_000_000))
    gated = admit_stream(watch(spark, str(inbox), glob="*.gz"), hours=1 / 3600, remember_hours=4 / 3600)
    q = (gated.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "ttl_ckpt"))
         .trigger(processingTime="1 second").start())
    try:
        seen, deadline = [], _t.time() + 90
        while _t.time() < deadline and not (max(seen, default=0) >= 4 and seen[-1] == 0):
            _t.sleep(1)
            seen = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p.get("stateOperators")]
    finally:
        q.stop()
    assert max(seen) >= 4 and seen[-1] == 0, seen


def test_info_and_preview(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "c")], "a int, b string")
    got = {(r.column, r.type, r.non_null) for r in CL.info(df).collect()}
    assert got == {("a", "int", 2), ("b", "string", 2)}
    assert CL.preview(df, 2).count() == 2


def test_timed_steps_as_table(spark):
    from strata.session import timed, timings_frame
    n, rec = timed("count", lambda: spark.range(10).count())
    assert n == 10 and rec[0] == "count" and rec[2] == 10 and rec[1] >= 0
    assert timings_frame(spark, [rec]).columns == ["step", "seconds", "rows"]


def test_subdirectories_and_requested_dirs(spark):
    from strata.sources.inventory import check_requested, subdirectories
    inv = spark.createDataFrame([("/b/0/c1/x.gz", 1), ("/b/0/c2/y.gz", 1), ("/b/1/c1/z/w.gz", 1)],
                                "path string, length long")
    subs = sorted(r.dir for r in subdirectories(inv, ["/b/0", "/b/1"]).collect())
    assert subs == ["/b/0/c1", "/b/0/c2", "/b/1/c1"]
    req = spark.createDataFrame([("/b/0",), ("/b/1/",), ("/b/9",)], "dir string")
    got = {r.dir: r.status for r in check_requested(spark, req, inv).collect()}
    assert got == {"/b/0": "found", "/b/1": "found", "/b/9": "invalid"}


def test_mapping_csv_routes_by_band(spark, tmp_path):
    rows = ["username,project_name,project_id"]
    rows += [f"u{i},P{i},{1000 + i}" for i in range(1, 11)] + [f"u{i},Q{i},{100 + i}" for i in range(1, 11)]
    (tmp_path / "map.csv").write_text("\n".join(rows) + "\n")
    mapping = S.read_csv(spark, str(tmp_path / "map.csv"),
                         schema="username string, project_name string, project_id string")
    existing = spark.createDataFrame([("/src/0",), ("/src/1",)], "dir string")
    plan = RT.route_projects(mapping, 9999, "/src", "/dst", existing)
    bands = {r.band: r.n for r in plan.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert bands == {0: 10, 1: 10} and plan.where("action = 'copy'").count() == 20


def test_synth_fixtures_shapes(spark):
    p2 = SY.synth_two_categories(spark, 1000, 4)
    assert set(p2.columns) == {"id", "rand1", "rand2", "category"}
    assert {r.category for r in p2.select("category").distinct().collect()} <= {"A", "B"}
    p3 = SY.synth_partitioned(spark, 1000, 4, days=30)
    span = p3.agg(F.datediff(F.max("date"), F.min("date")).alias("d")).first().d
    assert 0 <= span < 30
    m = SY.synth_measures(spark, 260, 2, columns=("id", "category", "value"))
    assert m.columns == ["id", "category", "value"]
    assert m.agg(F.min("category"), F.max("category")).first() [0] >= 1


def test_partitioned_generation_write_is_salted(spark):
    df = SY.synth_partitioned(spark, 2000, 4, days=5)
    out = W.cluster_for_write(df, ["category", "date"], 8, spread=4)
    plan = plan_text(out)
    assert "hashpartitioning(category" in plan and "_salt" in plan


def test_backup_commit_then_replay_skips_everything(spark):
    inv = inv_frame(spark, SF_SMALL)
    bases = [f"/var/tmp/projects/{i}" for i in range(11)]
    ledger_path, now = scratch_path(spark, "bk_ledger"), literal_ts("2024-01-01 12:00:00")
    empty = spark.createDataFrame([], "identifier string")
    plan1 = P.backup_plan(inv, bases, empty, now)
    n_dirs = plan1.count()
    ledger = P.commit_backup(spark, plan1, scratch_path(spark, "bk_plan1"), ledger_path)
    assert ledger.count() == n_dirs
    plan2 = P.backup_plan(inv, bases, spark.read.parquet(ledger_path), now)
    assert plan2.where("status = 'planned'").count() == 0
    ledger2 = P.commit_backup(spark, plan2, scratch_path(spark, "bk_plan2"), ledger_path)
    assert ledger2.count() == n_dirs


def test_upload_plan_dir_name_rule_one_level(spark):
    inv = spark.createDataFrame([
        ("/w/a/x.gz", 5), ("/w/a/deep/y.gz", 5), ("/w/a/z.log", 5), ("/w/b/e.gz", 0),
    ], "path string, length long").withColumn("mtime", literal_ts("2024-01-01 00:00:00"))
    watch = spark.createDataFrame([("/w/a",), ("/w/b/",)], "dir string")
    got = {r.path: (r.object_key, r.action) for r in
           P.upload_plan(inv, watch, 1, literal_ts("2024-01-02 00:00:00"), "up", key_rule="dir_name",
                         recursive=False).collect()}
    assert got == {"/w/a/x.gz": ("up/a/x.gz", "upload"), "/w/b/e.gz": ("up/b/e.gz", "skip_empty")}


def test_push_documents_last_row_wins_and_counts(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,name,score\n1,a,10\n2,b,20\n1,c,30\n")
    rows = S.read_csv(spark, str(tmp_path / "d.csv"), infer=True)
    out1, out2 = scratch_path(spark, "push1"), scratch_path(spark, "push2")
    st1 = {r.status: r.n for r in DOC.push_documents(spark, rows, None, out1, "id",
                                                     literal_ts("2024-01-01 00:00:00")).collect()}
    docs = {r._id: r.doc.name for r in spark.read.parquet(out1).collect()}
    assert docs == {"1": "c", "2": "b"} and st1 == {"inserted": 2, "replaced": 0, "superseded": 1}
    more = spark.createDataFrame([(2, "z", 1), (3, "n", 2)], "id int, name string, score int")
    st2 = {r.status: r.n for r in DOC.push_documents(spark, more, out1, out2, "id",
                                                     literal_ts("2024-01-02 00:00:00")).collect()}
    assert st2 == {"replaced": 1, "inserted": 1, "superseded": 0}
    assert {r._id: r.doc.name for r in spark.read.parquet(out2).collect()} == {"1": "c", "2": "z", "3": "n"}
    noid = DOC.as_documents(more.drop("id"), None)
    assert noid.select("_id").distinct().count() == 2


def test_process_csv_folder_writes_outputs(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("id,user\n1,Ann\n,\n")
    (d / "b.csv").write_text("user,email\nBo,b@x\n")
    out = scratch_path(spark, "processed")
    stats, summary = CL.process_csv_folder(spark, str(d), out, ["id", "user", "email"])
    s = summary.first()
    assert (s.files_ok, s.files_total, s.rows_out) == (2, 2, 2) and s.seconds_per_file >= 0
    back = spark.read.option("header", True).csv(out)
    assert sorted(r.source_file for r in back.select("source_file").distinct().collect()) == [
        "processed_a.csv", "processed_b.csv"]


def test_sync_plan_excludes_patterns(spark):
    src = spark.createDataFrame([("/s/1/a.gz", 1), ("/s/1/b.tmp", 1), ("/s/2/c.log", 1)],
                                "path string, length long").withColumn("mtime", literal_ts("2024-01-01 00:00:00"))
    dst = spark.createDataFrame([], "path string, length long, mtime timestamp_ntz")
    got = [r.rel for r in P.sync_plan(src, dst, "/s", "/d", exclude=["*.tmp", "*.log"]).collect()]
    assert got == ["1/a.gz"]


def test_generated_insight_sql_runs(spark):
    tables = S.load_tables(spark, SF_SMALL)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    texts = I.insight_queries(REL.infer_relationships(spark, tables), 6).collect()
    assert len(texts) == 3 * len({(r.parent_table, r.child_table) for r in texts})
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    try:
        for r in texts:
            assert r.sql.startswith("-- ")
            out = spark.sql(r.sql)
            assert out.count() <= (5 if r.kind == "top_parents" else 10)
    finally:
        spark.conf.unset("spark.sql.ansi.doubleQuotedIdentifiers")


def test_watch_skips_missing_directories(spark, tmp_path):
    from strata.streaming.watch import read_watch, run_watch, split_existing, watch
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.gz").write_text("x")
    ok, missing = split_existing(spark, [str(good), str(tmp_path / "nope")])
    assert ok == [str(good)] and missing == [str(tmp_path / "nope")]
    out, ckpt = scratch_path(spark, "wm_out"), scratch_path(spark, "wm_ckpt")
    stream = watch(spark, [str(good), str(tmp_path / "nope")], glob="*.gz").select("path", "length")
    run_watch(stream, out, ckpt, once=True).awaitTermination()
    assert read_watch(spark, out).count() == 1


def test_name_hint_ranks_but_never_filters(spark):
    tables = S.load_tables(spark, SF_MID)
    plain = REL.infer_relationships(spark, tables)
    hinted = REL.infer_relationships(spark, tables, name_hint=True)
    assert hinted.count() == plain.count() == 177
    top = [(r.child_table, r.child_col, r.parent_table, r.parent_col) for r in hinted.limit(12).collect()]
    for fk in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
               ("labels", "doc_id", "documents", "doc_id")]:
        assert fk in top or hinted.where(
            (F.col("child_col") == fk[1]) & (F.col("parent_col") == fk[3])).first().name_match == 1


def test_watch_archives_handled_files(spark, tmp_path):
    import time as _t
    from strata.streaming.watch import read_watch, run_watch, watch
    inbox, archive = tmp_path / "in", tmp_path / "archive"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"f{i}.gz").write_text(str(i))
    out, ckpt = scratch_path(spark, "arch_out"), scratch_path(spark, "arch_ckpt")
    stream = watch(spark, str(inbox), glob="*.gz", clean_source="archive",
                   archive_dir=str(archive)).select("path", "length")
    q = run_watch(stream, out, ckpt, every="1 second")

    def rows():
        return sum(p.get("numInputRows", 0) for p in q.recentProgress)

    try:
        deadline = _t.time() + 60
        while _t.time() < deadline and rows() < 3:
            _t.sleep(0.5)
        # the file source cleans a batch's files once the next batch runs
        (inbox / "late.gz").write_text("late")
        while _t.time() < deadline and (rows() < 4 or len(list(archive.rglob("f*.gz"))) < 3):
            _t.sleep(0.5)
    finally:
        q.stop()
    assert read_watch(spark, out).count() == 4
    assert sorted(p.name for p in archive.rglob("f*.gz")) == ["f0.gz", "f1.gz", "f2.gz"]
    assert not list(inbox.glob("f*.gz"))


def test_approx_profile_is_close_to_exact(spark):
    tables = S.load_tables(spark, SF_MID, ["orders", "customer", "lineitem"])
    exact = {(r.table_name, r.column_name): r.n_distinct
             for r in REL.column_profile(spark, tables).collect()}
    approx = {(r.table_name, r.column_name): r.n_distinct
              for r in REL.column_profile_approx(spark, tables, 0.02).collect()}
    assert set(exact) == set(approx)
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(2, 0.08 * v), (k, v, approx[k])


def test_ledger_keys_on_directory_not_joined_text(spark):
    inv = spark.createDataFrame([("/r/a_b/c/x.gz", 1), ("/r/a/b_c/y.gz", 1)], "path string, length long") \
        .withColumn("mtime", literal_ts("2024-01-01 00:00:00"))
    now = literal_ts("2024-01-01 12:00:00")
    empty = spark.createDataFrame([], "identifier string, dir string")
    plan = P.backup_plan(inv, ["/r/a_b", "/r/a"], empty, now)
    assert plan.select("identifier").distinct().count() == 1 and plan.count() == 2
    only_first = plan.where(F.col("dir") == "/r/a_b/c")
    ledger_path = scratch_path(spark, "collide_ledger")
    P.commit_backup(spark, only_first, scratch_path(spark, "collide_plan"), ledger_path)
    again = {r.dir: r.status for r in P.backup_plan(inv, ["/r/a_b", "/r/a"],
                                                     spark.read.parquet(ledger_path), now).collect()}
    assert again == {"/r/a_b/c": "skipped", "/r/a/b_c": "planned"}


def test_eligible_types_and_null_rows_in_uniqueness(spark):
    df = spark.createDataFrame([(1, "x", 1.5, True), (2, None, 2.5, False), (None, "y", None, None)],
                               "i int, s string, d double, b boolean").withColumn("ts", F.current_timestamp())
    assert REL.eligible_columns(df) == ["i", "s", "b"]
    prof = {r.column_name: (r.n_distinct, r.n_rows, r.uniqueness)
            for r in REL.column_profile(spark, {"t": df}).collect()}
    assert prof["i"] == (2, 3, 2 / 3) and prof["s"] == (2, 3, 2 / 3) and prof["b"] == (2, 3, 2 / 3)


def test_scale_conf_sizes_partitions():
    from strata.session import scale_conf
    conf = scale_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_path_helpers(spark):
    row = spark.createDataFrame([("/a/b/c.log.gz/",)], "p string").select(
        PT.basename("p").alias("base"), PT.dirname("p").alias("dir"), PT.extension("p").alias("ext"),
        PT.relative_to(F.lit("C:\\x\\y.gz"), "C:").alias("rel_win"),
        PT.relative_to(F.col("p"), "/a").alias("rel"), PT.relative_to(F.col("p"), "/z").alias("outside"),
        PT.object_key("pre", F.lit("b"), F.lit("c.gz")).alias("key"),
        PT.stamp_name(F.lit("3_client1"), literal_ts("2024-01-02 03:04:05"), ".zip").alias("stamp"),
        PT.minus_hours(literal_ts("2024-01-01 05:00:00"), 1.5).alias("earlier"),
    ).first()
    assert (row.base, row.dir, row.ext) == ("c.log.gz", "/a/b", "gz")
    assert row.rel_win == "x/y.gz" and row.rel == "b/c.log.gz/" and row.outside is None
    assert row.key == "pre/b/c.gz" and row.stamp == "3_client1_20240102_030405.zip"
    assert str(row.earlier) == "2024-01-01 03:30:00"


def test_generator_helpers(spark):
    from strata.functions import generators as G
    df = spark.range(0, 1000, 1, 4).select(
        G.letter_from_id("id").alias("l"), G.uniform_int(10, 1).alias("u"), G.pick(["x", "y"], 2).alias("p"),
        G.int_div(F.col("id") - 500, 100).alias("d"))
    r = df.agg(F.min("u"), F.max("u"), F.countDistinct("l"), F.countDistinct("p"), F.min("d"), F.max("d")).first()
    assert tuple(r) == (1, 10, 26, 2, -5, 4)


def test_period_counts_quotes_literals(spark):
    df = spark.createDataFrame([("o'brien", "2024-01-02"), ("x", "2024-01-02")], "category string, d string") \
        .select("category", F.to_date("d").alias("date"))
    out = R.period_counts(spark, df, "quoted_view", "o'brien", "2024-01-01", "2024-01-31").collect()
    assert [(str(r.date), r.total_transactions) for r in out] == [("2024-01-02", 1)]


def test_balanced_write_keeps_null_keys_and_splits_equal_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("k"), F.lit("same").alias("v"))
    out = W.balanced_by_key(df, ["k"])
    assert "Join" not in plan_text(out)
    path, dst = scratch_path(spark, "nullkeys"), scratch_path(spark, "nullkeys-compacted")
    W.write(out, path, partition_by=["k"], max_records_per_file=30)
    W.compact(spark, path, dst, target_bytes=1 << 20, partition_by=["k"])
    for p in (path, dst):
        back = {r.k: r["count"] for r in spark.read.parquet(p).groupBy("k").count().collect()}
        assert back == {None: 100, **{k: 100 for k in range(1, 10)}}
    hot = spark.range(0, 400_000, 1, 8).select(F.lit(1).alias("k"), F.lit("x" * 50).alias("v"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        many = W.balanced_by_key(hot, ["k"]).groupBy(F.spark_partition_id().alias("p")).count()
        assert many.count() > 1 and many.agg(F.sum("count")).first()[0] == 400_000
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_sums_and_averages_are_plain(spark):
    df = spark.createDataFrame([("a", 0.004)] * 10, "k string, v double")
    assert abs(R.group_sum(df, "k", "v").first()[1] - 0.04) < 1e-12
    r = R.group_stats(df, "k", "v").first()
    assert abs(r[1] - 0.004) < 1e-12 and abs(r[2] - 0.04) < 1e-12


def test_rows_without_id_are_documents_of_their_own(spark):
    rows = spark.createDataFrame([("1", "a"), (None, "b"), (None, "b")], "id string, body string")
    for id_col, n in (("id", 3), (None, 3)):
        out = scratch_path(spark, "noid")
        status = {r.status: r.n for r in DOC.push_documents(spark, rows, None, out, id_col, literal_ts("2024-01-01 00:00:00")).collect()}
        back = spark.read.parquet(out)
        assert back.count() == back.select("_id").distinct().count() == n == status["inserted"]
    kept = DOC.upsert_documents(None, rows, "id", ["body"])
    assert kept.count() == 3


def test_small_verdict_cases(spark):
    from strata.functions import generators as G
    from strata.functions.paths import minus_hours
    df = spark.createDataFrame([(9007199254740993,)], "n long")
    assert df.select(G.int_div(F.col("n"), 1)).first()[0] == 9007199254740993
    t = df.select(minus_hours(literal_ts("2024-01-01 00:00:00"), 0.005).cast("string")).first()[0]
    assert t == "2023-12-31 23:59:42"
    log = spark.createDataFrame([("a", 4, True), ("b", 2, True)], "item string, attempt int, ok boolean")
    assert {r.item: (r.status, r.attempts) for r in P.attempt_outcomes(log).collect()} == {"a": ("failed", 0), "b": ("uploaded", 2)}
    path = scratch_path(spark, "ledger-nulls")
    new = spark.createDataFrame([("x", None), ("y", "d")], "identifier string, dir string")
    for _ in range(2):
        n = W.ledger_append(spark, new, path, extra=["dir"]).count()
    assert n == 2
    skipped = {}
    assert S.load_tables(spark, "/nowhere", ["nope"], skipped=skipped) == {} and skipped == {"nope": "PATH_NOT_FOUND"}


def test_backup_plan_takes_many_bases_as_a_table(spark):
    inv = spark.createDataFrame([(f"/b{k}/sub/f{j}", 10) for k in (7, 4999) for j in range(3)] + [("/b7/top", 5)],
                                "path string, length long").withColumn("mtime", literal_ts("2024-01-01 00:00:00"))
    ledger = spark.createDataFrame([("b7_sub",)], "identifier string")
    plan = P.backup_plan(inv, [f"/b{k}" for k in range(5000)], ledger, literal_ts("2024-01-02 00:00:00"), multipart_bytes=30)
    assert {r.dir: (r.n_files, r.total_bytes, r.size_class, r.status) for r in plan.collect()} == {
        "/b7/sub": (3, 30, "multipart", "skipped"), "/b4999/sub": (3, 30, "multipart", "planned")}


def test_csv_quotes_newlines_empty_and_unreadable_files(spark, tmp_path):
    d = tmp_path / "my csv"
    (d / "deep").mkdir(parents=True)
    (d / "a b.csv").write_text('"a,b",id,name\n1,7,bob\n2,8,"two\nlines, ""quoted"""\n')
    (d / "empty.csv").write_text("")
    (d / "bare.csv").write_text("id,name\n")
    (d / "twice.csv").write_text("id,id,\n5,6,7\n")
    (d / "deep" / "a b.csv").write_text("id\n9\n")
    rows, stats = CL.clean_csv_dir(spark, str(d), ["id", "name"])
    assert sorted((r.id, r.name) for r in rows.collect()) == [("5", None), ("7", "bob"), ("8", 'two\nlines, "quoted"')]
    got = {os.path.basename(r.file): (r.rows_in, r.rows_out, r.status) for r in stats.collect()}
    assert got == {"a b.csv": (2, 2, "ok"), "empty.csv": (0, 0, "empty"), "bare.csv": (0, 0, "ok"), "twice.csv": (1, 1, "error")}
    assert tuple(CL.run_summary(stats).first())[:3] == (2, 4, 3)
    rows, stats = CL.clean_csv_dir(spark, str(d), ["id"], recursive=True)
    assert stats.count() == 5 and "9" in {r.id for r in rows.collect()}
    out = scratch_path(spark, "processed-deep")
    CL.process_csv_folder(spark, str(d), out, ["id"], recursive=True)
    names = {r.source_file for r in spark.read.option("header", True).csv(out).select("source_file").distinct().collect()}
    assert names == {"processed_a b.csv", "processed_twice.csv", "processed_deep__a b.csv"}
