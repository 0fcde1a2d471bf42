"""Query keys that go through storage: round trips, catalog, inventories,
plans, routing, cleaning, keyed load, packing and streaming.

Intermediate data is written under the checkpoint root (``spark.checkpoint.dir``
on a cluster), in a fresh folder per call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import generators as G
from strata.functions.paths import basename, dirname, extension, minus_hours, object_key
from strata.operators import cleaning as CL
from strata.operators import documents as DOC
from strata.operators import keyed_table as KT
from strata.operators import relational as R
from strata.plans import files as P
from strata.plans import routing as RT
from strata.registry import T, events_by_day, query
from strata.session import literal_ts, scratch_path
from strata.sinks import bundles as B
from strata.sinks import compaction as CO
from strata.sinks import writers as W
from strata.sources import files as S
from strata.sources import synth as SY
from strata.sources.inventory import inventory
from strata.streaming.admit import admit_tick
from strata.streaming.watch import read_watch, run_watch, watch

# ---------------------------------------------------------------- round trips


@query("partition_roundtrip", """
SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id
""")
def q_partition_roundtrip(spark, sf):
    path = scratch_path(spark, "events_by_type_day")
    ev = events_by_day(spark, sf)
    W.write(W.balanced_by_key(ev, ["category", "date"]), path, partition_by=["category", "date"],
            max_records_per_file=1_000_000)
    back = spark.read.parquet(path)
    return back.where(F.col("category") == "purchase").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("dynamic_overwrite", """
SELECT event_type, count(*) AS n FROM events
WHERE event_type <> 'view' OR value > 250 GROUP BY event_type
""")
def q_dynamic_overwrite(spark, sf):
    path = scratch_path(spark, "events_by_type")
    ev = T(spark, sf, "events")
    W.write(ev, path, partition_by=["event_type"])
    subset = spark.read.parquet(path).where((F.col("event_type") == "view") & (F.col("value") > 250))
    staged = scratch_path(spark, "view_subset")
    W.write(subset, staged, partition_by=["event_type"])  # never overwrite what is being read
    W.write(spark.read.parquet(staged), path, partition_by=["event_type"], dynamic=True)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


NATION_SCHEMA = "n_nationkey INT, n_name STRING, n_regionkey INT"


@query("format_roundtrip", """
SELECT f.fmt, n.n_nationkey, n.n_name, n.n_regionkey FROM nation n
CROSS JOIN (VALUES ('parquet'), ('orc'), ('csv_header'), ('csv_plain')) f(fmt)
""")
def q_format_roundtrip(spark, sf):
    base = scratch_path(spark, "formats")
    nation = T(spark, sf, "nation")
    W.fan_out(nation, [
        (f"{base}/parquet", "parquet"),
        (f"{base}/orc", "orc"),
        (f"{base}/csv_header", "csv", {"header": True}),
        (f"{base}/csv_plain", "csv", {"header": False}),
    ])
    reads = {
        "parquet": S.read(spark, f"{base}/parquet", "parquet"),
        "orc": S.read(spark, f"{base}/orc", "orc"),
        "csv_header": S.read_csv(spark, f"{base}/csv_header", infer=True),
        "csv_plain": S.read_csv(spark, f"{base}/csv_plain", schema=NATION_SCHEMA, header=False),
    }
    out = None
    for fmt, df in reads.items():
        typed = df.select(F.lit(fmt).alias("fmt"), F.col("n_nationkey").cast("int").alias("n_nationkey"),
                          F.col("n_name").cast("string").alias("n_name"),
                          F.col("n_regionkey").cast("int").alias("n_regionkey"))
        out = typed if out is None else out.unionByName(typed)
    return out


ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


@query("join_formats", """
SELECT a.*, b.o_custkey AS o_custkey_csv, b.o_orderstatus AS o_orderstatus_csv,
       b.o_totalprice AS o_totalprice_csv, b.o_orderdate AS o_orderdate_csv,
       b.o_orderpriority AS o_orderpriority_csv
FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey
""")
def q_join_formats(spark, sf):
    path = scratch_path(spark, "orders_csv")
    orders = T(spark, sf, "orders")
    W.write(orders, path, "csv", header=False)
    csv_copy = S.read_csv(spark, path, schema=ORDERS_SCHEMA, header=False)
    return R.join_formats(orders, csv_copy, "o_orderkey", "_csv")


@query("catalog_roundtrip", """
SELECT o_orderkey AS id, o_totalprice AS value, 1 AS category FROM orders WHERE o_orderstatus = 'F'
""")
def q_catalog_roundtrip(spark, sf):
    base = scratch_path(spark, "catalog")
    db = "strata_db"
    W.ensure_db(spark, db, location=f"{base}/{db}.db", use=False)
    table = f"{db}.orders_by_status_{base[-12:]}"
    W.ensure_table(spark, table, "id BIGINT, value DOUBLE, category INT", ["category"],
                   location=f"{base}/orders_by_status")
    orders = T(spark, sf, "orders")
    for code, status in ((1, "F"), (2, "O"), (3, "P")):
        W.insert_partition(spark, table, {"category": code},
                           orders.where(F.col("o_orderstatus") == status)
                           .select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")))
    W.repair(spark, table)
    return spark.sql(f"SELECT id, value, category FROM {table} WHERE category = 1")


@query("catalog_plain_table", """
SELECT p_partkey AS id, p_name AS name, p_partkey % 2 = 0 AS again FROM part
UNION ALL SELECT p_partkey, p_name, true FROM part WHERE p_partkey % 2 = 0
""")
def q_catalog_plain_table(spark, sf):
    """An unpartitioned catalog table, made once, filled by two inserts; repair has nothing to do."""
    base = scratch_path(spark, "plain")
    table = f"plain_{base[-12:].replace('-', '_')}"
    part = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    for _ in range(2):
        W.ensure_table(spark, table, "id BIGINT, name STRING", location=f"{base}/t")
    part.write.insertInto(table)
    assert not W.repair(spark, table)
    part.where("id % 2 = 0").write.insertInto(table)
    return spark.table(table).select("id", "name", (F.col("id") % 2 == 0).alias("again"))


@query("round_robin_write", """
SELECT o_orderkey, o_custkey FROM orders
""")
def q_round_robin_write(spark, sf):
    """Unpartitioned compaction: rows dealt out in turn over as many files as the bytes fill."""
    src, dst = scratch_path(spark, "many_files"), scratch_path(spark, "few_files")
    orders = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    W.write(orders.repartition(9, "o_custkey"), src)
    W.compact(spark, src, dst, target_bytes=32 << 10)
    return spark.read.parquet(dst)


@query("null_key_write", """
SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS quality, count(*) AS n, CAST(sum(d.doc_id) AS BIGINT) AS id_sum
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def q_null_key_write(spark, sf):
    """Partitioned write and compaction by a column with NULLs."""
    src, dst = scratch_path(spark, "by_quality"), scratch_path(spark, "by_quality_compacted")
    docs = T(spark, sf, "documents").join(T(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    W.write(W.balanced_by_key(docs, ["quality"]), src, partition_by=["quality"], max_records_per_file=1_000_000)
    W.compact(spark, src, dst, target_bytes=1 << 20, partition_by=["quality"])
    back = spark.read.schema(docs.schema).parquet(dst)
    label = F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality")
    return back.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").cast("long").alias("id_sum"))


@query("small_files_compact", """
SELECT o_orderkey % 20 AS file_no, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1
""")
def q_small_files_compact(spark, sf):
    src = scratch_path(spark, "small_files")
    dst = scratch_path(spark, "compacted")
    orders = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    W.small_files(orders, src, "file_no", 20, "o_orderkey")
    W.compact(spark, src, dst, target_bytes=1 << 20, partition_by=["file_no"])
    back = spark.read.parquet(dst)
    return back.groupBy(F.col("file_no").cast("long").alias("file_no")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("key_sum"))


@query("pack_bundles", """
SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY source
""")
def q_pack_bundles(spark, sf):
    path = scratch_path(spark, "bundles")
    W.pack(T(spark, sf, "documents"), path, "source", codec="zstd")
    back = spark.read.parquet(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum("n_chars").cast("long").alias("total_chars"))


@query("bundle_files", """
SELECT source, CAST(ceil(sum(strlen(text)) / 200000.0) AS BIGINT) AS n_files, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY source
""")
def q_bundle_files(spark, sf):
    """One bundle a source, in parts of 200,000 bytes of text."""
    path = scratch_path(spark, "bundle_files")
    B.pack_bundles(T(spark, sf, "documents"), path, "source", [F.col("doc_id")], 200_000, size=F.octet_length("text").cast("long"))
    back = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    return back.groupBy("source").agg(F.countDistinct("_file").alias("n_files"), F.count(F.lit(1)).alias("n_docs"),
                                      F.sum("n_chars").cast("long").alias("total_chars"))


@query("compact_in_place", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, 1 AS n_files FROM orders GROUP BY o_orderstatus
""")
def q_compact_in_place(spark, sf):
    """Many small files a folder, compacted where they are."""
    path = scratch_path(spark, "compact_in_place")
    orders = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    with W.open_writers(spark, 8):  # a folder for each of a few statuses
        W.write(orders.repartition(12, "o_orderkey"), path, partition_by=["o_orderstatus"])
    CO.compact_in_place(spark, path)
    back = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("key_sum"),
                                             F.countDistinct("_file").cast("int").alias("n_files"))


@query("inventory_scan", """
SELECT 'recursive' AS scope, 'txt' AS ext, count(DISTINCT lang) AS n_dirs FROM documents
UNION ALL SELECT 'recursive', 'csv', 1
UNION ALL SELECT 'one_level', 'csv', 1
""")
def q_inventory_scan(spark, sf):
    base = scratch_path(spark, "tree")
    docs = T(spark, sf, "documents")
    W.write(docs.select("text", "lang"), f"{base}/b1", "text", partition_by=["lang"])
    W.write(docs.select("doc_id", "source"), f"{base}/b2", "csv", header=True)
    bases = [f"{base}/b1", f"{base}/b2"]
    out = None
    for scope, rec in (("recursive", True), ("one_level", False)):
        inv = inventory(spark, bases, recursive=rec)
        part = inv.groupBy(extension("path").alias("ext")).agg(
            F.countDistinct(dirname("path")).alias("n_dirs")).select(F.lit(scope).alias("scope"), "ext", "n_dirs")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- generated columns over given ids


def _unit_sql(seed: int, at: str = "id") -> str:
    return f"(('0x' || md5('{seed}:' || CAST({at} AS VARCHAR))[1:13])::BIGINT / 4503599627370496.0::DOUBLE)"


def _pick_sql(values: list[str], seed: int) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + CAST(floor({_unit_sql(seed)} * {len(values)}) AS INTEGER)]"


@query("synth_measures", f"""
SELECT id, 1 + CAST(floor({_unit_sql(42)} * 1000) AS BIGINT) AS category, {_unit_sql(43)} * 100.0::DOUBLE AS value,
       chr(CAST(65 + (id % 26) AS INTEGER)) AS "group"
FROM (SELECT o_orderkey AS id FROM orders)
""")
def q_synth_measures(spark, sf):
    return SY.with_measures(T(spark, sf, "orders"), "o_orderkey")


@query("synth_partitioned", f"""
SELECT id, CASE WHEN {_unit_sql(42)} > 0.5 THEN 'A' ELSE 'B' END AS category,
       CAST(TIMESTAMP '2024-02-01' + CAST(floor({_unit_sql(43)} * 30) AS INTEGER) * INTERVAL 1 DAY AS TIMESTAMP) AS date,
       {_unit_sql(44)} * 100.0::DOUBLE AS value1, {_unit_sql(45)} * 1000.0::DOUBLE AS value2
FROM (SELECT event_id AS id FROM events)
""")
def q_synth_partitioned(spark, sf):
    rows = SY.with_partitions(T(spark, sf, "events"), "event_id", days=30, today=F.to_date(F.lit("2024-02-01")))
    return rows.withColumn("date", F.col("date").cast("timestamp_ntz"))


_USERS_SQL = f"""
SELECT id, "user", lower(replace("user", ' ', '.')) || '@' || domain AS email, last_login, activity_score, status FROM (
  SELECT id, {_pick_sql(SY.FIRST_NAMES, 7)} || ' ' || {_pick_sql(SY.LAST_NAMES, 8)} AS "user", {_pick_sql(SY.EMAIL_DOMAINS, 9)} AS domain,
         TIMESTAMP '{SY.LOGIN_START}' + CAST(floor({_unit_sql(10)} * date_diff('day', DATE '{SY.LOGIN_START}', DATE '{SY.LOGIN_END}')) AS INTEGER) * INTERVAL 1 DAY AS last_login,
         round({_unit_sql(11)} * 100.0::DOUBLE, 2) AS activity_score, {_pick_sql(SY.STATUSES, 12)} AS status
  FROM (SELECT c_custkey AS id FROM customer))
"""


@query("synth_users", _USERS_SQL)
def q_synth_users(spark, sf):
    return SY.with_users(T(spark, sf, "customer"), "c_custkey")


@query("synth_users_shape", f"""
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, 0 AS bad_email, 0 AS bad_status, 0 AS bad_score,
       min(last_login) AS first_login, max(last_login) AS last_login
FROM ({_USERS_SQL})
""")
def q_synth_users_shape(spark, sf):
    users = SY.with_users(T(spark, sf, "customer"), "c_custkey")
    return users.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.sum(F.when(~F.col("email").rlike(r"^[a-z]+\.[a-z]+@[a-z]+\.com$"), 1).otherwise(0)).cast("int").alias("bad_email"),
        F.sum(F.when(~F.col("status").isin(*SY.STATUSES), 1).otherwise(0)).cast("int").alias("bad_status"),
        F.sum(F.when((F.col("activity_score") < 0) | (F.col("activity_score") > 100), 1).otherwise(0)).cast("int").alias("bad_score"),
        F.min("last_login").alias("first_login"),
        F.max("last_login").alias("last_login"),
    )


# ---------------------------------------------------------------- CSV cleaning

WANTED = ["id", "name", "email"]
# Each file group gets its own header: drifting columns and order. Every other
# segment, NULL too, has a header name with a comma and a field with a line feed.
_CSV_GROUPS = {
    "AUTOMOBILE": [("c_custkey", "id"), ("c_name", "name"), ("c_nationkey", "nation"), ("c_acctbal", "balance")],
    "BUILDING": [("c_name", "name"), ("c_acctbal", "balance"), ("c_custkey", "id")],
    "FURNITURE": [("c_acctbal", "balance"), ("c_nationkey", "nation")],
    "MACHINERY": [("c_custkey", "id"), ("c_name", "name")],
    "HOUSEHOLD": [("c_nationkey", "nation"), ("c_name", "name"), ("c_custkey", "id"), ("c_mktsegment", "segment")],
}


def _write_drifting_csv(spark, sf) -> str:
    """customer split by segment into CSV folders whose headers differ in
    columns and order; machinery rows of every third customer are written
    with empty id and name (rows the cleaner must drop)."""
    base = scratch_path(spark, "drifting_csv")
    cust = T(spark, sf, "customer")
    blank = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 3 == 0)
    for seg, cols in _CSV_GROUPS.items():
        part = cust.where(F.col("c_mktsegment") == seg)
        sel = [F.when(~blank, F.col(src)).alias(dst) if dst in ("id", "name") else F.col(src).alias(dst)
               for src, dst in cols]
        W.write(part.select(*sel), f"{base}/{seg.lower()}", "csv", header=True)
    other = cust.where(~F.coalesce(F.col("c_mktsegment").isin(*_CSV_GROUPS), F.lit(False)))
    odd = other.unionByName(cust.where("c_custkey % 50 = 0")).select(
        F.col("c_nationkey").alias("a,b"), F.concat(F.col("c_name"), F.lit("\n"), F.lit("x")).alias("name"), F.col("c_custkey").alias("id"))
    W.write(odd, f"{base}/odd", "csv", header=True)
    return base


@query("clean_columns", """
SELECT lower(c_mktsegment) AS dataset, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
       CAST(NULL AS VARCHAR) AS email
FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')
   OR (c_mktsegment = 'MACHINERY' AND c_custkey % 3 <> 0)
UNION ALL
SELECT 'odd', CAST(c_custkey AS VARCHAR), c_name || chr(10) || 'x', NULL FROM customer
WHERE c_custkey % 50 = 0
UNION ALL
SELECT 'odd', CAST(c_custkey AS VARCHAR), c_name || chr(10) || 'x', NULL FROM customer
WHERE coalesce(c_mktsegment, '') NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
""")
def q_clean_columns(spark, sf):
    base = _write_drifting_csv(spark, sf)
    rows, _ = CL.clean_csv_dir(spark, base, WANTED, recursive=True)
    return rows.select(CL.dataset_of("file").alias("dataset"), *WANTED)


@query("clean_stats", """
SELECT lower(c_mktsegment) AS dataset, count(*) AS rows_in,
       CAST(sum(CASE WHEN c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0)
                     THEN 0 ELSE 1 END) AS BIGINT) AS rows_out,
       CAST(sum(CASE WHEN c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0)
                     THEN 1 ELSE 0 END) AS BIGINT) AS rows_removed,
       max(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                             WHEN 'MACHINERY' THEN 0 ELSE 2 END) AS columns_removed,
       max(CASE c_mktsegment WHEN 'FURNITURE' THEN 'id,name,email' ELSE 'email' END) AS missing
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') GROUP BY c_mktsegment
UNION ALL
SELECT 'odd', count(*), count(*), 0, 1, 'email' FROM (
  SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0
  UNION ALL
  SELECT c_custkey FROM customer
  WHERE coalesce(c_mktsegment, '') NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))
""")
def q_clean_stats(spark, sf):
    base = _write_drifting_csv(spark, sf)
    _, stats = CL.clean_csv_dir(spark, base, WANTED, recursive=True)
    per_file = stats.withColumn("dataset", CL.dataset_of("file"))
    return per_file.groupBy("dataset").agg(
        F.sum("rows_in").cast("long").alias("rows_in"),
        F.sum("rows_out").cast("long").alias("rows_out"),
        F.sum("rows_removed").cast("long").alias("rows_removed"),
        F.max("columns_removed").alias("columns_removed"),
        F.max(F.array_join("missing", ",")).alias("missing"),
    )


@query("run_summary", """
SELECT 6 AS files_ok, 6 AS files_total, CAST(sum(CASE
         WHEN c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0) THEN 0 ELSE 1 END)
       + sum(CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_out
FROM customer
""")
def q_run_summary(spark, sf):
    base = _write_drifting_csv(spark, sf)
    _, stats = CL.clean_csv_dir(spark, base, WANTED, recursive=True)
    # a dataset's part files count as one
    per = stats.groupBy(CL.dataset_of("file").alias("file")).agg(F.min("status").alias("status"), F.sum("rows_out").alias("rows_out"))
    return CL.run_summary(per).select("files_ok", "files_total", "rows_out")


# ---------------------------------------------------------------- keyed load


@query("upsert_documents", """
SELECT user_id, event_id, ts, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1
""")
def q_upsert_documents(spark, sf):
    cut = literal_ts("2024-01-15 00:00:00")
    ev = T(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    v1 = scratch_path(spark, "docs_v1")
    v2 = scratch_path(spark, "docs_v2")
    DOC.load_documents(spark, ev.where(F.col("ts") < cut), None, v1, "user_id", ["ts", "event_id"])
    DOC.load_documents(spark, ev.where(F.col("ts") >= cut), v1, v2, "user_id", ["ts", "event_id"])
    return spark.read.parquet(v2)


PUSH_SCHEMA = "id BIGINT, event_id BIGINT, event_type STRING, value DOUBLE"


@query("push_documents", """
WITH l AS (
  SELECT event_id, event_type, value, '2024-01-01' AS day, event_id % 7 = 0 AS generated FROM events
  UNION ALL
  SELECT event_id, event_type, value * 2, '2024-01-02', event_id % 7 = 0 FROM events WHERE event_id % 2 = 0
)
SELECT * FROM l WHERE generated OR event_id % 2 = 1 OR day = '2024-01-02'
""")
def q_push_documents(spark, sf):
    """Two CSV loads into a document table; every seventh row has no id."""
    ev = T(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("id"), "event_id", "event_type", "value")
    loads = [(ev, "2024-01-01"), (ev.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), "2024-01-02")]
    target = None
    for rows, day in loads:
        csv, out = scratch_path(spark, "push_csv"), scratch_path(spark, "pushed")
        W.write(rows, csv, "csv", header=True)
        DOC.push_documents(spark, S.read_csv(spark, csv, schema=PUSH_SCHEMA), target, out, "id",
                           literal_ts(f"{day} 00:00:00"))
        target = out
    return spark.read.parquet(target).select(
        "doc.event_id", "doc.event_type", "doc.value", F.date_format("doc.ingestion_timestamp", "yyyy-MM-dd").alias("day"),
        (F.col("_id") != F.col("doc.event_id").cast("string")).alias("generated"))


@query("keyed_load", """
WITH l AS (
  SELECT user_id, event_id, ts, event_type, value, 0 AS load FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL SELECT user_id, event_id, ts, event_type, value * 2, 1 FROM events WHERE user_id % 10 = 3
  UNION ALL SELECT CASE WHEN event_id % 4 <> 0 THEN user_id END, event_id, ts, event_type, value * 3, 2 FROM events
    WHERE event_id % 500 < 20 AND ts >= TIMESTAMP '2024-01-15 00:00:00'
)
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, ts, event_type, value, load FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY load DESC, ts DESC, event_id DESC) AS r FROM l)
WHERE r = 1 OR user_id IS NULL
""")
def q_keyed_load(spark, sf):
    """Three loads into a table by id bucket; the second and third touch few ids, the third has rows without one."""
    path = scratch_path(spark, "keyed_table")
    cut = literal_ts("2024-01-15 00:00:00")
    ev = T(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    late = ev.where((F.col("event_id") % 500 < 20) & (F.col("ts") >= cut))
    KT.create(spark, path, buckets=32)
    for number, rows in enumerate([
            ev.where(F.col("ts") < cut),
            ev.where("user_id % 10 = 3").withColumn("value", F.col("value") * 2),
            late.withColumn("value", F.col("value") * 3).withColumn("user_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")))]):
        KT.load(spark, path, rows.withColumn("load", F.lit(number)), "user_id", ["ts", "event_id"])
    return KT.read(spark, path).withColumn("user_id", F.col("user_id").cast("string"))


@query("keyed_load_status", """
WITH l AS (SELECT user_id, event_id, event_id % 3 AS load FROM events),
seen AS (SELECT user_id, load, count(*) AS n, min(load) OVER (PARTITION BY user_id) AS first FROM l GROUP BY user_id, load)
SELECT load, CAST(count(*) FILTER (WHERE load = first) AS BIGINT) AS inserted, CAST(count(*) FILTER (WHERE load > first) AS BIGINT) AS replaced,
       CAST(sum(n) - count(*) AS BIGINT) AS superseded
FROM seen GROUP BY load
""")
def q_keyed_load_status(spark, sf):
    """The recorded counts of three loads."""
    path = scratch_path(spark, "keyed_table")
    ev = T(spark, sf, "events").select("user_id", "event_id", "value")
    KT.create(spark, path, buckets=8)
    for number in range(3):
        KT.load(spark, path, ev.where(F.col("event_id") % 3 == number), "user_id", ["event_id"])
    return spark.read.parquet(f"{path}/loads").select("load", "inserted", "replaced", "superseded")


# ---------------------------------------------------------------- inventory plans

NOW = "2024-01-01 12:00:00"
INV_SQL = """
SELECT CASE WHEN doc_id % 3 = 0
         THEN concat('/logs/prod/', ws, '/', ws, '-user-', doc_id % 5, '/', doc_id, ext)
         ELSE concat('/var/tmp/projects/', doc_id % 11, '/client', doc_id % 7, '/', doc_id, ext) END AS path,
       CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars END AS length,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mtime
FROM (SELECT doc_id, n_chars,
        CASE doc_id % 4 WHEN 0 THEN 'shared' WHEN 1 THEN 'alpha' WHEN 2 THEN 'alpha-regional' ELSE 'beta' END AS ws,
        CASE doc_id % 5 WHEN 0 THEN '.log.gz' WHEN 1 THEN '.gz' WHEN 2 THEN '.tmp' WHEN 3 THEN '.log' ELSE '.log.gz' END AS ext
      FROM documents) t
"""
WITH_INV = f"WITH inv AS ({INV_SQL})"


def inv_frame(spark, sf) -> DataFrame:
    """The INV inventory (path, length, mtime) derived from ``documents``."""
    d = F.col("doc_id")
    ws = (F.when(d % 4 == 0, "shared").when(d % 4 == 1, "alpha")
          .when(d % 4 == 2, "alpha-regional").otherwise("beta"))
    ext = (F.when(d % 5 == 0, ".log.gz").when(d % 5 == 1, ".gz").when(d % 5 == 2, ".tmp")
           .when(d % 5 == 3, ".log").otherwise(".log.gz"))
    s = lambda c: c.cast("string")
    path = F.when(
        d % 3 == 0,
        F.concat(F.lit("/logs/prod/"), ws, F.lit("/"), ws, F.lit("-user-"), s(d % 5), F.lit("/"), s(d), ext),
    ).otherwise(
        F.concat(F.lit("/var/tmp/projects/"), s(d % 11), F.lit("/client"), s(d % 7), F.lit("/"), s(d), ext)
    )
    return T(spark, sf, "documents").select(
        path.alias("path"),
        F.when(d % 50 == 0, F.lit(0).cast("long")).otherwise(F.col("n_chars")).alias("length"),
        F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("mtime"),
    )


@query("older_than", f"""
{WITH_INV} SELECT path, length, mtime FROM inv WHERE mtime < TIMESTAMP '2024-01-01 07:00:00'
""")
def q_older_than(spark, sf):
    return P.older_than(inv_frame(spark, sf), 5, literal_ts(NOW))


@query("match_files", f"""
{WITH_INV}
SELECT 'log_gz' AS rule, count(*) AS n FROM inv WHERE path LIKE '%log.gz'
UNION ALL SELECT 'old_gz_nonempty', count(*) FROM inv
  WHERE path LIKE '%.gz' AND length >= 1 AND mtime < TIMESTAMP '2024-01-01 07:00:00'
UNION ALL SELECT 'kept_after_exclude', count(*) FROM inv WHERE path NOT LIKE '%.tmp' AND path NOT LIKE '%.log'
""")
def q_match_files(spark, sf):
    inv = inv_frame(spark, sf)
    old = P.older_than(inv, 5, literal_ts(NOW))
    rules = [
        ("log_gz", P.match_files(inv, include=["*log.gz"])),
        ("old_gz_nonempty", P.match_files(old, include=["*.gz"], min_length=1)),
        ("kept_after_exclude", P.match_files(inv, exclude=["*.tmp", "*.log"])),
    ]
    out = None
    for name, df in rules:
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("file_keys", f"""
{WITH_INV}
SELECT path,
       'uploads/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS key_by_dir,
       CASE WHEN path LIKE '/var/tmp/projects/%'
            THEN 'uploads/' || substr(path, length('/var/tmp/projects/') + 1) END AS key_by_root
FROM inv
""")
def q_file_keys(spark, sf):
    return P.file_keys(inv_frame(spark, sf), "uploads", "/var/tmp/projects")


@query("key_collisions", f"""
{WITH_INV}, dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM inv)
SELECT 'uploads/' || string_split(dir, '/')[-1] AS key, count(*) AS n_items
FROM dirs GROUP BY 1 HAVING count(*) > 1
""")
def q_key_collisions(spark, sf):
    dirs = inv_frame(spark, sf).select(dirname("path").alias("dir")).distinct()
    keyed = dirs.select(object_key("uploads", basename("dir")).alias("key"), "dir")
    return P.key_collisions(keyed, "key", "dir")


_MANIFEST_SQL = f"""
{WITH_INV},
m AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n_files,
             CAST(sum(length) AS BIGINT) AS total_bytes FROM inv GROUP BY 1)
"""


@query("manifest", _MANIFEST_SQL + """
SELECT dir, n_files, total_bytes,
       CASE WHEN total_bytes >= 104857600 THEN 'multipart' ELSE 'single' END AS size_class,
       array_to_string(string_split(dir, '/')[-2:], '_') AS identifier,
       array_to_string(string_split(dir, '/')[-2:], '_') || '_20240101_120000.tar.zst' AS bundle_name
FROM m
""")
def q_manifest(spark, sf):
    return P.manifest(inv_frame(spark, sf), literal_ts(NOW))


def _ledger_standin(spark, manifest: DataFrame) -> str:
    """Ledger lines: identifiers of /var/tmp/projects/<n>/.. directories with even n,
    written as text with one repeated line and padding (the legacy line file)."""
    path = scratch_path(spark, "ledger_lines")
    n = F.regexp_extract("dir", r"^/var/tmp/projects/(\d+)/", 1)
    done = manifest.where((n != "") & (n.cast("int") % 2 == 0)).select("identifier")
    lines = done.select(F.concat(F.lit("  "), F.col("identifier"), F.lit(" ")).alias("value")).union(
        done.limit(1).select(F.col("identifier").alias("value")))
    W.write_lines(lines, path)
    return path


@query("pending_dirs", _MANIFEST_SQL + """
SELECT dir, array_to_string(string_split(dir, '/')[-2:], '_') AS identifier FROM m
WHERE NOT (dir LIKE '/var/tmp/projects/%'
           AND TRY_CAST(regexp_extract(dir, '^/var/tmp/projects/(\\d+)/', 1) AS INTEGER) % 2 = 0)
""")
def q_pending_dirs(spark, sf):
    man = P.manifest(inv_frame(spark, sf), literal_ts(NOW))
    ledger = S.read_ledger(spark, _ledger_standin(spark, man))
    return P.pending(man, ledger).select("dir", "identifier")


@query("ledger_append", _MANIFEST_SQL + """
SELECT DISTINCT array_to_string(string_split(dir, '/')[-2:], '_') AS identifier FROM m
WHERE dir LIKE '/logs/prod/%'
""")
def q_ledger_append(spark, sf):
    path = scratch_path(spark, "ledger")
    man = P.manifest(inv_frame(spark, sf), literal_ts(NOW)).where(F.col("dir").startswith("/logs/prod/"))
    W.ledger_append(spark, man.select("identifier"), path)
    return W.ledger_append(spark, man.select("identifier"), path)


def _shifted(inv: DataFrame) -> DataFrame:
    """Destination inventory: the projects tree under /backup/projects with
    some files missing, resized, newer or older."""
    m = F.col("length") % 4
    return inv.where(F.col("path").startswith("/var/tmp/projects/") & (m != 0)).select(
        F.regexp_replace("path", "^/var/tmp/projects/", "/backup/projects/").alias("path"),
        F.when(m == 1, F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.when(m == 2, F.col("mtime") + F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("mtime") - F.expr("INTERVAL 1 HOUR")).alias("mtime"),
    )


@query("sync_plan", f"""
{WITH_INV}, src AS (SELECT * FROM inv WHERE path LIKE '/var/tmp/projects/%')
SELECT substr(path, 19) AS rel, path AS source, '/backup/projects/' || substr(path, 19) AS target,
       CASE WHEN length % 4 = 0 THEN 'copy_new' WHEN length % 4 = 1 THEN 'copy_size'
            WHEN length % 4 = 2 THEN 'skip' ELSE 'copy_newer' END AS action
FROM src
""")
def q_sync_plan(spark, sf):
    inv = inv_frame(spark, sf)
    return P.sync_plan(inv, _shifted(inv), "/var/tmp/projects", "/backup/projects")


# The workspace list of the retention rule (fixture W1).
WORKSPACES = ["shared", "alpha", "alpha-regional", "beta"]


@query("retention_plan", f"""
{WITH_INV}
SELECT 'delete_file' AS action, path AS target, CAST(NULL AS VARCHAR) AS workspace FROM inv
WHERE path LIKE '/logs/prod/%' AND path LIKE '%log.gz' AND mtime < TIMESTAMP '2024-01-01 07:00:00'
UNION ALL
SELECT DISTINCT 'delete_dir', regexp_replace(path, '/[^/]*$', ''), string_split(path, '/')[4] FROM inv
WHERE path LIKE '/logs/prod/%' AND (SELECT sum(length) * 100 // 2000000 FROM inv) > 80
""")
def q_retention_plan(spark, sf):
    ws = spark.createDataFrame([(w,) for w in WORKSPACES], "workspace string")
    return P.retention_plan(inv_frame(spark, sf), "/logs/prod", ws, 5, literal_ts(NOW),
                            capacity_bytes=2_000_000, max_pct=80)


REQUESTED_BASES = [f"/var/tmp/projects/{i}" for i in range(13)]


@query("outcomes", _MANIFEST_SQL + """,
sub AS (SELECT dir, CAST(regexp_extract(dir, '^/var/tmp/projects/(\\d+)/', 1) AS INTEGER) AS n FROM m
        WHERE dir LIKE '/var/tmp/projects/%'),
st AS (SELECT CASE WHEN n % 2 = 0 THEN 'skipped' ELSE 'planned' END AS status FROM sub
       UNION ALL SELECT 'invalid' FROM range(13) r(i) WHERE i NOT IN (SELECT n FROM sub))
SELECT status, count(*) AS n FROM st GROUP BY status
""")
def q_outcomes(spark, sf):
    inv = inv_frame(spark, sf)
    man = P.manifest(inv, literal_ts(NOW))
    ledger = S.read_ledger(spark, _ledger_standin(spark, man))
    status = P.backup_status(P.requested_frame(spark, REQUESTED_BASES), inv, ledger)
    return P.outcomes(status)


@query("attempt_outcomes", """
SELECT l_orderkey AS item,
       CASE WHEN min(CASE WHEN l_linenumber <= 3 AND l_linestatus = 'F' THEN l_linenumber END) IS NULL
            THEN 'failed' ELSE 'uploaded' END AS status,
       CAST(coalesce(min(CASE WHEN l_linenumber <= 3 AND l_linestatus = 'F' THEN l_linenumber END),
                     max(CASE WHEN l_linenumber <= 3 THEN l_linenumber END), 0) AS INTEGER) AS attempts
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
""")
def q_attempt_outcomes(spark, sf):
    log = T(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("int").alias("attempt"),
        (F.col("l_linestatus") == "F").alias("ok"))
    return P.attempt_outcomes(log)


@query("table_status", "\nUNION ALL\n".join(
    [f"SELECT '{t}' AS table_name, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(count(*) AS VARCHAR) AS n FROM {t}" for t in S.TEST_TABLES]
    + ["SELECT 'no_such_table', 'unreadable', 'PATH_NOT_FOUND', CAST(NULL AS VARCHAR)"]))
def q_table_status(spark, sf):
    return S.table_status(spark, sf, [*S.TEST_TABLES, "no_such_table"]).withColumn("n", F.col("n").cast("string"))


@query("scalar_columns", """
SELECT o_orderkey, chr(CAST(65 + (o_orderkey % 26) AS INTEGER)) AS letter,
       CAST(o_orderkey - 5000 AS BIGINT) // 100 AS hundreds,
       lower(replace(o_orderpriority, ' ', '.')) || '@example.com' AS email,
       o_orderdate - INTERVAL 18 SECOND AS a_bit_before
FROM orders
""")
def q_scalar_columns(spark, sf):
    return T(spark, sf, "orders").select(
        "o_orderkey", G.letter_from_id("o_orderkey").alias("letter"), G.int_div(F.col("o_orderkey") - 5000, 100).alias("hundreds"),
        G.email_from_name(F.col("o_orderpriority"), F.lit("example.com")).alias("email"),
        minus_hours(F.col("o_orderdate"), 0.005).alias("a_bit_before"))


# ---------------------------------------------------------------- routing


@query("route_projects", """
SELECT 'user' || CAST(o_custkey % 10 AS VARCHAR) AS username, o_orderpriority AS project_name,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS project_id,
       CASE WHEN o_orderkey <= 9999 AND o_orderkey % 97 <> 0 THEN CAST(o_orderkey // 1000 AS VARCHAR) END AS band,
       CASE WHEN o_orderkey <= 9999 AND o_orderkey % 97 <> 0
            THEN '/data/projects/' || CAST(o_orderkey // 1000 AS VARCHAR) END AS source,
       CASE WHEN o_orderkey <= 9999 AND o_orderkey % 97 <> 0
            THEN '/data/dest/user' || CAST(o_custkey % 10 AS VARCHAR) || '/' || o_orderpriority || '/' ||
                 CAST(o_orderkey AS VARCHAR) END AS target,
       CASE WHEN o_orderkey % 97 = 0 THEN 'reject_not_a_number' WHEN o_orderkey > 9999 THEN 'reject_above_limit'
            WHEN (o_orderkey // 1000) % 2 = 0 THEN 'copy' ELSE 'warn_missing_source' END AS action
FROM orders
""")
def q_route_projects(spark, sf):
    orders = T(spark, sf, "orders")
    mapping = orders.select(
        F.concat(F.lit("user"), (F.col("o_custkey") % 10).cast("string")).alias("username"),
        F.col("o_orderpriority").alias("project_name"),
        F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("p"), F.col("o_orderkey").cast("string")))
        .otherwise(F.col("o_orderkey").cast("string")).alias("project_id"),
    )
    # stand-in for the listing of the source base: the even bands exist
    existing = orders.select(F.expr("o_orderkey div 1000").alias("b")).distinct().where(
        F.col("b") % 2 == 0).select(F.concat(F.lit("/data/projects/"), F.col("b").cast("string")).alias("dir"))
    plan = RT.route_projects(mapping, 9999, "/data/projects", "/data/dest", existing)
    return plan.withColumns({c: F.col(c).cast("string") for c in ("project_id", "band")})


@query("route_mapping_file", """
SELECT 'user' || CAST(o_custkey % 10 AS VARCHAR) AS username, o_orderpriority AS project_name, CAST(o_orderkey AS VARCHAR) AS project_id,
       CASE WHEN o_orderkey <= 9999 THEN '/data/projects/' || CAST(o_orderkey // 1000 AS VARCHAR) END AS source,
       CASE WHEN o_orderkey > 9999 THEN 'reject_above_limit' WHEN (o_orderkey // 1000) % 3 = 0 THEN 'copy' ELSE 'warn_missing_source' END AS action
FROM orders
""")
def q_route_mapping_file(spark, sf):
    """The mapping as a CSV file with a header, the source folders as a listing."""
    path = scratch_path(spark, "mapping_csv")
    orders = T(spark, sf, "orders")
    W.write(orders.select(F.concat(F.lit("user"), (F.col("o_custkey") % 10).cast("string")).alias("username"),
                          F.col("o_orderpriority").alias("project_name"), F.col("o_orderkey").alias("project_id")),
            path, "csv", header=True)
    mapping = S.read_csv(spark, path, schema="username STRING, project_name STRING, project_id STRING")
    tree = scratch_path(spark, "source_base")
    bands = orders.select(F.expr("o_orderkey div 1000").alias("band"), "o_orderkey").where("band % 3 = 0")
    W.write(bands, tree, partition_by=["band"])
    listed = inventory(spark, tree).select(
        F.concat(F.lit("/data/projects/"), F.regexp_extract("path", "/band=([0-9]+)/", 1)).alias("dir")).distinct()
    plan = RT.route_projects(mapping, 9999, "/data/projects", "/data/dest", listed)
    return plan.select("username", "project_name", F.col("project_id").cast("string").alias("project_id"), "source", "action")


_LINES_SQL = """
SELECT CASE p_partkey % 50 WHEN 0 THEN '' WHEN 1 THEN '  ' || CAST(p_partkey * 3 AS VARCHAR) || ' '
            WHEN 2 THEN p_name WHEN 3 THEN '-' || CAST(p_partkey AS VARCHAR)
            ELSE CAST(p_partkey * 3 AS VARCHAR) END AS value FROM part
"""


@query("route_numbers", f"""
WITH lines AS ({_LINES_SQL}),
t AS (SELECT trim(value) AS line FROM lines WHERE trim(value) <> ''),
n AS (SELECT line, TRY_CAST(line AS BIGINT) AS number FROM t),
c AS (SELECT line, number, CASE WHEN number <= 999 THEN '0' WHEN number <= 1999 THEN '1'
                               WHEN number <= 2999 THEN '2' END AS code FROM n)
SELECT line, code,
       CASE WHEN code IS NOT NULL THEN '/data/routed/' || code || '/' || CAST(number AS VARCHAR) END AS path,
       CASE WHEN number IS NULL THEN 'not a number' WHEN code IS NULL THEN 'out of range' END AS reason
FROM c
""")
def q_route_numbers(spark, sf):
    path = scratch_path(spark, "number_lines")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    lines = T(spark, sf, "part").select(
        F.when(k % 50 == 0, F.lit("")).when(k % 50 == 1, F.concat(F.lit("  "), s(k * 3), F.lit(" ")))
        .when(k % 50 == 2, F.col("p_name")).when(k % 50 == 3, F.concat(F.lit("-"), s(k)))
        .otherwise(s(k * 3)).alias("value"))
    W.write_lines(lines, path)
    return RT.route_numbers(S.read_lines(spark, path), "/data/routed").drop("number")


# ---------------------------------------------------------------- streaming

DOC_SCHEMA = "doc_id BIGINT, text STRING, source STRING, n_chars BIGINT, lang STRING"


@query("watch_once", """
SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents GROUP BY lang
""")
def q_watch_once(spark, sf):
    inbox = scratch_path(spark, "inbox")
    out = scratch_path(spark, "watched")
    ckpt = scratch_path(spark, "watch_ckpt")
    W.write(T(spark, sf, "documents"), inbox, partition_by=["lang"])
    stream = watch(spark, inbox, "parquet", schema=DOC_SCHEMA)
    q = run_watch(stream, out, ckpt, once=True)
    q.awaitTermination()
    # a second run finds nothing new: each file is handled once
    q2 = run_watch(watch(spark, inbox, "parquet", schema=DOC_SCHEMA), out, ckpt, once=True)
    q2.awaitTermination()
    return read_watch(spark, out).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("long").alias("total_chars"))


@query("watch_shared_output", """
SELECT lang, 'first' AS inbox, count(*) AS n_docs FROM documents WHERE doc_id % 2 = 0 GROUP BY lang
UNION ALL SELECT lang, 'second', count(*) FROM documents WHERE doc_id % 2 = 1 GROUP BY lang
UNION ALL SELECT lang, 'again', count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY lang
""")
def q_watch_shared_output(spark, sf):
    """Three watches with checkpoints of their own over one output: two
    folders, then the first folder once more under a new checkpoint."""
    out = scratch_path(spark, "watched_shared")
    docs = T(spark, sf, "documents")
    inboxes = {}
    for k, name in enumerate(("first", "second")):
        inboxes[name] = scratch_path(spark, "shared_inbox")
        W.write(docs.where(F.col("doc_id") % 2 == k), inboxes[name], partition_by=["lang"])
    for name, inbox in (*inboxes.items(), ("again", inboxes["first"])):
        stream = watch(spark, inbox, "parquet", schema=DOC_SCHEMA).withColumn("inbox", F.lit(name))
        run_watch(stream, out, scratch_path(spark, "shared_ckpt"), once=True).awaitTermination()
    return read_watch(spark, out).groupBy("lang", "inbox").agg(F.count(F.lit(1)).alias("n_docs"))


@query("admit_by_age", f"""
{WITH_INV}
SELECT path, TIMESTAMP '2024-01-01 06:00:00' AS admitted_at FROM inv WHERE mtime < TIMESTAMP '2024-01-01 01:00:00'
UNION ALL
SELECT path, TIMESTAMP '2024-01-01 12:00:00' FROM inv
WHERE mtime >= TIMESTAMP '2024-01-01 01:00:00' AND mtime < TIMESTAMP '2024-01-01 07:00:00'
""")
def q_admit_by_age(spark, sf):
    ledger = scratch_path(spark, "admitted")
    inv = inv_frame(spark, sf)
    admit_tick(spark, inv, ledger, 5, "2024-01-01 06:00:00")
    admit_tick(spark, inv, ledger, 5, "2024-01-01 12:00:00")
    admit_tick(spark, inv, ledger, 5, "2024-01-01 12:00:00")  # replay: admits nothing
    return spark.read.parquet(ledger)


# ---------------------------------------------------------------- more plan operators


@query("usage_percent", f"""
{WITH_INV} SELECT CAST(sum(length) AS BIGINT) AS used_bytes, CAST(sum(length) * 100 // 2000000 AS BIGINT) AS usage_pct
FROM inv
""")
def q_usage_percent(spark, sf):
    return P.usage_percent(inv_frame(spark, sf), 2_000_000)


@query("session_dirs", f"""
{WITH_INV}
SELECT DISTINCT string_split(path, '/')[4] AS workspace, regexp_replace(path, '/[^/]*$', '') AS dir
FROM inv WHERE path LIKE '/logs/prod/%' AND string_split(path, '/')[4] IN ('alpha', 'alpha-regional')
""")
def q_session_dirs(spark, sf):
    ws = spark.createDataFrame([("alpha",), ("alpha-regional",)], "workspace string")
    return P.session_dirs(inv_frame(spark, sf), "/logs/prod", ws).select("workspace", "dir").distinct()


@query("subdirectories", f"""
{WITH_INV}
SELECT DISTINCT regexp_extract(path, '^(/var/tmp/projects/[0-9]+)/', 1) AS base,
       regexp_extract(path, '^(/var/tmp/projects/[0-9]+/[^/]+)/', 1) AS dir
FROM inv WHERE path LIKE '/var/tmp/projects/%'
""")
def q_subdirectories(spark, sf):
    from strata.sources.inventory import subdirectories
    return subdirectories(inv_frame(spark, sf), REQUESTED_BASES)


@query("column_info", """
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority) FROM orders
""")
def q_column_info(spark, sf):
    return CL.info(T(spark, sf, "orders")).select("column", "non_null")


@query("backup_plan", _MANIFEST_SQL + """
SELECT dir, array_to_string(string_split(dir, '/')[-2:], '_') AS identifier, n_files, total_bytes,
       CASE WHEN total_bytes >= 104857600 THEN 'multipart' ELSE 'single' END AS size_class,
       array_to_string(string_split(dir, '/')[-2:], '_') || '_20240101_120000.tar.zst' AS bundle_name,
       'backups/' || array_to_string(string_split(dir, '/')[-2:], '_') || '_20240101_120000.tar.zst' AS object_key,
       CASE WHEN TRY_CAST(regexp_extract(dir, '^/var/tmp/projects/(\\d+)/', 1) AS INTEGER) % 2 = 0
            THEN 'skipped' ELSE 'planned' END AS status
FROM m WHERE dir LIKE '/var/tmp/projects/%'
""")
def q_backup_plan(spark, sf):
    inv = inv_frame(spark, sf)
    ledger = S.read_ledger(spark, _ledger_standin(spark, P.manifest(inv, literal_ts(NOW))))
    return P.backup_plan(inv, REQUESTED_BASES, ledger, literal_ts(NOW))


@query("backup_plan_multipart", _MANIFEST_SQL + """
SELECT dir, total_bytes, CASE WHEN total_bytes >= 8000 THEN 'multipart' ELSE 'single' END AS size_class
FROM m WHERE dir LIKE '/var/tmp/projects/%'
""")
def q_backup_plan_multipart(spark, sf):
    """Bundles of 8,000 bytes and more go in parts."""
    inv = inv_frame(spark, sf)
    none = spark.createDataFrame([], "identifier string")
    plan = P.backup_plan(inv, REQUESTED_BASES, none, literal_ts(NOW), multipart_bytes=8000)
    return plan.select("dir", "total_bytes", "size_class")


@query("upload_plan", f"""
{WITH_INV}
SELECT path, regexp_extract(path, '^(/var/tmp/projects/[0-9]+)/', 1) AS watch_dir,
       regexp_replace(path, '^/var/tmp/projects/[0-9]+/', 'uploads/') AS object_key,
       CASE WHEN NOT (mtime < TIMESTAMP '2024-01-01 11:00:00') THEN 'wait_young'
            WHEN length = 0 THEN 'skip_empty' ELSE 'upload' END AS action
FROM inv WHERE path LIKE '/var/tmp/projects/%' AND path LIKE '%.gz'
""")
def q_upload_plan(spark, sf):
    watch = P.requested_frame(spark, REQUESTED_BASES)
    return P.upload_plan(inv_frame(spark, sf), watch, 1, literal_ts(NOW), "uploads")


@query("watch_listing", """
SELECT 'lang=' || lang AS folder, count(DISTINCT lang) AS n_files FROM documents GROUP BY lang
""")
def q_watch_listing(spark, sf):
    inbox = scratch_path(spark, "listing_inbox")
    out = scratch_path(spark, "listing_out")
    ckpt = scratch_path(spark, "listing_ckpt")
    docs = T(spark, sf, "documents").select("text", "lang")
    # one file per language folder: the balanced write gives each small value one bucket
    W.write(W.balanced_by_key(docs, ["lang"]), inbox, "text", partition_by=["lang"])
    stream = watch(spark, inbox, glob="*.txt").select("path", "length", "modificationTime")
    run_watch(stream, out, ckpt, once=True).awaitTermination()
    listed = read_watch(spark, out)
    return listed.groupBy(basename(dirname("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))
