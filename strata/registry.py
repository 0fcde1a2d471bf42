"""Query keys over the test tables, each with its DuckDB oracle.

``QUERIES[key](spark, sf_dir)`` returns a DataFrame; ``ORACLES[key]`` is SQL
that DuckDB runs over the same parquet tables (registered as views under
their table names). Column names are equal on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import insight as I
from strata.operators import relational as R
from strata.operators import relationships as REL
from strata.session import literal_ts
from strata.sources.files import TEST_TABLES, load_table, load_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn
    return wrap


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Report form of sums and averages of doubles, whose last digits depend on
    the order of addition."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ---------------------------------------------------------------- relational

@query("group_stats", """
SELECT l_returnflag, round(avg(l_quantity), 4) AS avg_qty,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty
FROM lineitem GROUP BY l_returnflag
""")
def q_group_stats(spark, sf):
    return rounded(R.group_stats(T(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "avg_qty", "sum_qty"), avg_qty=4, sum_qty=2)


@query("group_sum", """
SELECT l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM lineitem GROUP BY l_linestatus
""")
def q_group_sum(spark, sf):
    return rounded(R.group_sum(T(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", "sum_price"), sum_price=2)


@query("conditional_columns", """
SELECT CASE WHEN l_quantity > 25 THEN 'A' ELSE 'B' END AS label,
       count(*) AS n, max(l_extendedprice * 100.0) AS max_scaled
FROM lineitem GROUP BY 1
""")
def q_conditional_columns(spark, sf):
    return R.conditional_columns(T(spark, sf, "lineitem"), "l_quantity", 25, "l_extendedprice", 100.0)


@query("avg_max", """
SELECT o_orderstatus, round(avg(o_totalprice), 4) AS avg_price, max(o_totalprice) AS max_price
FROM orders GROUP BY o_orderstatus
""")
def q_avg_max(spark, sf):
    return rounded(R.avg_max(T(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "o_totalprice",
                             "avg_price", "max_price"), avg_price=4)


DAY_AFTER = "2024-01-10"


def events_by_day(spark, sf, ts_from: str | None = None, ts_to: str | None = None) -> DataFrame:
    """events as (category, date, value1 = value, value2 = value) — the
    partitioned-measures shape. Optional ``ts`` bounds are the day bounds
    restated on the raw timestamp so the parquet scan can skip row groups."""
    ev = T(spark, sf, "events")
    if ts_from:
        ev = ev.where(F.col("ts") >= literal_ts(ts_from))
    if ts_to:
        ev = ev.where(F.col("ts") < literal_ts(ts_to))
    return ev.select(
        F.col("event_type").alias("category"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("value1"),
        F.col("value").alias("value2"),
        F.col("user_id"),
    )


@query("daily_metrics", f"""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, round(avg(value), 4) AS daily_avg, max(value) AS daily_max
FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) > DATE '{DAY_AFTER}'
GROUP BY 1
""")
def q_daily_metrics(spark, sf):
    ev = events_by_day(spark, sf, ts_from="2024-01-11 00:00:00")
    return rounded(day_text(R.daily_metrics(ev, "category", "click", "date", DAY_AFTER, "value1", "value2")), daily_avg=4)


PERIOD = ("2024-01-05", "2024-01-20")


def day_text(df: DataFrame, col: str = "date") -> DataFrame:
    """Report form of a day key: ISO text, identical in every engine's client."""
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd"))


@query("period_counts", f"""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS total_transactions FROM events
WHERE event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'
GROUP BY 1
""")
def q_period_counts(spark, sf):
    ev = events_by_day(spark, sf, "2024-01-05 00:00:00", "2024-01-21 00:00:00")
    return day_text(R.period_counts(spark, ev, "events_by_day", "purchase", *PERIOD))


@query("contradiction", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS total_transactions FROM events
WHERE event_type = 'click' AND event_type = 'error' GROUP BY 1
""")
def q_contradiction(spark, sf):
    clicks = events_by_day(spark, sf).where(F.col("category") == "click")
    return day_text(R.period_counts(spark, clicks, "click_days", "error", "2024-01-01", "2024-12-31"))


@query("row_count", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TEST_TABLES
))
def q_row_count(spark, sf):
    parts = [R.row_count(df, t) for t, df in load_tables(spark, sf, TEST_TABLES).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("rank_in_group", """
SELECT c_custkey, c_mktsegment, c_acctbal,
       CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rnk
FROM customer
""")
def q_rank_in_group(spark, sf):
    cust = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.rank_in_group(cust, "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")])


@query("top_in_group", """
SELECT c_custkey, c_mktsegment, c_acctbal, rnk FROM (
  SELECT c_custkey, c_mktsegment, c_acctbal,
         CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rnk
  FROM customer) WHERE rnk <= 3
""")
def q_top_in_group(spark, sf):
    cust = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.top_in_group(cust, "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("hash_sample", """
SELECT * FROM orders WHERE o_orderkey % 10 = 0
""")
def q_hash_sample(spark, sf):
    return R.hash_sample(T(spark, sf, "orders"), "o_orderkey", 10, hashed=False)


@query("seeded_sample", """
SELECT * FROM orders WHERE ('0x' || md5('11:' || CAST(o_orderkey AS VARCHAR))[1:13])::BIGINT / 4503599627370496.0::DOUBLE < 1.0::DOUBLE / 8
""")
def q_seeded_sample(spark, sf):
    return R.hash_sample(T(spark, sf, "orders"), "o_orderkey", 8, seed=11)


# ---------------------------------------------------------------- insight

@query("children_per_parent", """
SELECT p.c_custkey, CAST(count(o.o_custkey) AS BIGINT) AS cnt_orders
FROM customer p LEFT JOIN orders o ON o.o_custkey = p.c_custkey
GROUP BY p.c_custkey ORDER BY cnt_orders DESC, p.c_custkey LIMIT 10
""")
def q_children_per_parent(spark, sf):
    return I.children_per_parent(T(spark, sf, "customer"), T(spark, sf, "orders"),
                                 "c_custkey", "o_custkey", "cnt_orders")


@query("children_zero", """
SELECT p.o_orderkey, CAST(count(l.l_orderkey) AS BIGINT) AS cnt_lineitem
FROM orders p LEFT JOIN lineitem l ON l.l_orderkey = p.o_orderkey
GROUP BY p.o_orderkey HAVING count(l.l_orderkey) = 0
""")
def q_children_zero(spark, sf):
    return I.childless_parents(T(spark, sf, "orders"), T(spark, sf, "lineitem"),
                               "o_orderkey", "l_orderkey", "cnt_lineitem")


@query("orphans", """
SELECT c.* FROM documents c LEFT JOIN labels p ON c.doc_id = p.doc_id WHERE p.doc_id IS NULL
""")
def q_orphans(spark, sf):
    return I.orphans(T(spark, sf, "labels"), T(spark, sf, "documents"), "doc_id", "doc_id")


@query("orphans_preview", """
SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id * 1000)
ORDER BY e.event_id LIMIT 20
""")
def q_orphans_preview(spark, sf):
    """The first 20 events of users that no customer number, taken as thousands, has."""
    events = T(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") * 1000).alias("custkey"))
    return I.orphans(T(spark, sf, "customer"), events, "c_custkey", "custkey", n=20, order=["event_id"]).select("event_id", "user_id")


@query("top_parents", """
SELECT p.p_partkey, CAST(count(*) AS BIGINT) AS total
FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey
GROUP BY p.p_partkey ORDER BY total DESC, p.p_partkey LIMIT 5
""")
def q_top_parents(spark, sf):
    return I.top_parents(T(spark, sf, "part"), T(spark, sf, "lineitem"), "p_partkey", "l_partkey")


# ---------------------------------------------------------------- relationships

# Eligible (string / integer) columns of the test tables, for the generated oracle.
ELIGIBLE_TEST_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

_UNPIVOT = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS t, '{c}' AS c, CAST(\"{c}\" AS VARCHAR) AS v, count(*) OVER () AS n FROM {t}"
    for t, cols in ELIGIBLE_TEST_COLUMNS.items() for c in cols
)
_PROFILE_CTE = f"""
u AS ({_UNPIVOT}),
d AS (SELECT DISTINCT t, c, v FROM u WHERE v IS NOT NULL),
k AS (SELECT t, c, count(*) AS nd FROM d GROUP BY t, c),
cols AS (SELECT DISTINCT t, c FROM u),
nr AS (SELECT t, max(n) AS n FROM u GROUP BY t)
"""
_REL_CTE = _PROFILE_CTE + """,
o AS (SELECT p.t AS pt, p.c AS pc, h.t AS ct, h.c AS cc, count(*) AS ov
      FROM d p JOIN d h ON p.v = h.v WHERE p.t <> h.t GROUP BY ALL),
rel AS (
  SELECT o.pt AS parent_table, o.pc AS parent_col, o.ct AS child_table, o.cc AS child_col,
         o.ov / kc.nd AS overlap_ratio, kp.nd / nr.n AS uniqueness,
         (o.ov / kc.nd) * (kp.nd / nr.n) AS confidence, CAST(o.ov AS BIGINT) AS sample_overlap
  FROM o JOIN k kc ON kc.t = o.ct AND kc.c = o.cc
         JOIN k kp ON kp.t = o.pt AND kp.c = o.pc
         JOIN nr ON nr.t = o.pt
  WHERE o.ov / kc.nd >= 0.8 AND kp.nd / nr.n >= 0.9)
"""


def _pct(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', round_even(({expr}) * 100.0, {digits}))"


def test_tables(spark, sf) -> dict[str, DataFrame]:
    return load_tables(spark, sf, TEST_TABLES)


@query("column_profile", f"""
WITH {_PROFILE_CTE}
SELECT cols.t AS table_name, cols.c AS column_name, CAST(coalesce(k.nd, 0) AS BIGINT) AS n_distinct,
       CAST(nr.n AS BIGINT) AS n_rows, coalesce(k.nd, 0) / nr.n AS uniqueness
FROM cols LEFT JOIN k ON k.t = cols.t AND k.c = cols.c JOIN nr ON nr.t = cols.t
""")
def q_column_profile(spark, sf):
    return REL.column_profile(spark, test_tables(spark, sf)).drop("idx", "tid")


@query("column_overlap", """
SELECT CAST(count(*) AS BIGINT) AS overlap FROM (
  SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL
  INTERSECT
  SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey IS NOT NULL)
""")
def q_column_overlap(spark, sf):
    return REL.column_overlap(T(spark, sf, "orders"), "o_custkey", T(spark, sf, "customer"), "c_custkey")


@query("infer_relationships", f"""
WITH {_REL_CTE}
SELECT parent_table, parent_col, child_table, child_col, confidence,
       {_pct('overlap_ratio', 1)} || ' values exist in parent, ' || {_pct('uniqueness', 1)} || ' unique' AS reason,
       sample_overlap, overlap_ratio, uniqueness
FROM rel
""")
def q_infer_relationships(spark, sf):
    return REL.infer_relationships(spark, test_tables(spark, sf))


_ORDER = "confidence DESC, child_table, child_col, parent_table, parent_col"


@query("er_edges", f"""
WITH {_REL_CTE},
best AS (SELECT *, row_number() OVER (PARTITION BY parent_table, child_table ORDER BY {_ORDER}) AS r
         FROM rel WHERE confidence >= 0.75)
SELECT parent_table, child_table, parent_col, child_col, confidence,
       CASE WHEN confidence > 0.9 THEN '||--o{{' ELSE '||--|{{' END AS cardinality,
       parent_col || ' → ' || child_col || ' [' || {_pct('confidence', 0)} || ']' AS label,
       parent_table || ' ' || (CASE WHEN confidence > 0.9 THEN '||--o{{' ELSE '||--|{{' END) || ' ' ||
         child_table || ' : "' || parent_col || ' → ' || child_col || ' [' || {_pct('confidence', 0)} || ']"' AS edge
FROM best WHERE r = 1
""")
def q_er_edges(spark, sf):
    return REL.er_edges(REL.infer_relationships(spark, test_tables(spark, sf)), 0.75)


@query("fk_ddl", f"""
WITH {_REL_CTE}
SELECT child_table, child_col, parent_table, parent_col, confidence,
       '-- Confidence: ' || {_pct('confidence', 1)} AS comment,
       'ALTER TABLE ' || child_table || ' ADD CONSTRAINT fk_' || child_table || '_' || child_col ||
       ' FOREIGN KEY (' || child_col || ') REFERENCES ' || parent_table || '(' || parent_col || ');' AS statement
FROM rel WHERE confidence > 0.9
""")
def q_fk_ddl(spark, sf):
    return REL.fk_ddl(REL.infer_relationships(spark, test_tables(spark, sf)), 0.9)


def _insight_sql(kind_tpl: list[tuple[str, str]]) -> str:
    parts = []
    for kind, tpl in kind_tpl:
        text = "'" + tpl.replace("'", "''") + "'"
        for ph, col in (("{pt}", "parent_table"), ("{pc}", "parent_col"),
                        ("{ct}", "child_table"), ("{cc}", "child_col")):
            text = f"replace({text}, '{ph}', {col})"
        parts.append(f"SELECT parent_table, parent_col, child_table, child_col, '{kind}' AS kind, {text} AS sql FROM best")
    return "\nUNION ALL\n".join(parts)


def _insight_oracle() -> str:
    from strata.functions.text import INSIGHT_TEMPLATES
    return f"""
WITH {_REL_CTE},
top AS (SELECT * FROM rel ORDER BY {_ORDER} LIMIT 6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_table, child_table ORDER BY {_ORDER}) AS r FROM top),
best AS (SELECT * FROM ranked WHERE r = 1)
{_insight_sql(list(INSIGHT_TEMPLATES))}
"""


@query("insight_queries", _insight_oracle())
def q_insight_queries(spark, sf):
    return I.insight_queries(REL.infer_relationships(spark, test_tables(spark, sf)), 6)


@query("er_diagram", f"""
WITH {_REL_CTE},
best AS (SELECT *, row_number() OVER (PARTITION BY parent_table, child_table ORDER BY {_ORDER}) AS r
         FROM rel WHERE confidence >= 0.75),
e AS (SELECT * FROM best WHERE r = 1)
SELECT 0 AS section, 'erDiagram' AS line
UNION ALL
SELECT DISTINCT 1, '    ' || t || ' {{}}' FROM (SELECT parent_table AS t FROM e UNION SELECT child_table FROM e)
UNION ALL
SELECT 2, '    ' || parent_table || ' ' || (CASE WHEN confidence > 0.9 THEN '||--o{{' ELSE '||--|{{' END) || ' ' ||
          child_table || ' : "' || parent_col || ' → ' || child_col || ' [' || {_pct('confidence', 0)} || ']"'
FROM e
""")
def q_er_diagram(spark, sf):
    return REL.er_diagram_lines(REL.er_edges(REL.infer_relationships(spark, test_tables(spark, sf)), 0.75))


REL_EXPORT_SCHEMA = ("parent_table STRING, parent_col STRING, child_table STRING, child_col STRING, "
                     "confidence DOUBLE, reason STRING, sample_overlap BIGINT")


@query("relationship_export", f"""
WITH {_REL_CTE}
SELECT parent_table, parent_col, child_table, child_col, confidence,
       {_pct('overlap_ratio', 1)} || ' values exist in parent, ' || {_pct('uniqueness', 1)} || ' unique' AS reason,
       sample_overlap
FROM rel
""")
def q_relationship_export(spark, sf):
    from strata.session import scratch_path
    path = REL.export_relationships(REL.infer_relationships(spark, test_tables(spark, sf)),
                                    scratch_path(spark, "relationships_csv"))
    return spark.read.option("header", True).schema(REL_EXPORT_SCHEMA).csv(path)


@query("ddl_script", f"""
WITH {_REL_CTE}, hi AS (SELECT * FROM rel WHERE confidence > 0.9)
SELECT '-- Confidence: ' || {_pct('confidence', 1)} AS value FROM hi
UNION ALL
SELECT 'ALTER TABLE ' || child_table || ' ADD CONSTRAINT fk_' || child_table || '_' || child_col ||
       ' FOREIGN KEY (' || child_col || ') REFERENCES ' || parent_table || '(' || parent_col || ');' FROM hi
UNION ALL
SELECT '' FROM hi
""")
def q_ddl_script(spark, sf):
    from strata.session import scratch_path
    from strata.sinks.writers import write_lines
    ddl = REL.fk_ddl(REL.infer_relationships(spark, test_tables(spark, sf)), 0.9)
    path = write_lines(REL.ddl_script_lines(ddl), scratch_path(spark, "ddl_script"), "line")
    return spark.read.text(path)


# keys that go through storage register themselves on import
from strata import registry_io  # noqa: E402,F401
