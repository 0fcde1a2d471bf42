"""The reference's timed load jobs, re-expressed with the engine's operators.

Each workload is sized by a row count ``n`` (the bench uses the row count of
``lineitem`` at its scale factor) and writes under the checkpoint root. They
are benchmarks of the sinks and sources, not registered queries: their input
is generated.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.operators import relational as R
from strata.session import temp_output
from strata.sinks import writers as W
from strata.sources import files as S
from strata.sources import synth as SY


def _parts(spark: SparkSession, n: int, rows_per_part: int = 500_000) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // rows_per_part))


def write_read(spark: SparkSession, n: int) -> int:
    """Three-column rows written as parquet, read back and counted."""
    with temp_output(spark, "wl_write_read") as path:
        W.write(SY.synth_measures(spark, n, _parts(spark, n), columns=("id", "category", "value")), path)
        return spark.read.parquet(path).count()


def generate_join(spark: SparkSession, n: int) -> int:
    """Two-category rows to parquet and headerless CSV; read both (the CSV
    typed), aggregate, join on id and fan the join out to parquet and CSV."""
    with temp_output(spark, "wl_join") as base:
        return _wl_join(spark, n, base)


def _wl_join(spark: SparkSession, n: int, base: str) -> int:
    df = SY.synth_two_categories(spark, n, _parts(spark, n))
    W.fan_out(df, [(f"{base}/in_parquet", "parquet"), (f"{base}/in_csv", "csv", {"header": False})])
    pq = spark.read.parquet(f"{base}/in_parquet")
    csv = S.read_csv(spark, f"{base}/in_csv", schema="id BIGINT, rand1 DOUBLE, rand2 DOUBLE, category STRING",
                     header=False)
    agg = R.avg_max(pq, "category", "rand1", "rand2", "avg_rand1", "max_rand2")
    joined = R.join_formats(pq, csv, "id", "_csv")
    W.write(agg, f"{base}/aggregated")
    return W.fan_out(joined, [(f"{base}/joined", "parquet")] +
                     [(f"{base}/joined_csv_{i}", "csv", {"header": False}) for i in range(3)])


def partitioned_pruning(spark: SparkSession, n: int, days: int = 365) -> int:
    """Rows over (category, date) partitions; pruned daily metrics written with
    dynamic overwrite; SQL day counts over a view."""
    with temp_output(spark, "wl_parts") as base:
        return _wl_parts(spark, n, base, days)


def _wl_parts(spark: SparkSession, n: int, base: str, days: int) -> int:
    df = SY.synth_partitioned(spark, n, _parts(spark, n), days=days)
    keys = ["category", "date"]
    W.write(W.balanced_by_key(df, keys), f"{base}/input", partition_by=keys, max_records_per_file=1_000_000)
    data = spark.read.parquet(f"{base}/input")
    after = data.agg(F.min("date")).first()[0]
    metrics = R.daily_metrics(data, "category", "A", "date", str(after), "value1", "value2")
    W.write(W.balanced_by_key(metrics, ["date"]), f"{base}/daily_metrics",
            partition_by=["date"], dynamic=True)
    counts = R.period_counts(spark, data, "wl_partitioned", "B", str(after), "2999-12-31")
    W.write(counts, f"{base}/summary")
    return spark.read.parquet(f"{base}/summary").count()


def heavy_compute(spark: SparkSession, n: int) -> int:
    """Measures persisted once and written in three formats; per-letter
    average and sum, plus the top row per letter."""
    with temp_output(spark, "wl_heavy") as base:
        return _wl_heavy(spark, n, base)


def _wl_heavy(spark: SparkSession, n: int, base: str) -> int:
    df = SY.synth_measures(spark, n, _parts(spark, n), max_cat=10_000, max_val=1000.0)
    W.fan_out(df, [(f"{base}/parquet", "parquet"), (f"{base}/orc", "orc"),
                   (f"{base}/csv", "csv", {"header": True})])
    data = spark.read.parquet(f"{base}/parquet")
    W.write(R.group_stats(data, "group", "value"), f"{base}/grouped")
    top = R.top_in_group(data, "group", [F.col("value").desc(), F.col("id")], 1)
    W.write(top, f"{base}/top")
    return spark.read.parquet(f"{base}/grouped").count()


WORKLOADS = {
    "wl_write_read": write_read,
    "wl_generate_join": generate_join,
    "wl_partitioned_pruning": partitioned_pruning,
    "wl_heavy_compute": heavy_compute,
}
