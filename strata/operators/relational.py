"""Relational core: aggregates, filters, joins, ranking.

Aggregates go through ``groupBy().agg`` so Spark combines map-side before the
shuffle; a hot group key therefore costs one partial row per task, not a
third of the data in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.generators import unit
from strata.session import scratch_path

MAX_BUCKETS = 100_000  # Spark's own limit (spark.sql.sources.bucketing.maxBuckets)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def group_stats(df: DataFrame, key: str, value: str, avg_name: str = "avg_value",
                sum_name: str = "total_value") -> DataFrame:
    """avg + sum per group."""
    return df.groupBy(key).agg(F.avg(value).alias(avg_name), F.sum(value).alias(sum_name))


def group_sum(df: DataFrame, key: str, value: str, name: str = "sum_value") -> DataFrame:
    """sum per group."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def avg_max(df: DataFrame, key: str, a: str, b: str, avg_name: str | None = None,
            max_name: str | None = None) -> DataFrame:
    """avg of one column, max of another, by name not by dict order."""
    return df.groupBy(key).agg(F.avg(a).alias(avg_name or f"avg_{a}"), F.max(b).alias(max_name or f"max_{b}"))


def label_by_threshold(c: Column | str, threshold: float, above: str = "A",
                       below: str = "B") -> Column:
    """Two-way conditional."""
    return F.when(_c(c) > threshold, above).otherwise(below)


def conditional_columns(df: DataFrame, value: str, threshold: float, scale_col: str,
                        factor: float) -> DataFrame:
    """Computed label and scaled column (C1, C2), then count and max by label."""
    return (
        df.withColumns({
            "label": label_by_threshold(value, threshold),
            "scaled": F.col(scale_col) * F.lit(factor),
        })
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.max("scaled").alias("max_scaled"))
    )


def daily_metrics(df: DataFrame, category_col: str, category: str, date_col: str,
                  after: str, a: str, b: str) -> DataFrame:
    """Filter one category and days after a bound, then avg/max by day.

    On a table partitioned by (category, date) both predicates become
    ``PartitionFilters``; on a flat table the category equality is pushed to
    the scan.
    """
    return (
        df.where((F.col(category_col) == category) & (F.col(date_col) > F.to_date(F.lit(after))))
        .groupBy(date_col)
        .agg(F.avg(a).alias("daily_avg"), F.max(b).alias("daily_max"))
    )


def period_counts(spark: SparkSession, df: DataFrame, view: str, category: str,
                  lo: str, hi: str, category_col: str = "category",
                  date_col: str = "date") -> DataFrame:
    """SQL over a temp view: rows per day for one category in [lo, hi]."""
    def lit(v: str) -> str:
        return "'" + str(v).replace("'", "''") + "'"

    df.createOrReplaceTempView(view)
    return spark.sql(
        f"SELECT `{date_col}` AS date, COUNT(*) AS total_transactions "
        f"FROM `{view}` WHERE `{category_col}` = {lit(category)} "
        f"AND `{date_col}` BETWEEN DATE {lit(lo)} AND DATE {lit(hi)} GROUP BY `{date_col}`"
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    """Global row count as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")


def join_formats(a: DataFrame, b: DataFrame, key: str, suffix: str = "_r") -> DataFrame:
    """Inner equi-join on a key; the right side's other columns get a suffix."""
    renamed = b.select(key, *[F.col(c).alias(c + suffix) for c in b.columns if c != key])
    return a.join(renamed, key, "inner")


def hash_sample(df: DataFrame, key: str, m: int, hashed: bool = True, seed: int | None = None) -> DataFrame:
    """Deterministic 1-in-m sample on a key (G5): ``pmod(xxhash64(key), m) = 0``
    (``hashed=False`` uses the key itself, for dense integer keys). With a
    ``seed``, the keys whose random number is below 1/m: another sample for
    each seed, and the same one in any engine with MD5."""
    if seed is not None:
        return df.where(unit(seed, key) < F.lit(1.0 / m))
    k = F.xxhash64(F.col(key)) if hashed else F.col(key)
    return df.where(F.pmod(k, F.lit(m)) == 0)


def top_in_group(df: DataFrame, key: str, order: Sequence[Column], k: int,
                 name: str = "rnk") -> DataFrame:
    """Top k rows per group (F1, G2). The ``rank <= k`` filter lets Spark put a
    partial group limit before the shuffle, so each task ships at most k rows
    per group — a hot group does not reach one task whole."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def ranged(df: DataFrame, key: str, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (key, order...), each row with the number of
    its range (``_pid``), written once to the checkpoint folder: the bounds come
    from sampling, and every pass must see the same ranges.

    A group may span ranges, so none is too large for a task. The copy is
    bucketed by ``_pid`` (each range is one file of one bucket), so what is
    grouped or windowed by (``_pid``, key) needs no second shuffle. The table
    behind the copy is dropped from the catalog at once; its files stay.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"strata_ranged_{uuid.uuid4().hex}"
    (df.repartitionByRange(n, F.col(key), *order).withColumn("_pid", F.spark_partition_id())
     .write.format("parquet").bucketBy(min(n, MAX_BUCKETS), "_pid")
     .option("path", scratch_path(spark, "ranged")).saveAsTable(name))
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def edge_offsets(rows: DataFrame, key: str, measure: Column) -> DataFrame:
    """(_opid, _okey, _off): what of ``measure`` a group holds in the ranges in
    front, for groups cut by a range boundary; all others have no row. At most
    two groups a range are cut, so the table is bounded by the ranges."""
    # first and last key of each range (nulls sort first and count as a key)
    tagged = F.struct(F.col(key).isNotNull().alias("nn"), F.col(key).alias("k"))
    per_part = rows.groupBy("_pid").agg(F.min(tagged).alias("_lo"), F.max(tagged).alias("_hi"))
    edges = (
        per_part.select(F.col("_lo.k").alias("_ek"))
        .union(per_part.select(F.col("_hi.k").alias("_ek")))
        .groupBy("_ek").count().where(F.col("count") > 1).select("_ek")
    )
    held = (
        rows.join(F.broadcast(edges), F.col(key).eqNullSafe(F.col("_ek")), "left_semi")
        .groupBy("_pid", key).agg(measure.alias("_n"))
    )
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return held.select(F.col("_pid").alias("_opid"), F.col(key).alias("_okey"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def running_in_group(rows: DataFrame, key: str, order: Sequence[Column], inside: Column, total: Column, name: str) -> DataFrame:
    """``rows`` of ``ranged`` with a running value over the whole group:
    ``inside`` (a window function) runs in the range, ``total`` (an aggregate)
    is what the ranges in front add."""
    window = Window.partitionBy("_pid", key).orderBy(*order)
    local = rows.withColumn("_local", inside.over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    offsets = edge_offsets(rows, key, total)
    cond = (F.col("_pid") == F.col("_opid")) & F.col(key).eqNullSafe(F.col("_okey"))
    return (
        local.join(F.broadcast(offsets), cond, "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0)))
        .drop("_pid", "_local", "_off", "_opid", "_okey")
    )


def rank_in_group(df: DataFrame, key: str, order: Sequence[Column], name: str = "rnk",
                  parts: int | None = None) -> DataFrame:
    """Row number of every row inside its group, skew-safe (F1).

    A plain window sends each group to one task. Here the rows are
    range-partitioned on (key, order...) and written once (``ranged``): the one
    shuffle of the rows. Each range numbers its rows; groups cut by a range
    boundary are moved by their rows in the ranges in front.
    """
    ranked = running_in_group(ranged(df, key, order, parts), key, order, F.row_number(), F.count(F.lit(1)), name)
    return ranked.withColumn(name, F.col(name).cast("int"))


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the last row per key by ``order`` (F3), as an aggregate: ``max_by``
    combines map-side, so a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(key).agg(F.max_by(F.struct(*others), ordering).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
