"""Generated tables (A1-A4).

Columns are functions of a seed and of each row's id (see
``functions.generators``). The ``with_*`` functions add them to any table with
ids, a given one or ``synth_range``; values don't depend on how it is
partitioned. Whole-stage codegen, no Python per row, no driver-side list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import generators as G

# Fixed values for generated user rows (the reference's word lists).
FIRST_NAMES = [
    "John", "Jane", "Michael", "Emily", "David", "Sarah", "James", "Emma",
    "William", "Olivia", "Robert", "Sophia", "Charles", "Ava", "Joseph", "Mia",
]
LAST_NAMES = [
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller",
    "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson",
]
EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "example.com"]
STATUSES = ["Active", "Inactive", "Pending", "Suspended"]
LOGIN_START, LOGIN_END = "2023-01-01", "2024-12-31"


def synth_range(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """``id`` 0..n-1 over a fixed number of partitions (A1)."""
    return spark.range(0, n, 1, parts)


def with_measures(ids: DataFrame, id_col: str = "id", max_cat: int = 1000, max_val: float = 100.0, seed: int = 42,
                  columns: tuple[str, ...] = ("id", "category", "value", "group")) -> DataFrame:
    """(id, category 1..max_cat, value [0,max_val), group A..Z from id) (A2, A3).

    ``columns`` selects the shape: the three-column form of A3 drops ``group``.
    """
    return ids.select(F.col(id_col).alias("id")).select(
        "id",
        G.uniform_int(max_cat, seed).alias("category"),
        G.uniform(max_val, seed + 1).alias("value"),
        G.letter_from_id("id").alias("group"),
    ).select(*columns)


def with_two_categories(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """(id, rand1 [0,100), rand2 [0,1000), category A/B) (fixture P2)."""
    return ids.select(F.col(id_col).alias("id")).select(
        "id",
        G.uniform(100, seed).alias("rand1"),
        G.uniform(1000, seed + 1).alias("rand2"),
        F.when(G.unit(seed + 2) > 0.5, "A").otherwise("B").alias("category"),
    )


def with_partitions(ids: DataFrame, id_col: str = "id", days: int = 365, seed: int = 42, today: Column | None = None) -> DataFrame:
    """(id, category A/B, date today..today+days-1, value1, value2) (fixture P3)."""
    return ids.select(F.col(id_col).alias("id")).select(
        "id",
        F.when(G.unit(seed) > 0.5, "A").otherwise("B").alias("category"),
        G.days_from_today(days, seed + 1, today=today).alias("date"),
        G.uniform(100, seed + 2).alias("value1"),
        G.uniform(1000, seed + 3).alias("value2"),
    )


def with_users(ids: DataFrame, id_col: str = "id", seed: int = 7) -> DataFrame:
    """User rows (A4): id, user, email from user, last_login (whole day),
    activity_score (2 decimals, 0..100), status."""
    base = ids.select(F.col(id_col).alias("id")).select(
        "id",
        F.concat_ws(" ", G.pick(FIRST_NAMES, seed), G.pick(LAST_NAMES, seed + 1)).alias("user"),
        G.pick(EMAIL_DOMAINS, seed + 2).alias("_domain"),
        G.date_in_span(LOGIN_START, LOGIN_END, seed + 3).cast("timestamp_ntz").alias("last_login"),
        G.round2(G.uniform(100, seed + 4)).alias("activity_score"),
        G.pick(STATUSES, seed + 5).alias("status"),
    )
    return base.select(
        "id", "user", G.email_from_name(F.col("user"), F.col("_domain")).alias("email"),
        "last_login", "activity_score", "status",
    )


def synth_measures(spark: SparkSession, n: int, parts: int, **options) -> DataFrame:
    return with_measures(synth_range(spark, n, parts), **options)


def synth_two_categories(spark: SparkSession, n: int, parts: int, seed: int = 42) -> DataFrame:
    return with_two_categories(synth_range(spark, n, parts), seed=seed)


def synth_partitioned(spark: SparkSession, n: int, parts: int, days: int = 365, seed: int = 42) -> DataFrame:
    return with_partitions(synth_range(spark, n, parts), days=days, seed=seed)


def synth_users(spark: SparkSession, n: int, seed: int = 7, parts: int | None = None) -> DataFrame:
    """Users 1..n (A4), about a million in a partition."""
    return with_users(spark.range(1, n + 1, 1, parts or max(1, -(-n // 1_000_000))), seed=seed)
