"""File and table sources.

Every reader returns a lazy DataFrame; nothing is listed or read on the
driver beyond what Spark's own file index does.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# Tables the test data ships (one parquet file each).
TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
         schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Self-describing formats (A5 parquet, A6 orc) and anything else by name."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def read_csv(spark: SparkSession, path: str | list[str],
             schema: T.StructType | str | None = None, header: bool = True,
             infer: bool = False, **options: object) -> DataFrame:
    """CSV scan (A7, A8, A10, A11).

    A declared schema is the default; ``infer=True`` samples the files like
    ``inferSchema``. A headerless file needs a schema (its columns are
    otherwise ``_c0 ..`` strings and a join on a named key cannot resolve).
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    elif not header:
        raise ValueError("a headerless CSV needs a schema")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as ``value``."""
    return spark.read.text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Identifier set from a line file: trimmed, blank lines dropped, distinct (H5)."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("identifier"))
        .where(F.col("identifier") != "")
        .distinct()
    )


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None,
                limit: int | None = None, skipped: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Named set of tables (A14). Unreadable tables are skipped with a warning
    and, when the caller passes ``skipped``, named there with the reason;
    ``limit`` keeps the first n rows (the reference's sampling mode), the
    default is the whole table. File listing and schema reading are driver
    work, so the tables are opened concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    wanted = list(names or TEST_TABLES)
    reasons: dict[str, str] = {}

    def open_one(name: str) -> DataFrame | None:
        try:
            return load_table(spark, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - reported, not fatal
            reasons[name] = _reason(e)
            return None

    with ThreadPoolExecutor(max_workers=min(8, max(1, len(wanted)))) as pool:
        opened = list(pool.map(open_one, wanted))
    out: dict[str, DataFrame] = {}
    for name, df in zip(wanted, opened):
        if df is not None:
            out[name] = df.limit(limit) if limit else df
    _report(reasons, skipped)
    return out


def _reason(e: Exception) -> str:
    """Error class of a Spark error, else the exception's name."""
    return (getattr(e, "getCondition", lambda: None)() or type(e).__name__).split(".")[0]


def _report(reasons: dict[str, str], skipped: dict[str, str] | None) -> None:
    for name, why in sorted(reasons.items()):
        log.warning("table %s skipped: %s", name, why)
    if skipped is not None:
        skipped.update(reasons)


def table_status(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> DataFrame:
    """One row per wanted table: its rows, or why it could not be read."""
    skipped: dict[str, str] = {}
    found = load_tables(spark, sf_dir, names, skipped=skipped)
    out = spark.createDataFrame([(n, "unreadable", w, None) for n, w in sorted(skipped.items())],
                                "table_name string, status string, reason string, n long")
    for name, df in found.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), "n"))
    return out


def jdbc_tables(spark: SparkSession, url: str, schema: str = "public",
                properties: dict[str, str] | None = None) -> DataFrame:
    """Table names of a database schema through its catalog view."""
    query = (
        "(SELECT table_name FROM information_schema.tables "
        f"WHERE table_schema = '{schema}') AS t"
    )
    return spark.read.jdbc(url, query, properties=properties or {})


def jdbc_load_tables(spark: SparkSession, url: str, names: Iterable[str],
                     limit: int | None = None, properties: dict[str, str] | None = None,
                     skipped: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Read each table over JDBC; unreadable ones as in ``load_tables`` (A14, database form)."""
    reasons: dict[str, str] = {}
    out: dict[str, DataFrame] = {}
    for name in names:
        try:
            df = spark.read.jdbc(url, name, properties=properties or {})
        except Exception as e:  # noqa: BLE001 - reported, not fatal
            reasons[name] = _reason(e)
            continue
        out[name] = df.limit(limit) if limit else df
    _report(reasons, skipped)
    return out


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Temp view registration (A16); returns the frame for chaining."""
    df.createOrReplaceTempView(name)
    return df
