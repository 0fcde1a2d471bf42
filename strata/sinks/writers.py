"""Sinks and table DDL.

Writers never overwrite the path they read from: operators that rewrite a
table (compaction, keyed load) write beside it and return the new path.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
          partition_by: Sequence[str] | None = None, dynamic: bool = False,
          header: bool | None = None, compression: str | None = None,
          max_records_per_file: int | None = None) -> str:
    """One sink call (B1-B6). ``dynamic=True`` replaces only the partitions
    present in ``df`` (per-write ``partitionOverwriteMode``, no session change).
    """
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    if header is not None:
        w = w.option("header", header)
    if compression:
        w = w.option("compression", compression)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.save(path)
    return path


@contextmanager
def open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Partitioned writes in here keep a file open for each partition value of
    a task instead of sorting the task's rows by it first. From ``n`` values in
    one task on Spark sorts the rest as usual."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(max(n, int(was or 0))))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def cluster_for_write(df: DataFrame, keys: Sequence[str], n: int, spread: int = 1) -> DataFrame:
    """Hash-repartition by the partition keys before a partitioned write (K2).

    ``spread > 1`` adds a salt so one hot key value is written by ``spread``
    tasks instead of one; each key then gets at most ``spread`` files per
    write instead of one file per input partition.
    """
    if spread <= 1:
        return df.repartition(n, *keys)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    return df.withColumn("_salt", salt).repartition(n, *keys, "_salt").drop("_salt")


def balanced_by_key(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Deal rows out for a partitioned write (K2): rows of a partition value
    come together, and AQE splits the shuffle blocks of a value that is larger
    than the advisory partition size over several tasks, whatever the rows
    look like (equal rows, NULL keys) and however many values there are.

    One evaluation of the input, no statistics pass, no join. Bound the files
    with ``max_records_per_file`` of the write. ``n`` asks for so many
    partitions before AQE sizes them.
    """
    return df.hint("rebalance", *([int(n)] if n else []), *[F.col(k) for k in keys])


def fan_out(df: DataFrame, sinks: Iterable[tuple[str, str] | tuple[str, str, dict]]) -> int:
    """Write one result to several sinks with one evaluation.

    The result is materialized once in the shared checkpoint folder, so a lost
    executor costs a re-read and not a recomputation; the copy is deleted
    after the last write. Returns the row count (of the copy's metadata).
    """
    from strata.session import materialize, release

    held = materialize(df, "fan-out")
    try:
        for spec in sinks:
            path, fmt = spec[0], spec[1]
            opts = spec[2] if len(spec) > 2 else {}
            write(held, path, fmt, **opts)
        return held.count()
    finally:
        release(held)


def ensure_db(spark: SparkSession, name: str, location: str | None = None, use: bool = True) -> None:
    """CREATE DATABASE IF NOT EXISTS, then USE it."""
    loc = f" LOCATION {_sql_lit(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{loc}")
    if use:
        spark.sql(f"USE {name}")


def ensure_table(spark: SparkSession, name: str, columns: str,
                 partition_by: Sequence[str] | None = None,
                 location: str | None = None, fmt: str = "parquet") -> None:
    """CREATE TABLE IF NOT EXISTS ... USING <fmt> [PARTITIONED BY].

    ``columns`` is DDL text, partition columns included.
    """
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    loc = f" LOCATION {_sql_lit(location)}" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt}{part}{loc}")


def insert_partition(spark: SparkSession, table: str, spec: dict[str, object],
                     df: DataFrame, overwrite: bool = False) -> None:
    """INSERT INTO t PARTITION (k=v, ..) SELECT .. from a frame."""
    view = f"_ins_{table.replace('.', '_')}_{abs(hash(tuple(spec.items()))) % 10**8}"
    df.createOrReplaceTempView(view)
    parts = ", ".join(f"{k}={_sql_lit(v)}" for k, v in spec.items())
    verb = "OVERWRITE" if overwrite else "INTO"
    spark.sql(f"INSERT {verb} {table} PARTITION ({parts}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def _sql_lit(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def repair(spark: SparkSession, table: str) -> bool:
    """MSCK REPAIR TABLE on a partitioned table (B14); unpartitioned tables
    have no partition metadata to load and are left alone (returns False)."""
    cols = spark.catalog.listColumns(table)
    if not any(c.isPartition for c in cols):
        return False
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return True


def small_files(df: DataFrame, path: str, bucket_col: str, n_dirs: int, key: str) -> str:
    """Small-file producer (B15): one job writes ``n_dirs`` directories, each
    with many small files (no per-directory driver loop)."""
    out = df.withColumn(bucket_col, F.pmod(F.col(key), F.lit(n_dirs)))
    out.write.mode("overwrite").partitionBy(bucket_col).parquet(path)
    return path


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = 128 << 20,
            fmt: str = "parquet", partition_by: Sequence[str] | None = None) -> str:
    """Rewrite a folder of small files into files of about ``target_bytes``
    (B16). The byte total comes from a distributed listing of ``src``; the
    result goes to ``dst`` (never over the input).

    In a partitioned layout a value's rows come together, a value holding a
    third of the data is written by many tasks, and files are bounded by the
    rows that fill ``target_bytes``; rows with a NULL partition key are kept.
    """
    from strata.sources.inventory import inventory

    total = inventory(spark, src).agg(F.sum("length")).first()[0] or 0
    n = max(1, math.ceil(total / target_bytes))
    df = spark.read.format(fmt).load(src)
    w = None
    if partition_by:
        keys = list(partition_by)
        # rows that fill one target-sized file, from two scalars (bytes listed, rows counted)
        rows_total = df.count()
        rows_per_file = max(1, (target_bytes * rows_total) // max(total, 1))
        w = (balanced_by_key(df, keys).write.mode("overwrite").format(fmt)
             .option("maxRecordsPerFile", rows_per_file).partitionBy(*keys))
    else:
        w = df.repartition(n).write.mode("overwrite").format(fmt)
    w.save(dst)
    return dst


def pack(df: DataFrame, path: str, key: str, codec: str = "zstd", fmt: str = "parquet",
         max_records_per_file: int | None = None) -> str:
    """Packed output: one compressed folder per key value.

    No shuffle: each task writes its own rows of each key, so a hot key is
    written by all tasks that hold it; ``maxRecordsPerFile`` bounds file size.
    """
    return write(df, path, fmt, partition_by=[key], compression=codec,
                 max_records_per_file=max_records_per_file)


def ledger_append(spark: SparkSession, new: DataFrame, path: str,
                  key: str = "identifier", extra: Sequence[str] = ()) -> DataFrame:
    """Append identifiers not yet in the ledger.

    Idempotent: replaying the same batch appends nothing. ``extra`` columns
    are recorded beside the identifier (e.g. the directory it was derived
    from). The ledger is a parquet folder; appends add files, existing files
    are never rewritten.
    """
    from strata.session import path_exists

    incoming = (
        new.select(F.trim(F.col(key)).alias(key), *extra)
        .where(F.col(key) != "")
        .dropDuplicates([key, *extra])
    )
    if path_exists(spark, path):
        existing = spark.read.parquet(path).select(key, *extra)
        same = None  # NULLs in ``extra`` are equal, so that a replay appends nothing
        for c in [key, *extra]:
            match = incoming[c].eqNullSafe(existing[c])
            same = match if same is None else same & match
        incoming = incoming.join(existing, same, "left_anti")
    incoming.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, path: str, col: str = "value") -> str:
    """One text line per row (B13 export form)."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path
