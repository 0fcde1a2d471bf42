"""A document table stored by id bucket: a load rewrites only what it touches.

Layout of a table folder::

    data/_bucket=<b>/    documents whose id hashes to b; b < 0: documents without an id, one folder a load
    layout/              the number of buckets, fixed when the table is made
    loads/               one row per finished load
    pending/             the buckets that a load is about to put in place

A load finds the buckets of its ids, reads those of the table (partition
pruning), merges them with the latest row per id, and writes the result to
``pending``. Once that is complete it replaces the buckets by a dynamic
partition overwrite; files of other buckets keep their names and times. If
the driver dies in between, the next ``load`` or ``recover`` puts the complete
``pending`` in place again (replacing buckets twice gives the same table) and
drops an incomplete one. Loads of one table must not run at the same time, and
a reader that must not see a half-replaced table runs between loads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.documents import as_documents, load_status, stamp
from strata.operators.relational import latest_per_key
from strata.session import delete_path, materialize, path_exists, release
from strata.sinks.writers import balanced_by_key

BUCKET = "_bucket"
BUCKETS = 256


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Make an empty table; ``buckets`` should leave a few hundred MB in each."""
    if path_exists(spark, f"{path}/layout"):
        raise FileExistsError(f"{path} is a keyed table already")
    spark.range(1).select(F.lit(int(buckets)).cast("long").alias("buckets")).write.parquet(f"{path}/layout")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/layout").first().buckets


def _has_data(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/loads")


def loads(spark: SparkSession, path: str) -> int:
    """Loads finished so far."""
    if not _has_data(spark, path):
        return 0
    return spark.read.parquet(f"{path}/loads").agg(F.max("load")).first()[0] + 1


def read(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The documents, optionally of some buckets only (a partition filter)."""
    df = spark.read.parquet(f"{path}/data")
    if buckets is not None:
        df = df.where(F.col(BUCKET).isin([int(b) for b in buckets]))
    return df.drop(BUCKET)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish or drop what a load that died has left; True if one was finished."""
    pending = f"{path}/pending"
    if not path_exists(spark, pending):
        return False
    complete = path_exists(spark, f"{pending}/_SUCCESS") and path_exists(spark, f"{path}/pending_load/_SUCCESS")
    if complete:
        _apply(spark, path)
    else:
        delete_path(spark, pending)
        delete_path(spark, f"{path}/pending_load")
    return complete


def _apply(spark: SparkSession, path: str) -> None:
    """Put the pending buckets in place and record the load; may be repeated."""
    ready = spark.read.parquet(f"{path}/pending")
    (ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/data"))
    record = spark.read.parquet(f"{path}/pending_load")
    number = record.first().load
    if loads(spark, path) <= number:
        record.coalesce(1).write.mode("append").parquet(f"{path}/loads")
    delete_path(spark, f"{path}/pending_load")  # without it the rest of pending is dropped
    delete_path(spark, f"{path}/pending")


def load(spark: SparkSession, path: str, new: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Merge ``new`` into the table: the latest row of an id (by ``order``)
    replaces the table's document; rows without an id are documents of their
    own. Returns counts of documents inserted and replaced and of rows
    superseded, taken from the data."""
    recover(spark, path)
    n, number = _buckets(spark, path), loads(spark, path)
    new = materialize(new, "keyed-load")
    known = new.where(F.col(id_col).isNotNull())
    latest = materialize(
        latest_per_key(known, id_col, order).withColumn(BUCKET, bucket_of(F.col(id_col), n)), "keyed-latest")
    touched = sorted(r[0] for r in latest.select(BUCKET).distinct().collect())  # at most the number of buckets
    # documents without an id: a folder of their own, so that they never rewrite older ones
    merged = latest.unionByName(
        new.where(F.col(id_col).isNull()).select(*[c for c in latest.columns if c != BUCKET], F.lit(-1 - number).alias(BUCKET)))
    old = None
    if _has_data(spark, path):
        old = spark.read.parquet(f"{path}/data").where(F.col(BUCKET).isin(touched))
        kept = old.join(latest.select(BUCKET, id_col), [BUCKET, id_col], "left_anti")
        merged = kept.select(*latest.columns).unionByName(merged)
    status = materialize(load_status(old, new, id_col), "keyed-status")
    rows = balanced_by_key(merged, [BUCKET])
    rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/pending")
    (status.groupBy().pivot("status", ["inserted", "replaced", "superseded"]).agg(F.first("n"))
     .withColumn("load", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/pending_load"))
    if touched or new.where(F.col(id_col).isNull()).limit(1).count():
        _apply(spark, path)
    else:  # nothing to put in place
        delete_path(spark, f"{path}/pending_load")
        delete_path(spark, f"{path}/pending")
    release(new)
    release(latest)
    return status


def push(spark: SparkSession, path: str, rows: DataFrame, id_col: str | None, ts: Column | None = None) -> DataFrame:
    """Load CSV-like rows as stamped documents ``(_id, doc)`` (A11, C24, C25):
    within the load the later row of the input wins; a row without an id gets
    a generated one, fixed before it is merged and counted."""
    ordered = stamp(rows, ts).withColumn("_order", F.monotonically_increasing_id())
    docs = materialize(as_documents(ordered, id_col, carry=["_order"]), "documents")
    merged = latest_per_key(docs, "_id", ["_order"]).drop("_order")
    superseded = docs.count() - merged.count()
    status = load(spark, path, merged, "_id", ["_id"])
    release(docs)
    return status.withColumn("n", F.when(F.col("status") == "superseded", F.lit(superseded)).otherwise(F.col("n")))
