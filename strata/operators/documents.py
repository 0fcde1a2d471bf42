"""Keyed document load: later rows replace earlier ones.

Without a merge-capable table format the merge is
``target LEFT ANTI new`` + ``new``, written to a new path; the caller swaps
paths. The latest row per id is an aggregate (``max_by``), so a hot id is
combined map-side instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.relational import latest_per_key
from strata.session import materialize


def stamp(df: DataFrame, ts: Column | None = None, name: str = "ingestion_timestamp") -> DataFrame:
    """Add the ingestion time (C24); tests pass a literal clock."""
    return df.withColumn(name, ts if ts is not None else F.current_timestamp())


def as_documents(df: DataFrame, id_col: str | None, carry: Sequence[str] = ()) -> DataFrame:
    """(``_id``, ``doc`` struct of the other columns, *carry).

    A row without an id (no id column, or NULL in it) gets a generated one of
    its own, so equal rows stay separate documents. Generated ids are random:
    write the result before it is read twice. ``carry`` columns are kept
    beside the document (e.g. an ordering), not inside it.
    """
    body = [c for c in df.columns if c not in carry]
    doc_id = F.uuid()
    if id_col and id_col in body:
        doc_id = F.coalesce(F.col(id_col).cast("string"), doc_id)
    fields = [c for c in body if c != id_col]
    return df.select(doc_id.alias("_id"), F.struct(*[F.col(c) for c in fields]).alias("doc"), *carry)


def upsert_documents(target: DataFrame | None, new: DataFrame, id_col: str,
                     order: Sequence[str]) -> DataFrame:
    """Merge ``new`` into ``target`` by ``id_col``: the latest row of ``new`` per
    id (by ``order``) replaces the target's row; other target rows stay. Rows
    of ``new`` without an id replace nothing and are all kept."""
    known = F.col(id_col).isNotNull()
    latest = latest_per_key(new.where(known), id_col, order)
    unnamed = new.where(~known).select(*latest.columns)
    if target is None:
        return latest.unionByName(unnamed)
    kept = target.join(latest.select(id_col), id_col, "left_anti")
    return kept.unionByName(latest).unionByName(unnamed)


def load_documents(spark: SparkSession, new: DataFrame, target_path: str | None,
                   out_path: str, id_col: str, order: Sequence[str]) -> str:
    """Upsert into the table at ``target_path`` and write the result to
    ``out_path`` (never over the input); returns ``out_path``."""
    target = spark.read.parquet(target_path) if target_path else None
    upsert_documents(target, new, id_col, order).write.mode("overwrite").parquet(out_path)
    return out_path


def load_status(before: DataFrame | None, new: DataFrame, id_col: str) -> DataFrame:
    """Counts from data, not from a success message: documents ``inserted`` and
    ``replaced`` (together the rows written), and rows ``superseded`` by a later
    row of the same load. NULL ids are documents of their own."""
    per_id = new.groupBy(F.col(id_col).alias("_k")).agg(F.count(F.lit(1)).alias("rows")).select(
        "_k", "rows", F.when(F.col("_k").isNull(), F.col("rows")).otherwise(1).alias("docs"))
    if before is not None:
        old = before.select(F.col(id_col).alias("_k")).distinct().withColumn("_old", F.lit(True))
        per_id = per_id.join(old, "_k", "left")
    else:
        per_id = per_id.withColumn("_old", F.lit(None).cast("boolean"))
    totals = per_id.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (
        ("inserted", F.when(F.col("_old").isNull(), F.col("docs"))), ("replaced", F.when(F.col("_old"), F.col("docs"))),
        ("superseded", F.col("rows") - F.col("docs")))])
    return totals.select(F.expr("stack(3, 'inserted', inserted, 'replaced', replaced, 'superseded', superseded) AS (status, n)"))


def push_documents(spark: SparkSession, rows: DataFrame, target_path: str | None, out_path: str,
                   id_col: str | None, ts: Column | None = None) -> DataFrame:
    """Keyed load of CSV-like rows into a document table.

    Rows are stamped with the ingestion time; each row without an id becomes a
    document with a generated id; within the load the later row of the input
    wins (input order, as sequential indexing would), and loaded ids replace
    the target's documents. Generated ids are fixed by writing the documents
    once before they are merged and counted. The merged table goes to
    ``out_path``; returns status counts taken from the data.
    """
    ordered = stamp(rows, ts).withColumn("_order", F.monotonically_increasing_id())
    docs = materialize(as_documents(ordered, id_col, carry=["_order"]), "documents")
    before = spark.read.parquet(target_path) if target_path else None
    latest = latest_per_key(docs, "_id", ["_order"]).drop("_order")
    merged = latest if before is None else before.join(latest.select("_id"), "_id", "left_anti").unionByName(latest)
    merged.write.mode("overwrite").parquet(out_path)
    return load_status(before, docs, "_id")
