"""Exact deduplication by progressive refinement (operator 6).

Groups by byte length, then by the hash of a short prefix among lengths that
occur twice, then by SHA-256 of the whole text among (length, prefix) groups
that still have two rows. Only those last rows are hashed whole.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest id stays (null ids are smaller than
any other; if all are null, a null one stays). Rows that repeat id and text
are one document: in ``exact_classes`` each of them carries the decision of
that document, ``drop_exact_copies`` leaves one of them. Columns of ``docs``
beside id and text are never looked at. An empty table gives an empty one.

A group that holds a third of all rows is one partial row per task in each
aggregation; joins back to it have one row per group on the other side, which
Spark splits by itself (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, ascii_lower, fresh

PREFIX_CHARS = 128


def _repeats(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")


def refine(docs: DataFrame, text_col: str, n: str, prefix: str, alike: str) -> DataFrame:
    """``docs`` plus the byte length ``n``, the ``prefix`` hash and whether
    another row has the same two (``alike``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({
        n: F.octet_length(text),
        prefix: F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))),
    })
    narrow = rows.select(n, prefix)
    same_length = _repeats(narrow.select(n), n)
    same_prefix = _repeats(narrow.join(same_length, n, "left_semi"), n, prefix)
    return rows.join(same_prefix.withColumn(alike, F.lit(True)), [n, prefix], "left")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and
    text_sha256 (of the normalised text; the refinement itself only needs it
    for rows with ``alike``, the others get it for the report)."""
    scratch = Scratch(docs.sparkSession)
    rows = refine(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                  "text", "_n", "_prefix", "_alike")
    hashed = scratch.table(
        rows.select("doc_id", F.coalesce("_alike", F.lit(False)).alias("_alike"),
                    F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256")),
        "exact-hashed")
    groups = hashed.where("_alike").groupBy("text_sha256").agg(
        F.count("*").alias("_size"), F.max("doc_id").alias("_keep"))
    return (
        hashed.join(groups, "text_sha256", "left")
        .select(
            "doc_id",
            F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all its columns."""
    n, prefix, alike, sha, keep, tied = fresh(docs, "_n", "_prefix", "_alike", "_sha", "_keep", "_tied")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(refine(docs, text_col, n, prefix, alike), "exact-refined")
    alone = rows.where(F.col(alike).isNull()).select(*docs.columns)
    several = rows.where(F.col(alike)).withColumn(
        sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    best = (
        several.groupBy(sha, F.col(id_col).alias(keep)).agg(F.count("*").alias(tied))
        .groupBy(sha).agg(F.max(F.struct(keep, tied)).alias(keep))
        .select(sha, F.col(f"{keep}.{keep}").alias(keep), F.col(f"{keep}.{tied}").alias(tied)))
    stay = several.join(best, sha).where(F.col(id_col).eqNullSafe(F.col(keep)))
    once = stay.where(F.col(tied) == 1).select(*docs.columns)
    again = stay.where(F.col(tied) > 1).dropDuplicates([sha]).select(*docs.columns)
    return alone.unionByName(once).unionByName(again)
