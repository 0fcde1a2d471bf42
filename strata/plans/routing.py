"""Numeric routing of projects and numbers to directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.paths import object_key

# The explicit number bands (inclusive upper bounds) and codes.
NUMBER_BANDS = [(999, "0"), (1999, "1"), (2999, "2")]


def route_projects(mapping: DataFrame, max_id: int, src_base: str, dst_base: str,
                   existing: DataFrame, user: str = "username", project: str = "project_name",
                   pid: str = "project_id", band_width: int = 1000) -> DataFrame:
    """Copy plan for project mappings.

    Band = id div band_width; source = src_base/band; target =
    dst_base/user/project/id. ``action`` is ``copy`` when the source directory
    is in ``existing`` (column ``dir``), else ``warn_missing_source``. Rows
    whose id is not an integer or is above ``max_id`` are not routed: they
    come out with NULL band, source and target and the action
    ``reject_not_a_number`` or ``reject_above_limit``.
    """
    ids = mapping.select(
        F.col(user).alias("username"), F.col(project).alias("project_name"),
        F.expr(f"try_cast({pid} AS BIGINT)").alias("project_id"),
    )
    routed = F.col("project_id") <= max_id
    band = F.when(routed, F.expr(f"project_id div {int(band_width)}"))
    planned = ids.select(
        "username", "project_name", "project_id", band.alias("band"),
        F.when(routed, object_key(src_base.rstrip("/"), band.cast("string"))).alias("source"),
        F.when(routed, object_key(dst_base.rstrip("/"), F.col("username"), F.col("project_name"),
                                  F.col("project_id").cast("string"))).alias("target"),
    )
    have = existing.select(F.regexp_replace("dir", "/+$", "").alias("source")).distinct()
    # existence is a semi join on the (few) source directories
    marked = planned.join(have.withColumn("_exists", F.lit(True)), "source", "left")
    return marked.select(
        "username", "project_name", "project_id", "band", "source", "target",
        F.when(F.col("project_id").isNull(), "reject_not_a_number")
        .when(F.col("project_id") > max_id, "reject_above_limit")
        .when(F.col("_exists"), "copy").otherwise("warn_missing_source").alias("action"),
    )


def route_numbers(lines: DataFrame, base: str, col: str = "value") -> DataFrame:
    """Route number lines to ``base/<code>/<number>`` by explicit bands.

    Lines are trimmed and blank ones skipped. Numbers <= 999 (negatives too)
    get code 0, <= 1999 code 1, <= 2999 code 2; larger numbers and text that
    is not an integer are kept as rejected rows with a reason.
    """
    trimmed = lines.select(F.trim(F.col(col)).alias("line")).where(F.col("line") != "")
    num = F.expr("try_cast(line AS BIGINT)")
    code = F.lit(None).cast("string")
    for upper, c in reversed(NUMBER_BANDS):
        code = F.when(F.col("number") <= upper, F.lit(c)).otherwise(code)
    with_num = trimmed.select("line", num.alias("number")).withColumn("code", code)
    return with_num.select(
        "line", "number", "code",
        F.when(F.col("code").isNotNull(),
               object_key(base.rstrip("/"), F.col("code"), F.col("number").cast("string"))).alias("path"),
        F.when(F.col("number").isNull(), "not a number")
        .when(F.col("code").isNull(), "out of range").alias("reason"),
    )
