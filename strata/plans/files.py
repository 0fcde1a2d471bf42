"""Plans over a file inventory ``(path, length, mtime)`` and a ledger.

The reference's backup, upload, sync and retention scripts decide *which*
files and directories to move, pack or delete; those decisions are built here
as tables (C10-C15, C21, C26, D7, D9, E13-E15). Moving bytes is left to the
tool that reads the plan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.paths import (
    basename, dirname, last_two_parts, minus_hours, object_key, relative_to, stamp_name,
)

MULTIPART_BYTES = 100 * 1024 * 1024  # size from which a bundle is sent in parts


def glob_regex(pattern: str) -> str:
    """Shell glob on a file name (``*``, ``?``) as an anchored regex."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def name_matches(path: Column, patterns: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | basename(path).rlike(glob_regex(p))
    return cond


def older_than(inv: DataFrame, hours: float, now: Column) -> DataFrame:
    """Files whose modification time is strictly before now - hours."""
    return inv.where(F.col("mtime") < minus_hours(now, hours))


def match_files(inv: DataFrame, include: Sequence[str] | None = None,
                exclude: Sequence[str] | None = None, min_length: int | None = None) -> DataFrame:
    """Name include / exclude globs and a minimum size."""
    out = inv
    if include:
        out = out.where(name_matches(F.col("path"), include))
    if exclude:
        out = out.where(~name_matches(F.col("path"), exclude))
    if min_length is not None:
        out = out.where(F.col("length") >= min_length)
    return out


def file_keys(inv: DataFrame, prefix: str, root: str) -> DataFrame:
    """Both object-key rules (I11, I12, I14):

    * ``key_by_dir``: prefix / name of the file's directory / file name;
    * ``key_by_root``: prefix / path relative to ``root`` (NULL outside it).
    """
    return inv.select(
        "path",
        object_key(prefix, basename(dirname(F.col("path"))), basename(F.col("path"))).alias("key_by_dir"),
        F.when(relative_to(F.col("path"), root).isNotNull(),
               object_key(prefix, relative_to(F.col("path"), root))).alias("key_by_root"),
    )


def key_collisions(df: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that more than one distinct item maps to."""
    return (
        df.select(key, item).distinct()
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))
        .where(F.col("n_items") > 1)
    )


def manifest(inv: DataFrame, now: Column, suffix: str = ".tar.zst",
             multipart_bytes: int = MULTIPART_BYTES) -> DataFrame:
    """One row per directory: files, bytes, size class, identifier and bundle
    name (A17, E14, C21, I13, I15)."""
    by_dir = inv.groupBy(dirname(F.col("path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("long").alias("total_bytes")
    )
    return by_dir.select(
        "dir", "n_files", "total_bytes",
        F.when(F.col("total_bytes") >= multipart_bytes, "multipart").otherwise("single").alias("size_class"),
        last_two_parts(F.col("dir")).alias("identifier"),
        stamp_name(last_two_parts(F.col("dir")), now, suffix).alias("bundle_name"),
    )


def pending(items: DataFrame, ledger: DataFrame, key: str = "identifier") -> DataFrame:
    """Items whose identifier is not in the ledger (D7, H2). When both sides
    record the directory, it is matched instead of the joined text."""
    if "dir" in items.columns and "dir" in ledger.columns:
        key = "dir"
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def sync_plan(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str,
              exclude: Sequence[str] | None = None) -> DataFrame:
    """One-way sync decision per source file.

    ``copy_new`` when the relative path is absent at the destination,
    ``copy_size`` when sizes differ, ``copy_newer`` when the source is newer,
    else ``skip``. Source files matching an ``exclude`` glob are left out.
    """
    if exclude:
        src = match_files(src, exclude=exclude)
    s = src.select(relative_to(F.col("path"), src_root).alias("rel"),
                   F.col("path").alias("source"), F.col("length").alias("s_len"),
                   F.col("mtime").alias("s_mtime")).where(F.col("rel").isNotNull())
    d = dst.select(relative_to(F.col("path"), dst_root).alias("rel"),
                   F.col("length").alias("d_len"), F.col("mtime").alias("d_mtime")
                   ).where(F.col("rel").isNotNull())
    action = (
        F.when(F.col("d_len").isNull(), "copy_new")
        .when(F.col("s_len") != F.col("d_len"), "copy_size")
        .when(F.col("s_mtime") > F.col("d_mtime"), "copy_newer")
        .otherwise("skip")
    )
    return s.join(d, "rel", "left").select(
        "rel", "source", F.concat(F.lit(dst_root.rstrip("/") + "/"), F.col("rel")).alias("target"),
        action.alias("action"),
    )


def usage_percent(inv: DataFrame, capacity_bytes: int) -> DataFrame:
    """Used bytes and integer percent of a capacity, like shell arithmetic."""
    return inv.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("used_bytes")).select(
        "used_bytes", F.expr(f"(used_bytes * 100) div {int(capacity_bytes)}").alias("usage_pct")
    )


def session_dirs(inv: DataFrame, base: str, workspaces: DataFrame) -> DataFrame:
    """Directories ``<base>/<ws>/../<ws>-user-*`` for listed workspaces.

    The workspace list is joined (it is a parameter table), and the name
    pattern is anchored on the workspace name, so ``alpha`` does not pick up
    ``alpha-regional-user-*``.
    """
    b = base.rstrip("/") + "/"
    rel = relative_to(F.col("path"), b)
    parts = F.split(rel, "/")
    files = inv.select("path", F.element_at(parts, 1).alias("workspace"), parts.alias("_parts")).where(
        F.col("workspace").isNotNull()
    )
    with_ws = files.join(workspaces.select("workspace").distinct(), "workspace")
    # index of the first directory part named <ws>-user-*
    idx = F.array_position(
        F.transform(F.slice("_parts", 1, F.size("_parts") - 1),
                    lambda p: p.startswith(F.concat(F.col("workspace"), F.lit("-user-")))),
        True,
    )
    return with_ws.where(idx > 0).select(
        "workspace",
        F.concat(F.lit(b), F.array_join(F.slice("_parts", 1, idx.cast("int")), "/")).alias("dir"),
        "path",
    )


def retention_plan(inv: DataFrame, base: str, workspaces: DataFrame, hours: float, now: Column,
                   capacity_bytes: int, max_pct: int, pattern: str = "*log.gz") -> DataFrame:
    """Retention actions (C11, C12, C15, E13):

    * ``delete_file`` — files under ``base`` named ``pattern`` older than ``hours``;
    * ``delete_dir`` — user-session directories of the listed workspaces, only
      when usage of ``capacity_bytes`` is above ``max_pct`` (strict).

    One pass; the usage figure is taken before any deletion.
    """
    under = inv.where(F.col("path").startswith(base.rstrip("/") + "/"))
    old = match_files(older_than(under, hours, now), include=[pattern]).select(
        F.lit("delete_file").alias("action"), F.col("path").alias("target"),
        F.lit(None).cast("string").alias("workspace"),
    )
    # one scalar decides whether session directories go too
    pct = usage_percent(inv, capacity_bytes).first()["usage_pct"]
    dirs = (
        session_dirs(inv, base, workspaces).select("workspace", "dir").distinct()
        .where(F.lit(pct > max_pct))
        .select(F.lit("delete_dir").alias("action"), F.col("dir").alias("target"), "workspace")
    )
    return old.unionByName(dirs)


def outcomes(status: DataFrame, col: str = "status") -> DataFrame:
    """Count per outcome."""
    return status.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def backup_status(requested: DataFrame, inv: DataFrame, ledger: DataFrame) -> DataFrame:
    """Status per requested base and sub-directory (A20, D7, J4 outcome column):
    ``invalid`` for a base with no files, ``skipped`` for a directory already in
    the ledger, ``planned`` for the rest."""
    from strata.sources.inventory import check_requested

    checked = check_requested(requested.sparkSession, requested, inv, "dir")
    invalid = checked.where(F.col("status") == "invalid").select(
        F.col("dir").alias("base"), F.lit(None).cast("string").alias("dir"), "status"
    )
    found = checked.where(F.col("status") == "found").select(F.col("dir").alias("base"))
    leaf = inv.select(dirname(F.col("path")).alias("dir")).distinct()
    sub = leaf.withColumn("base", dirname(F.col("dir"))).join(found, "base", "left_semi")
    keyed = sub.withColumn("identifier", last_two_parts(F.col("dir")))
    done = ledger.select("identifier").distinct().withColumn("_done", F.lit(True))
    marked = keyed.join(done, "identifier", "left").select(
        "base", "dir", F.when(F.col("_done"), "skipped").otherwise("planned").alias("status")
    )
    return marked.unionByName(invalid)


def requested_frame(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """A parameter list of directories as a one-column table."""
    return spark.createDataFrame([(d,) for d in dirs], "dir string")


def attempt_outcomes(log: DataFrame, item: str = "item", attempt: str = "attempt",
                     ok: str = "ok", max_attempts: int = 3) -> DataFrame:
    """Final outcome per item from an attempt log (J4): ``uploaded`` when an
    attempt within ``max_attempts`` succeeded, else ``failed`` (given up),
    also for items that the log only has beyond the limit (0 tries used);
    ``attempts`` counts the tries used. An aggregate, so a hot item is
    combined map-side."""
    within = F.col(attempt) <= max_attempts
    return log.groupBy(item).agg(
        F.min(F.when(within & F.col(ok), F.col(attempt))).alias("first_ok"),
        F.coalesce(F.max(F.when(within, F.col(attempt))), F.lit(0)).alias("last_attempt"),
    ).select(
        item,
        F.when(F.col("first_ok").isNotNull(), "uploaded").otherwise("failed").alias("status"),
        F.coalesce("first_ok", "last_attempt").alias("attempts"),
    )


def watch_dirs_of(inv: DataFrame, watch: DataFrame, recursive: bool = True) -> DataFrame:
    """Pair each file with every watch directory it lies under (one level or
    any depth). Ancestors are expanded per file (bounded by path depth) and
    equi-joined with the watch list — no prefix nested loop."""
    from strata.sources.inventory import ancestors

    w = watch.select(F.regexp_replace("dir", "/+$", "").alias("watch_dir")).distinct()
    if recursive:
        cand = ancestors(inv.withColumn("_parent", dirname(F.col("path"))), "_parent").withColumnRenamed(
            "ancestor", "watch_dir")
    else:
        cand = inv.withColumn("watch_dir", dirname(F.col("path")))
    return cand.join(w, "watch_dir").drop("_parent")


def upload_plan(inv: DataFrame, watch: DataFrame, hours: float, now: Column, prefix: str,
                suffix: str = ".gz", key_rule: str = "relative", recursive: bool = True) -> DataFrame:
    """Upload decisions for watched folders.

    Files named ``*<suffix>`` under a watch directory get an object key —
    ``relative``: prefix / path relative to the watch dir; ``dir_name``:
    prefix / watch dir name / file name — and an action: ``wait_young``
    until older than ``hours``, then ``skip_empty`` for empty files, else
    ``upload``. ``watch`` is a parameter table with column ``dir``.
    """
    files = watch_dirs_of(match_files(inv, include=[f"*{suffix}"]), watch, recursive)
    rel = F.expr("substring(path, length(watch_dir) + 2)")
    if key_rule == "dir_name":
        key = object_key(prefix, basename(F.col("watch_dir")), basename(F.col("path")))
    else:
        key = object_key(prefix, rel)
    action = (
        F.when(~(F.col("mtime") < minus_hours(now, hours)), "wait_young")
        .when(F.col("length") == 0, "skip_empty")
        .otherwise("upload")
    )
    return files.select("path", "watch_dir", key.alias("object_key"), action.alias("action"))


def backup_plan(inv: DataFrame, bases: Sequence[str] | DataFrame, ledger: DataFrame, now: Column,
                prefix: str = "backups", suffix: str = ".tar.zst",
                multipart_bytes: int = MULTIPART_BYTES) -> DataFrame:
    """Incremental backup plan (A17, D7, E14, C21, I13-I15): one row per
    first-level sub-directory of each base, sized over all files below it,
    with its identifier, bundle name, object key, size class and status
    (``skipped`` when the ledger has the identifier, else ``planned``).

    Bases are a parameter list or a table (column ``base``); see
    ``inventory.under_bases`` for the one pass over the files.
    """
    from strata.sources.inventory import under_bases

    # a directory of two nested bases is one bundle
    sized = under_bases(inv, bases).drop("base").distinct()
    ident = last_two_parts(F.col("dir"))
    bundle = stamp_name(ident, now, suffix)
    # "a_b/c" and "a/b_c" share the identifier text; a ledger that records
    # the directory is matched on it, a legacy line-file ledger on the text
    if "dir" in ledger.columns:
        done = ledger.select(F.col("dir").alias("_id")).distinct().withColumn("_done", F.lit(True))
        match = F.col("dir") == F.col("_id")
    else:
        done = ledger.select(F.col("identifier").alias("_id")).distinct().withColumn("_done", F.lit(True))
        match = F.col("identifier") == F.col("_id")
    return (
        sized.withColumn("identifier", ident)
        .join(done, match, "left")
        .select(
            "dir", "identifier", "n_files", "total_bytes",
            F.when(F.col("total_bytes") >= multipart_bytes, "multipart").otherwise("single").alias("size_class"),
            bundle.alias("bundle_name"),
            object_key(prefix, bundle).alias("object_key"),
            F.when(F.col("_done"), "skipped").otherwise("planned").alias("status"),
        )
    )


def commit_backup(spark: SparkSession, plan: DataFrame, plan_path: str, ledger_path: str) -> DataFrame:
    """Write the planned rows, then record their identifiers in the ledger.

    The ledger is appended only after the plan is safely written, and the
    append is idempotent, so a crash between the two steps replays cleanly.
    """
    from strata.sinks.writers import ledger_append

    planned = plan.where(F.col("status") == "planned")
    planned.write.mode("overwrite").parquet(plan_path)
    return ledger_append(spark, spark.read.parquet(plan_path), ledger_path, extra=["dir"])
