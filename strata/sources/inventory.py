"""File inventories.

An inventory is a DataFrame ``(path, length, mtime)``. Folders are listed level
by level in tasks (see ``listing``); one level costs one listing of each base,
and empty files are there. Storage that tasks can't open by themselves is
listed by Spark's ``binaryFile`` source with ``content`` left unselected: the
driver then holds the listing, and empty files are missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.paths import dirname
from strata.session import path_exists
from strata.sources import listing

INVENTORY_COLUMNS = ("path", "length", "mtime")


def _norm_dir(p: str) -> str:
    return p.rstrip("/") or "/"


def inventory(spark: SparkSession, dirs: str | Iterable[str], recursive: bool = True,
              glob: str | None = None, modified_before: str | None = None) -> DataFrame:
    """Files under one or several bases.

    ``recursive=False`` lists the bases alone. ``glob`` filters file names;
    ``modified_before`` keeps files modified before a time.
    """
    bases = [dirs] if isinstance(dirs, str) else list(dirs)
    for b in bases:
        if not path_exists(spark, b):
            raise FileNotFoundError(f"no such folder: {b}")
    if all(listing.supported(b) for b in bases):
        found = listing.files(spark, bases, recursive, glob)
        if modified_before:
            found = found.where(F.col("mtime") < F.lit(modified_before).cast("timestamp_ntz"))
        return found
    return _by_source(spark, bases, recursive, glob, modified_before)


def _by_source(spark: SparkSession, bases: list[str], recursive: bool, glob: str | None, modified_before: str | None) -> DataFrame:
    """The same through Spark's own listing, for any storage that Spark knows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    listed = reader.load(bases).select(
        F.col("path"),
        F.col("length"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
    )
    listed = listed.withColumn("path", _strip_scheme(F.col("path")))
    if recursive:
        return listed
    wanted = [_norm_dir(_strip_scheme_text(b)) for b in bases]
    return listed.where(dirname(F.col("path")).isin(wanted))


def _strip_scheme_text(p: str) -> str:
    if p.startswith("file:"):
        p = p[len("file:"):]
        while p.startswith("//"):
            p = p[1:]
    return p


def _strip_scheme(c):
    """``file:/a/b`` and ``file:///a/b`` become ``/a/b``; other schemes are kept."""
    return F.regexp_replace(c, r"^file:(//)?", "")


def directories(inv: DataFrame) -> DataFrame:
    """Distinct parent directories of an inventory."""
    return inv.select(dirname(F.col("path")).alias("dir")).distinct()


def under_bases(inv: DataFrame, bases: Iterable[str] | DataFrame) -> DataFrame:
    """(base, dir, n_files, total_bytes): first-level sub-directories of each
    base, sized over all files below them (A17).

    One pass over the inventory, combined per parent directory before anything
    is joined; each directory is expanded to its ancestors (bounded by the path
    depth) and the parent of an ancestor is looked up among the bases, which
    are a table of any size (column ``base``).
    """
    spark = inv.sparkSession
    if not isinstance(bases, DataFrame):
        bases = spark.createDataFrame([(_norm_dir(b),) for b in bases], "base string")
    base = bases.select(F.regexp_replace("base", "/+$", "").alias("base")).distinct()
    leaf = inv.groupBy(dirname(F.col("path")).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("long").alias("total_bytes"))
    return (
        ancestors(leaf, "leaf").withColumnRenamed("ancestor", "dir")
        .withColumn("base", dirname(F.col("dir"))).join(base, "base")
        .groupBy("base", "dir").agg(F.sum("n_files").alias("n_files"), F.sum("total_bytes").alias("total_bytes"))
    )


def subdirectories(inv: DataFrame, bases: Iterable[str] | DataFrame) -> DataFrame:
    """First-level sub-directories of each base that contain files."""
    return under_bases(inv, bases).select("base", "dir")


def check_requested(spark: SparkSession, requested: DataFrame, inv: DataFrame,
                    dir_col: str = "dir") -> DataFrame:
    """Requested directories with a status: ``found`` when any listed file lies
    under it, else ``invalid`` (A20).

    Each leaf directory is expanded to its ancestors (bounded by path depth),
    so the membership test is an equi-join, never a prefix nested loop.
    """
    req = requested.select(F.regexp_replace(F.col(dir_col), "/+$", "").alias("dir")).distinct()
    found = ancestors(inv.select(dirname(F.col("path")).alias("leaf")).distinct(), "leaf")
    return (
        req.join(found.select(F.col("ancestor").alias("dir"), F.lit(True).alias("_f")).distinct(),
                 "dir", "left")
        .select("dir", F.when(F.col("_f"), "found").otherwise("invalid").alias("status"))
    )


def ancestors(df: DataFrame, col: str) -> DataFrame:
    """One row per (row, ancestor directory incl. itself) of an absolute path column."""
    parts = F.split(F.col(col), "/")
    chain = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )
    return df.select("*", F.explode(chain).alias("ancestor"))
