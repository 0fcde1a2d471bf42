"""Compaction in place: only files below the target are rewritten.

The small files of a folder, by name, are grouped where their running size
passes a multiple of the target; a group of two or more becomes one file in
the same folder. Files at or above the threshold, and files that stay alone,
keep their names and times. Nothing but the chosen files is read. A task writes
one group and doesn't sort its rows: its memory doesn't grow with the group.

The work goes through ``_compaction`` in the table's folder, which readers
don't see: the plan, the new files by group, and a mark once all are written.
Then tasks move each new file to its folder and delete the files it replaces.
If the driver dies before the mark, ``recover`` drops the attempt; after it,
``recover`` (and the next ``compact_in_place``) finishes it. Both steps can
be repeated. Readers should not run between the mark and the end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.session import delete_path, materialize, path_exists
from strata.sinks.writers import open_writers, write
from strata.sources import listing

SMALL = 0.75          # of the target: larger files are left alone
BATCH_FILES = 10_000  # files that one job reads; their names are all the driver holds

PLAN = "dir STRING, bin BIGINT, path STRING, length BIGINT, grp STRING, batch INT"


def plan_compaction(spark: SparkSession, path: str, target_bytes: int, glob: str = "*.parquet") -> DataFrame:
    """(dir, bin, path, length): the files to rewrite and the new file of each."""
    small = listing.files(spark, path, glob=glob).where(F.col("length") < SMALL * target_bytes).select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "path", "length")
    by_name = Window.partitionBy("dir").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    binned = small.withColumn("bin", F.floor(F.coalesce(F.sum("length").over(by_name), F.lit(0)) / target_bytes).cast("long"))
    several = binned.groupBy("dir", "bin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return binned.join(several, ["dir", "bin"])


def compact_in_place(spark: SparkSession, path: str, target_bytes: int = 128 << 20, fmt: str = "parquet",
                     glob: str | None = None, batch_files: int = BATCH_FILES) -> DataFrame:
    """Compact a folder; returns (dir, files_before, files_after, bytes) of the
    folders that changed."""
    if not listing.supported(path):
        raise ValueError(f"tasks cannot open {path}; write a compacted copy with writers.compact")
    path = listing.plain(path)
    recover(spark, path)
    work, run = f"{path}/_compaction", uuid.uuid4().hex[:12]
    plan = plan_compaction(spark, path, target_bytes, glob or f"*.{fmt}").withColumn(
        "grp", F.concat(F.lit(f"{run}-"), F.substring(F.sha2("dir", 256), 1, 24), F.lit("-"), F.col("bin").cast("string")))
    plan.withColumn("batch", F.lit(0)).write.parquet(f"{work}/files")
    files = spark.read.schema(PLAN).parquet(f"{work}/files").drop("batch")
    total = files.count()
    batches = math.ceil(total / batch_files)
    for b in range(batches):
        mine = files.where(F.pmod(F.xxhash64("grp"), F.lit(batches)) == b).select("path", "grp").collect()
        if not mine:
            continue
        number = {g: k for k, g in enumerate(sorted({r.grp for r in mine}))}
        names = spark.createDataFrame([(r.path, r.grp, number[r.grp]) for r in mine], "_path STRING, _grp STRING, _grp_number INT")
        read = spark.read.format(fmt)
        if fmt in ("parquet", "orc"):
            read = read.option("mergeSchema", True)  # files of one folder may differ in columns
        rows = read.load([r.path for r in mine]).withColumn("_path", listing.row_file())
        dealt = (rows.join(F.broadcast(names), "_path").drop("_path")      # at most a batch of names
                 .repartitionById(len(number), "_grp_number").drop("_grp_number"))
        with open_writers(spark, 2):  # a task has one group; its rows go to the file as they come
            write(dealt, f"{work}/new", fmt, mode="append", partition_by=["_grp"])
    if total:
        spark.range(1).write.parquet(f"{work}/ready")
    summary = (files.groupBy("dir").agg(F.count(F.lit(1)).alias("files_before"), F.countDistinct("grp").alias("files_after"),
                                        F.sum("length").alias("bytes")))
    summary = materialize(summary, "compaction-summary")
    recover(spark, path)
    return summary


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a compaction whose files are all written, drop any other; True if one was finished."""
    path = listing.plain(path)
    work = f"{path}/_compaction"
    if not path_exists(spark, work):
        return False
    done = path_exists(spark, f"{work}/ready/_SUCCESS")
    if done:
        files = spark.read.schema(PLAN).parquet(f"{work}/files")
        groups = files.groupBy("dir", "grp").agg(F.collect_list("path").alias("old"))   # files of at most 1.75 targets
        tasks = min(groups.count(), 4 * spark.sparkContext.defaultParallelism)
        moved = groups.select("dir", "grp", "old", F.lit(f"{work}/new").alias("new")).repartition(max(1, tasks), "grp")
        moved.mapInArrow(_switch, "grp STRING").write.format("noop").mode("overwrite").save()
    delete_path(spark, work)
    return done


def _switch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Move the new file of each group to its folder, then delete the old ones;
    what a former attempt did is left as it is."""
    for batch in batches:
        for r in batch.to_pylist():
            store, staged, _ = listing.open_path(f"{r['new']}/_grp={r['grp']}")
            for f in store.get_file_info(afs.FileSelector(staged, allow_not_found=True)):
                if f.is_file and not listing.hidden(f.base_name):
                    end = f.base_name[f.base_name.index("."):] if "." in f.base_name else ""
                    store.move(f.path, listing.open_path(r["dir"])[1] + f"/part-compacted-{r['grp']}{end}")
            for old in r["old"]:
                inner = listing.open_path(old)[1]
                if store.get_file_info(inner).is_file:
                    store.delete_file(inner)
        yield pa.RecordBatch.from_arrays([batch.column("grp").slice(0, 0)], names=["grp"])
