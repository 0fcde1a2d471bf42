"""Directory watch as a Structured Streaming file source.

The reference polls folders every 60 s and keeps a ledger of handled items.
Here the file source's checkpoint is the record of which files were seen,
and each micro-batch is written by ``foreachBatch`` under the id of its query
and its batch, followed by a commit row, so a replayed batch overwrites its own
output instead of appending twice, and watches with checkpoints of their own
can share an output.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


log = logging.getLogger(__name__)


def split_existing(spark: SparkSession, dirs: Iterable[str]) -> tuple[list[str], list[str]]:
    """(existing, missing) folders of a watch list (J1 "invalid directory" warning)."""
    from strata.session import path_exists

    existing, missing = [], []
    for d in dirs:
        (existing if path_exists(spark, d) else missing).append(d)
    return existing, missing


# The binaryFile source's fixed schema (streaming sources need it declared).
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def watch(spark: SparkSession, dirs: str | Iterable[str], fmt: str = "binaryFile",
          schema: T.StructType | str | None = None, glob: str | None = None,
          clean_source: str | None = None, archive_dir: str | None = None,
          max_files_per_trigger: int | None = None, recursive: bool | None = None) -> DataFrame:
    """Streaming frame over files arriving in one or more folders.

    ``fmt='binaryFile'`` yields one row per file (path, modificationTime,
    length, content — select without ``content`` to skip the bytes).
    ``clean_source`` is ``'archive'`` or ``'delete'`` (source removed after a
    batch commits), off by default. ``recursive`` (default on for
    ``binaryFile``) also picks up files in sub-folders.
    """
    paths, missing = split_existing(spark, [dirs] if isinstance(dirs, str) else list(dirs))
    for d in missing:
        log.warning("skipping missing watch directory: %s", d)
    if not paths:
        raise FileNotFoundError("no watch directory exists")
    reader = spark.readStream.format(fmt)
    if schema is None and fmt == "binaryFile":
        schema = BINARY_FILE_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive or (recursive is None and fmt == "binaryFile"):
        reader = reader.option("recursiveFileLookup", True)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if len(paths) == 1:
        return reader.load(paths[0])
    out = None
    for p in paths:
        s = reader.load(p)
        out = s if out is None else out.unionByName(s)
    return out


# output columns that say which run of which query wrote a row
QUERY, BATCH = "query_id", "batch_id"


def batch_writer(out_path: str, fmt: str = "parquet", query_id: str | None = None):
    """foreachBatch function: write each micro-batch under (query id, batch id),
    then a commit row (J5).

    The query id belongs to the checkpoint: a restart goes on under the same
    one, a new checkpoint gets a new one, so batch 0 of a second watch over the
    same output replaces nothing of the first. A batch that is run again
    replaces its own folder and its own commit row. Readers go by the commit
    rows (``read_watch``): rows of a batch that never finished are not seen.
    """
    def write_batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        query = query_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("batch_writer runs in foreachBatch of a streaming query, or with a query_id")
        ids = {QUERY: F.lit(query), BATCH: F.lit(batch_id).cast("long")}
        (df.withColumns(ids).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(QUERY, BATCH).format(fmt).save(f"{out_path}/data"))
        (spark.range(1).select(F.current_timestamp().alias("committed_at")).withColumns(ids).coalesce(1)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(QUERY, BATCH).parquet(f"{out_path}/commits"))
    return write_batch


def commits(spark: SparkSession, out_path: str) -> DataFrame:
    """(query_id, batch_id, committed_at) of the finished batches, those folded
    by ``fold_commits`` included."""
    from strata.session import path_exists

    schema = f"committed_at TIMESTAMP, {QUERY} STRING, {BATCH} BIGINT"
    parts = [spark.read.schema(schema).parquet(f"{out_path}/{d}")
             for d in ("commits", "commits_folded") if path_exists(spark, f"{out_path}/{d}")]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(QUERY, BATCH).agg(F.max("committed_at").alias("committed_at"))


def read_watch(spark: SparkSession, out_path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of all committed batches, with their query and batch ids."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    data = reader.load(f"{out_path}/data")
    data = data.withColumns({QUERY: F.col(QUERY).cast("string"), BATCH: F.col(BATCH).cast("long")})
    return data.join(commits(spark, out_path).select(QUERY, BATCH), [QUERY, BATCH], "left_semi")


def fold_commits(spark: SparkSession, out_path: str) -> int:
    """Fold the one-row commit files of a long watch into one; returns how many
    batches are recorded. Runs between batches: rows are added to the folded
    table before the single files go, and a batch recorded in both counts once."""
    from strata.session import delete_path, path_exists

    if path_exists(spark, f"{out_path}/commits"):
        single = spark.read.schema(f"committed_at TIMESTAMP, {QUERY} STRING, {BATCH} BIGINT").parquet(f"{out_path}/commits")
        single.coalesce(1).write.mode("append").parquet(f"{out_path}/commits_folded")
        delete_path(spark, f"{out_path}/commits")
    return commits(spark, out_path).count()


def run_watch(stream: DataFrame, out_path: str, checkpoint: str,
              every: str | None = None, once: bool = False) -> StreamingQuery:
    """Start the watch: ``every='60 seconds'`` polls like the reference; ``once``
    processes what is there and stops (``availableNow``). Read the output with
    ``read_watch``."""
    w = stream.writeStream.foreachBatch(batch_writer(out_path)).option("checkpointLocation", checkpoint)
    if once:
        w = w.trigger(availableNow=True)
    elif every:
        w = w.trigger(processingTime=every)
    return w.start()
