"""Cleaning a folder of drifting CSV files.

Tasks read the first record of each file from its first bytes, so that every
file's header is known without a scan of the folder. All files then go through
at most two CSV scans, however many headers there are: a row takes a wanted
column from the place that its file's header names. Files of which a field
may hold a line feed are parsed whole, the others are split: a large file's
quotes are counted in chunks, and if no line feed stands inside quotes it can
be cut at any line. Rows carry their file through the scan's metadata; the
table of files (path, place of each wanted column) is what they meet.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.paths import basename, dirname
from strata.session import materialize
from strata.sources import listing

CHUNK = 32 << 20             # bytes whose quotes are counted at once
HEADER_BYTES = 16 << 20      # a longer first record is unreadable
BROADCAST_FILES = 100_000    # rows meet a larger table of files by a shuffle


def drop_empty(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose (given) columns are all NULL."""
    return df.dropna(how="all", subset=list(cols) if cols else None)


def list_csv(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the CSV files of a folder that only Spark can open."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = jvm.org.apache.hadoop.fs.GlobFilter(glob)
    found, it = [], fs.listFiles(root, recursive)
    while it.hasNext():
        f = it.next()
        parts = f.getPath().toString()[len(root.toString()):].split("/")
        if wanted.accept(f.getPath()) and not any(listing.hidden(x) for x in parts if x):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def first_record(head: bytes, whole: bool) -> str | None:
    """The first record with a character in it: up to a line end outside quotes.
    None if ``head`` is only the beginning of the file and ends before that."""
    data = np.frombuffer(head, np.uint8)
    outside = np.bitwise_xor.accumulate(data == 34) == 0
    begin = 0
    for end in [*np.flatnonzero(outside & ((data == 10) | (data == 13))).tolist(), *([len(head)] if whole else [])]:
        text = head[begin:end].decode("utf-8", "replace").removeprefix("\ufeff")
        if text.strip():
            return text
        begin = end + 1
    return "" if whole else None


def header_names(record: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([record], strict=False), [])]


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) to (path, length, names); names are null where nothing could be read."""
    for batch in batches:
        out = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            record = None
            try:
                store, inner, _ = listing.open_path(path)
                with store.open_input_stream(inner) as stream:
                    head, size = b"", 1 << 16
                    while length and record is None and len(head) < HEADER_BYTES:
                        more = stream.read(size)
                        head, size = head + more, 2 * size
                        record = first_record(head, whole=not more)
            except OSError:
                record = None
            out.append(header_names(record) if record else None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(out, pa.list_(pa.string()))],
                                         names=["path", "length", "names"])


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk (path, at, size): whether its quotes are odd in number, and
    whether a line end follows an even (0) or odd (1) number of its quotes."""
    for batch in batches:
        rows = batch.to_pylist()
        odd, after = [], [[], []]
        for r in rows:
            store, inner, _ = listing.open_path(r["path"])
            with store.open_input_file(inner) as f:
                data = np.frombuffer(f.read_at(r["size"], r["at"]), np.uint8)
            parity = np.bitwise_xor.accumulate(data == 34)
            ends = parity[(data == 10) | (data == 13)]
            odd.append(int(parity[-1]) if len(data) else 0)
            after[0].append(bool((~ends).any()))
            after[1].append(bool(ends.any()))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(odd, pa.int64()), pa.array(after[0]), pa.array(after[1])],
                                         names=["path", "at", "odd", "even_end", "odd_end"])


def quoted_line_ends(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, quoted) of (path, length): whether a line end stands inside
    quotes. Chunks are looked at on their own; the quotes of the chunks in
    front say how each begins."""
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("at"))
    chunks = chunks.select("path", "at", F.least(F.lit(chunk).cast("long"), F.col("length") - F.col("at")).alias("size"))
    n = max(1, min(chunks.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    seen = materialize(chunks.repartition(n).mapInArrow(
        _count_quotes, "path STRING, at BIGINT, odd BIGINT, even_end BOOLEAN, odd_end BOOLEAN"), "csv-quotes")
    front = F.expr("coalesce(sum(odd) OVER (PARTITION BY path ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2")
    return (seen.withColumn("inside", front == 1)
            .groupBy("path").agg(F.bool_or(F.when(F.col("inside"), F.col("even_end")).otherwise(F.col("odd_end"))).alias("quoted")))


def csv_files(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False,
              multiline: bool | None = None, split_bytes: int | None = None) -> DataFrame:
    """One row per CSV file: path, length, names (of its header, null where
    none could be read) and whole (it has to be parsed in one piece).

    ``multiline`` says it for all files; left open, files up to ``split_bytes``
    (a scan's partition, by default) are parsed whole and larger ones if a line
    end stands inside quotes."""
    if split_bytes is None:
        split_bytes = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes")))
    if listing.supported(path):
        found = listing.files(spark, path, recursive, glob).select("path", "length")
        n = max(1, min(found.count(), 4 * spark.sparkContext.defaultParallelism))
        files = materialize(found.repartition(n, "path").mapInArrow(
            _read_headers, "path STRING, length BIGINT, names ARRAY<STRING>"), "csv-headers")
    else:  # only Spark opens it: header lines by a scan, one line each
        listed = list_csv(spark, path, glob, recursive)
        heads = _headers_by_scan(spark, [p for p, n in listed if n])
        files = spark.createDataFrame(
            [(listing.plain(p), n, header_names(heads[listing.plain(p)]) if listing.plain(p) in heads else None) for p, n in listed],
            "path STRING, length BIGINT, names ARRAY<STRING>")
        multiline = True if multiline is None else multiline
    if multiline is not None:
        return files.withColumn("whole", F.lit(multiline))
    large = files.where(F.col("length") > split_bytes).select("path", "length")
    if not large.limit(1).count():
        return files.withColumn("whole", F.lit(True))
    return files.join(quoted_line_ends(large), "path", "left").withColumn("whole", F.coalesce("quoted", F.lit(True))).drop("quoted")


def _headers_by_scan(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    if not files:
        return {}
    lines = (spark.read.option("ignoreCorruptFiles", True).text(list(files))
             .select(listing.row_file().alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("at"), "value"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return {r.file: r.header for r in first.collect()}


def clean_csv_dir(spark: SparkSession, path: str, wanted: Sequence[str], glob: str = "*.csv",
                  recursive: bool = False, multiline: bool | None = None, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean every CSV file of a folder.

    Returns ``(rows, stats)``: ``rows`` has ``file`` plus the wanted columns
    (NULL where a file lacks one), with rows empty in all wanted columns
    dropped; ``stats`` has one row per file with ``rows_in, rows_out,
    rows_removed, columns_in, columns_removed, missing, status``. Status is
    ``ok``, ``empty`` (no byte), ``unreadable`` (no header could be read) or
    ``error`` (a header name is blank or twice: the first one counts).
    ``multiline`` and ``split_bytes`` as in ``csv_files``.
    """
    wanted = list(wanted)
    files = csv_files(spark, path, glob, recursive, multiline, split_bytes).select(
        F.col("path").alias("file"), "length", "names", "whole",
        *[F.coalesce(F.array_position("names", w), F.lit(0)).cast("int").alias(f"_at{i}") for i, w in enumerate(wanted)])
    held = files.where("names IS NOT NULL")
    # the names of the files, as any scan needs them, and the places where wanted columns stand
    listed = held.select("file", "whole", *[f"_at{i}" for i in range(len(wanted))]).toArrow()
    n_files = listed.num_rows
    places = sorted({p for i in range(len(wanted)) for p in pc.unique(listed.column(f"_at{i}")).to_pylist() if p}) or [1]
    # one column more than is read: the parser then picks columns by place, whatever a line's length
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(places[-1] + 1)])
    where = held.select(F.col("file").alias("_file"), *[f"_at{i}" for i in range(len(wanted))])
    where = F.broadcast(where) if n_files <= BROADCAST_FILES else where
    rows = spark.createDataFrame([], "file STRING" + "".join(f", `{w}` STRING" for w in wanted))
    for whole in (True, False):
        members = listed.filter(pc.equal(listed.column("whole"), whole)).column("file").to_pylist()
        if not members:
            continue
        scan = (spark.read.schema(schema).option("header", True).option("multiLine", whole).option("escape", '"').csv(members)
                .withColumn("file", listing.row_file()).join(where, F.col("file") == F.col("_file")))
        picked = []
        for i, w in enumerate(wanted):
            value = F.lit(None).cast("string")
            for p in places:
                value = F.when(F.col(f"_at{i}") == p, F.col(f"_c{p - 1}")).otherwise(value)
            picked.append(value.alias(w))
        rows = rows.unionByName(scan.select("file", *picked))

    filled = F.lit(False)
    for w in wanted:
        filled = filled | F.col(f"`{w}`").isNotNull()
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(filled).alias("rows_out"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    present = sum((F.when(F.col(f"_at{i}") > 0, 1).otherwise(0) for i in range(len(wanted))), F.lit(0))
    bad = F.array_contains(names, "") | (F.size(F.array_distinct(names)) < F.size(names))
    stats = files.join(counts, "file", "left").select(
        "file", F.coalesce("rows_in", F.lit(0)).alias("rows_in"), F.coalesce("rows_out", F.lit(0)).alias("rows_out"),
        (F.coalesce("rows_in", F.lit(0)) - F.coalesce("rows_out", F.lit(0))).alias("rows_removed"),
        F.size(names).alias("columns_in"), (F.size(names) - present).cast("int").alias("columns_removed"),
        F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"_at{i}"), F.lit(0)) == 0, w) for i, w in enumerate(wanted)])).alias("missing"),
        F.when(F.col("length") == 0, "empty").when(F.col("names").isNull(), "unreadable").when(bad, "error").otherwise("ok").alias("status"))
    return drop_empty(rows, wanted), stats


def run_summary(stats: DataFrame, seconds: float | None = None) -> DataFrame:
    """Run totals (E12): files ok / total, rows kept, seconds, seconds per ok file
    (NULL when no file succeeded)."""
    return stats.agg(
        F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).cast("long").alias("files_ok"),
        F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum("rows_out"), F.lit(0)).cast("long").alias("rows_out"),
    ).select(
        "*",
        F.lit(seconds).cast("double").alias("seconds"),
        F.try_divide(F.lit(seconds).cast("double"), F.col("files_ok")).alias("seconds_per_file"),
    )


def dataset_of(file_col: str = "file"):
    """Name of the folder a file lies in (groups the part files of one dataset)."""
    return basename(dirname(F.col(file_col)))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows."""
    return df.limit(n)


def info(df: DataFrame) -> DataFrame:
    """Per column: type and non-null count, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                 F.col(f"`{c}`").alias("non_null")) for c in df.columns
    ])).alias("x"))
    return stacked.select("x.*")


def process_csv_folder(spark: SparkSession, in_dir: str, out_dir: str, wanted: Sequence[str],
                       glob: str = "*.csv", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean a CSV folder and write the result.

    Cleaned rows are written as CSV with a header, one output folder per
    input file (``source_file=processed_<name>``, with the sub-folders in the
    name where ``recursive``); returns the per-file statistics and the run
    totals.
    """
    import time

    t0 = time.perf_counter()
    rows, stats = clean_csv_dir(spark, in_dir, wanted, glob, recursive)
    name = F.replace(F.regexp_replace("file", "^" + _quoted(listing.plain(in_dir)) + "/", ""), F.lit("/"), F.lit("__"))
    out = rows.withColumn("source_file", F.concat(F.lit("processed_"), name)).drop("file")
    out.write.mode("overwrite").option("header", True).partitionBy("source_file").csv(out_dir)
    stats = materialize(stats, "csv-stats")
    summary = run_summary(stats, time.perf_counter() - t0)
    return stats, summary


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
