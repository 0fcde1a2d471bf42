"""Directory trees listed level by level in tasks.

The directories of a level are rows; tasks list them and return their entries,
and the directories among these are the next level's rows. Each level is
written once to the checkpoint folder, so the driver holds no list of files or
folders, only how many folders the next level has, and a lost task lists its
own folders again. The number of levels can be bounded: one level of a deep
tree costs one listing of the base.

Tasks open storage by Arrow's file systems: local paths, ``file:``, ``hdfs:``,
``s3:``/``s3a:`` and ``gs:``. Other schemes are left to Spark's own source
(``supported`` tells). One folder is listed by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import materialize

SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
ENTRY = "path STRING, length BIGINT, mtime TIMESTAMP_NTZ, is_dir BOOLEAN"
_ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us")), ("is_dir", pa.bool_())])


def scheme(path: str) -> str:
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else "file"


def plain(path: str) -> str:
    """Local paths without their scheme, others as they are; no slash at the end."""
    path = re.sub(r"^file:(//)?(?=/)", "", path)
    return path.rstrip("/") or "/"


def supported(path: str) -> bool:
    """Whether tasks can open the path by themselves."""
    return scheme(path) in SCHEMES and (scheme(path) != "file" or plain(path).startswith("/"))


def open_path(path: str) -> tuple[afs.FileSystem, str, str]:
    """(file system, path in it, what to put before its paths again)."""
    path = plain(path)
    if path.startswith("/"):
        return afs.LocalFileSystem(), path, ""
    store, inner = afs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return store, inner, path[: len(path) - len(inner)]


def glob_regex(pattern: str) -> str:
    """A file name glob (``* ? [ab] {a,b}``) as a regular expression."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and "]" in pattern[at + 1:]:
            end = pattern.index("]", at + 1)
            body = pattern[at + 1: end]
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]")
            at = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        at += 1
    return "^" + "".join(out) + "$"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base in batch.column(0).to_pylist():
            store, inner, before = open_path(base)
            here = store.get_file_info(inner)
            if here.type == afs.FileType.Directory:
                infos = store.get_file_info(afs.FileSelector(inner, allow_not_found=True))
            else:
                infos = [here] if here.is_file else []
            seen = [i for i in infos if not hidden(i.base_name)]
            for at in range(0, len(seen), 10_000):
                part = seen[at: at + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([before + i.path for i in part], pa.string()),
                    pa.array([i.size or 0 for i in part], pa.int64()),
                    pa.array([i.mtime_ns // 1000 if i.mtime_ns is not None else None for i in part], pa.int64()).cast(pa.timestamp("us")),
                    pa.array([i.type == afs.FileType.Directory for i in part], pa.bool_())], schema=_ENTRY)


def hidden(name: str) -> bool:
    """Names that Spark's file sources don't see either."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def walk(spark: SparkSession, dirs: str | Iterable[str], max_levels: int | None = None) -> DataFrame:
    """(path, length, mtime, is_dir, level) of the entries below the bases, down
    to ``max_levels``; bases that name a file give that file."""
    bases = sorted({plain(d) for d in ([dirs] if isinstance(dirs, str) else dirs)})
    frontier, n, level = spark.createDataFrame([(b,) for b in bases], "dir STRING"), len(bases), 0
    levels = []
    while n and (max_levels is None or level < max_levels):
        level += 1
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        listed = materialize(
            frontier.repartition(tasks, "dir").mapInArrow(_list, ENTRY).withColumn("level", F.lit(level)), f"level-{level}")
        levels.append(listed)
        below = listed.where("is_dir")
        frontier, n = below.select(F.col("path").alias("dir")), below.count()
    out = levels[0] if levels else spark.createDataFrame([], ENTRY + ", level INT")
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def row_file() -> Column:
    """Path of a scanned row's file, spelled as in a listing (the metadata column is URL-encoded)."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:(//)?(?=/)", "")


def files(spark: SparkSession, dirs: str | Iterable[str], recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, length, mtime) of the files below the bases, empty ones too, each once."""
    found = walk(spark, dirs, None if recursive else 1).where("NOT is_dir")
    if glob:
        found = found.where(F.regexp_extract("path", "[^/]*$", 0).rlike(glob_regex(glob)))
    # nested bases list a file twice
    several = not isinstance(dirs, str) and len(list(dirs)) > 1
    found = found.select("path", "length", "mtime")
    return found.dropDuplicates(["path"]) if several else found
