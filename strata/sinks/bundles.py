"""One bundle per key, cut at a target size.

The rows of a key, in order, are cut where their running bytes pass a multiple
of the target, so a key of ``b`` bytes becomes ``ceil(b / target)`` files and a
directory that holds a third of all data is written by as many tasks as it has
parts. The running bytes come from ranges of (key, order): ranges are summed on
their own, and keys cut by a range boundary get what the ranges in front hold
(see ``relational.ranged``); no key has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.relational import ranged, running_in_group

TARGET_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts and binaries whole, other values as their usual width."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + F.lit(8)
    return F.greatest(size, F.lit(1).cast("long"))


def plan_bundles(df: DataFrame, key: str, order: Sequence[Column], target_bytes: int = TARGET_BYTES,
                 size: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``bundle_part``: from 0 in each key, in order; a row larger
    than the target is a part of its own or ends one."""
    rows = ranged(df.withColumn("_bytes", size if size is not None else row_bytes(df)), key, order, parts)
    ends = running_in_group(rows, key, order, F.sum("_bytes"), F.sum("_bytes"), "_end")
    return ends.withColumn("bundle_part", (F.ceil(F.col("_end") / target_bytes) - 1).cast("long")).drop("_bytes", "_end")


def pack_bundles(df: DataFrame, path: str, key: str, order: Sequence[Column], target_bytes: int = TARGET_BYTES,
                 codec: str = "zstd", fmt: str = "parquet", size: Column | None = None, parts: int | None = None) -> str:
    """Write ``<key>=<value>/bundle_part=<i>/`` with one compressed file each;
    rows of a file keep their order. NULL keys make a bundle of their own."""
    planned = plan_bundles(df, key, order, target_bytes, size, parts)
    (planned.repartition(F.col(key), F.col("bundle_part")).sortWithinPartitions(key, "bundle_part", *order)
     .write.mode("overwrite").format(fmt).option("compression", codec).partitionBy(key, "bundle_part").save(path))
    return path
