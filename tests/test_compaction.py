"""Compaction in place: what stays, what is merged, and a driver that dies."""

import os

import pytest
from pyspark.sql import functions as F

from strata.sinks import compaction as C
from strata.sinks.writers import open_writers
from tests.events import EventLog, operators


def files(path):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, os.path.getsize(os.path.join(d, f)))
            for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(spark, path):
    return sorted((r.id, str(r.p)) for r in spark.read.parquet(path).select("id", "p").collect())


@pytest.fixture
def table(spark, tmp_path):
    """Partition a: a large file and nine small ones; b: one small file; NULL: three, one with another column."""
    path = str(tmp_path / "t")
    big = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"), F.lit("a").alias("p")).coalesce(1)
    big.write.mode("append").partitionBy("p").parquet(path)
    small = spark.range(50_000, 50_900).select("id", F.lit("s").alias("t"), F.lit("a").alias("p")).repartition(9)
    small.write.mode("append").partitionBy("p").parquet(path)
    spark.range(7).select("id", F.lit("b +%x").alias("p")).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    for i in range(2):
        spark.range(i * 10, i * 10 + 5).select("id", F.lit(None).cast("string").alias("p")).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    (spark.range(90, 93).select("id", F.lit("n").alias("extra"), F.lit(None).cast("string").alias("p")).coalesce(1)
     .write.mode("append").partitionBy("p").parquet(path))
    return path


TARGET = 1 << 20


def test_large_and_single_files_stay(spark, table):
    before, want = files(table), rows(spark, table)
    assert max(n for _, n in before.values()) > TARGET
    done = {os.path.basename(r.dir): (r.files_before, r.files_after) for r in C.compact_in_place(spark, table, TARGET).collect()}
    assert done == {"p=a": (9, 1), "p=__HIVE_DEFAULT_PARTITION__": (3, 1)}
    after = files(table)
    kept = [f for f, (_, n) in before.items() if n > TARGET or "/p=b" in f]
    assert len(kept) == 2 and all(after[f] == before[f] for f in kept) and len(after) == 4
    assert rows(spark, table) == want and not os.path.exists(f"{table}/_compaction")
    merged = spark.read.option("mergeSchema", True).parquet(table)
    assert merged.where("extra = 'n'").count() == 3
    assert C.compact_in_place(spark, table, TARGET).collect() == [] and files(table) == after


def test_several_batches_and_targets(spark, table):
    want = rows(spark, table)
    sizes = [n for f, (_, n) in files(table).items() if "/p=a" in f and n < TARGET]
    C.compact_in_place(spark, table, 3 * max(sizes), batch_files=2)
    assert rows(spark, table) == want
    left = [n for f, (_, n) in files(table).items() if "/p=a" in f and n < TARGET]
    assert 2 <= len(left) <= 4


@pytest.mark.parametrize("ready", [False, True])
def test_a_compaction_that_died(spark, table, monkeypatch, ready):
    before, want = files(table), rows(spark, table)
    real, calls = C.recover, []

    def dies(spark, path):
        calls.append(path)
        if len(calls) == 2:          # after the mark
            raise KeyboardInterrupt
        return real(spark, path)

    monkeypatch.setattr(C, "recover", dies)
    with pytest.raises(KeyboardInterrupt):
        C.compact_in_place(spark, table, TARGET)
    monkeypatch.setattr(C, "recover", real)
    assert rows(spark, table) == want            # readers don't see the work folder
    if not ready:
        os.unlink(f"{table}/_compaction/ready/_SUCCESS")
        assert not C.recover(spark, table) and files(table) == before
    else:
        victim = next(f for f in before if "/p=a" in f and before[f][1] < TARGET)
        os.unlink(victim)                        # half of the switch was done
        assert C.recover(spark, table) and len(files(table)) == 4
    assert rows(spark, table) == want and not C.recover(spark, table)


def test_other_storage_is_refused(spark):
    with pytest.raises(ValueError, match="compact"):
        C.compact_in_place(spark, "viewfs://x/y")


@pytest.mark.parametrize("batch_files", [2, 10_000])
def test_rows_of_a_group_are_not_sorted(spark, table, batch_files):
    """Each group goes to its file through one task, which holds none of its rows."""
    want, log, conf = rows(spark, table), EventLog(spark), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    small = max(n for f, (_, n) in files(table).items() if "/p=a" in f and n < TARGET)
    made = sum(r.files_after for r in C.compact_in_place(spark, table, 3 * small, batch_files=batch_files).collect())
    writes = [p for p in log.plans().values() if "InsertIntoHadoopFsRelationCommand" in p and "/_compaction/new" in p]
    assert writes and not any(name == "Sort" for p in writes for name, _ in operators(p))
    new = [f for f in files(table) if "part-compacted" in f]
    assert made == len(new) > 2 and rows(spark, table) == want
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == conf


def test_open_writers(spark, tmp_path):
    """Values beyond the open files are written all the same, and the setting goes back on an error."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    frame = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("p")).coalesce(2)
    with pytest.raises(KeyError), open_writers(spark, 3):
        frame.write.partitionBy("p").parquet(f"{tmp_path}/t")
        raise KeyError
    back = spark.read.parquet(f"{tmp_path}/t").groupBy("p").count().collect()
    assert {r.p for r in back} == {None, *range(1, 10)} and all(r["count"] == 300 for r in back)
    assert spark.conf.get(key) == before
