"""Output of a watch: several checkpoints, replayed and unfinished batches."""

import os
import shutil

from pyspark.sql import functions as F

from strata.streaming import watch as WT


def run(spark, inbox, out, checkpoint):
    stream = WT.watch(spark, str(inbox), glob="*.gz").select("path", "length")
    WT.run_watch(stream, str(out), str(checkpoint), once=True).awaitTermination()


def put(inbox, *names):
    inbox.mkdir(exist_ok=True)
    for n in names:
        (inbox / n).write_text(n)


def names(spark, out):
    return sorted(os.path.basename(r.path) for r in WT.read_watch(spark, str(out)).collect())


def test_a_second_checkpoint_loses_nothing(spark, tmp_path):
    one, two, out = tmp_path / "one", tmp_path / "two", tmp_path / "out"
    put(one, *[f"a{i}.gz" for i in range(5)])
    put(two, *[f"b{i}.gz" for i in range(5)])
    run(spark, one, out, tmp_path / "c1")
    run(spark, two, out, tmp_path / "c2")
    assert names(spark, out) == [f"{x}{i}.gz" for x in "ab" for i in range(5)]
    put(one, "a9.gz")
    run(spark, one, out, tmp_path / "c1")          # goes on under the first query's id
    assert len(names(spark, out)) == 11
    found = WT.commits(spark, str(out)).collect()
    assert len({r.query_id for r in found}) == 2 and len(found) == 3


def test_unfinished_batches_are_not_read_and_are_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    write = WT.batch_writer(out, query_id="q")
    write(spark.range(3), 0)
    write(spark.range(10, 14), 1)
    shutil.rmtree(f"{out}/commits/query_id=q/batch_id=1")    # the driver died before the commit row
    assert sorted(r.id for r in WT.read_watch(spark, out).collect()) == [0, 1, 2]
    write(spark.range(10, 12), 1)
    write(spark.range(10, 12), 1)
    assert sorted(r.id for r in WT.read_watch(spark, out).collect()) == [0, 1, 2, 10, 11]


def test_folded_commits(spark, tmp_path):
    out = str(tmp_path / "out")
    write = WT.batch_writer(out, query_id="q")
    for b in range(4):
        write(spark.range(b, b + 1), b)
    assert WT.fold_commits(spark, out) == 4 and not os.path.exists(f"{out}/commits")
    write(spark.range(9, 10), 4)
    write(spark.range(3, 4), 3)                              # replayed after it was folded
    assert WT.fold_commits(spark, out) == 5
    assert sorted(r.id for r in WT.read_watch(spark, out).collect()) == [0, 1, 2, 3, 9]
    assert WT.read_watch(spark, out).where(F.col("batch_id") == 4).count() == 1
