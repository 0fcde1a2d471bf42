"""Keyed load by buckets: untouched files, recovery, rows without an id."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import keyed_table as KT
from strata.session import literal_ts


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.startswith("part-") and f"{KT.BUCKET}=" in d}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id string, v long, at long")


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=16)
    KT.load(spark, path, rows_of(spark, [(f"k{i}", i, 0) for i in range(400)]), "id", ["at"])
    before = files(path)
    status = {r.status: r.n for r in KT.load(spark, path, rows_of(spark, [("k7", -1, 1), ("k7", -2, 2), ("new", 5, 1)]), "id", ["at"]).collect()}
    assert status == {"inserted": 1, "replaced": 1, "superseded": 1}
    n = spark.createDataFrame([("k7",), ("new",)], "id string").select(KT.bucket_of(F.col("id"), 16).alias("b")).collect()
    touched = {f"{KT.BUCKET}={r.b}" for r in n}
    after = files(path)
    for f, t in before.items():
        if os.path.basename(os.path.dirname(f)) not in touched:
            assert after[f] == t
    got = {r.id: r.v for r in KT.read(spark, path).collect()}
    assert got == {**{f"k{i}": i for i in range(400)}, "k7": -2, "new": 5}
    assert KT.loads(spark, path) == 2 and not os.path.exists(f"{path}/pending")


def test_random_loads_match_a_dictionary(spark, tmp_path):
    rng, path, want, unnamed = random.Random(5), str(tmp_path / "t"), {}, []
    KT.create(spark, path, buckets=4)
    for _ in range(4):
        rows = [(None if rng.random() < 0.3 else f"k{rng.randrange(30)}", rng.randrange(10**6), a) for a in range(rng.randrange(1, 60))]
        KT.load(spark, path, rows_of(spark, rows), "id", ["at"])
        want.update({k: v for k, v, _ in rows if k is not None})
        unnamed += [v for k, v, _ in rows if k is None]
    got = KT.read(spark, path).collect()
    assert {r.id: r.v for r in got if r.id is not None} == want
    assert sorted(r.v for r in got if r.id is None) == sorted(unnamed) and len(got) == len(want) + len(unnamed)


def test_a_load_of_rows_without_ids_touches_no_older_file(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=4)
    KT.load(spark, path, rows_of(spark, [("a", 1, 0), (None, 2, 0)]), "id", ["at"])
    before = files(path)
    KT.load(spark, path, rows_of(spark, [(None, 3, 0), (None, 3, 0)]), "id", ["at"])
    assert before.items() <= files(path).items()
    assert sorted(r.v for r in KT.read(spark, path).collect()) == [1, 2, 3, 3]


def test_empty_load_and_second_create(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=4)
    KT.load(spark, path, rows_of(spark, [("a", 1, 0)]), "id", ["at"])
    KT.load(spark, path, rows_of(spark, []), "id", ["at"])
    assert [tuple(r) for r in KT.read(spark, path).collect()] == [("a", 1, 0)]
    with pytest.raises(FileExistsError):
        KT.create(spark, path)


@pytest.mark.parametrize("half", [False, True])
def test_a_load_that_died_is_finished(spark, tmp_path, monkeypatch, half):
    """The driver dies before or after the buckets are replaced, but before the load is recorded."""
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=4)
    KT.load(spark, path, rows_of(spark, [("a", 1, 0), ("b", 2, 0)]), "id", ["at"])
    real = KT._apply

    def dies(spark, path):
        if half:
            spark.read.parquet(f"{path}/pending").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(KT.BUCKET).parquet(f"{path}/data")
        raise KeyboardInterrupt

    monkeypatch.setattr(KT, "_apply", dies)
    with pytest.raises(KeyboardInterrupt):
        KT.load(spark, path, rows_of(spark, [("a", 10, 1), (None, 7, 1)]), "id", ["at"])
    monkeypatch.setattr(KT, "_apply", real)
    assert KT.recover(spark, path) and not KT.recover(spark, path)
    got = sorted(((r.id or "", r.v) for r in KT.read(spark, path).collect()))
    assert got == [("", 7), ("a", 10), ("b", 2)] and KT.loads(spark, path) == 2


def test_an_incomplete_load_is_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=4)
    KT.load(spark, path, rows_of(spark, [("a", 1, 0)]), "id", ["at"])
    os.makedirs(f"{path}/pending/{KT.BUCKET}=1")
    assert not KT.recover(spark, path)
    assert [r.v for r in KT.read(spark, path).collect()] == [1]


def test_push_stamps_and_generates_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.create(spark, path, buckets=4)
    rows = spark.createDataFrame([("1", "x"), ("1", "y"), (None, "z"), (None, "z")], "id string, body string").coalesce(1)
    status = {r.status: r.n for r in KT.push(spark, path, rows, "id", literal_ts("2024-01-01 00:00:00")).collect()}
    assert status == {"inserted": 3, "replaced": 0, "superseded": 1}
    KT.push(spark, path, rows.where("id = '1' AND body = 'x'"), "id", literal_ts("2024-01-02 00:00:00"))
    got = {(r._id if r._id == "1" else "generated", r.doc.body, str(r.doc.ingestion_timestamp)[:10]) for r in KT.read(spark, path).collect()}
    assert got == {("1", "x", "2024-01-02"), ("generated", "z", "2024-01-01")}
