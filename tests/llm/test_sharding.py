"""Operator 13 against an exhaustive minimax partition, with edge cases."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm.common import Scratch
from strata.llm.sharding import Order, shard, write_shards


def fits(sizes, shards, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n <= shards


def plain_capacity(sizes, shards):
    c = max(sizes)
    while not fits(sizes, shards, c):
        c += 1
    return c


def group_sizes(rows):
    by = defaultdict(int)
    for r in rows:
        by[hashlib.sha256((r.text or "").encode()).hexdigest()] += len((r.text or "").encode()) + 1
    return [by[k] for k in sorted(by)], by


def check(df, shards, **options):
    rows = df.select("doc_id", "text").collect()
    got = shard(df, shards, keep=True, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r.row.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < shards
    sizes, _ = group_sizes(rows)
    best = plain_capacity(sizes, shards)
    load, slots, place = defaultdict(int), defaultdict(list), {}
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        digest = hashlib.sha256((r.row.text or "").encode()).hexdigest()
        assert place.setdefault(digest, r.shard) == r.shard          # a group stays together
    assert max(load.values()) <= best                                # minimax
    assert [place[k] for k in sorted(place)] == sorted(place.values())   # contiguous
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


@pytest.mark.parametrize("shards", [1, 2, 8, 50])
def test_smallest_capacity(sample, shards):
    load = check(sample, shards, digits=2)
    if shards == 8:
        total = sum(load.values())
        assert len(load) == 8 and min(load.values()) > total / 16


def test_edge_cases(edge, docs_of):
    check(edge, 8)
    check(docs_of([(1, "a")]), 8)
    check(docs_of([(1, None), (1, ""), (None, None)]), 3)
    assert shard(docs_of([])).collect() == []


def test_a_group_of_a_third_of_all_rows_is_numbered_in_cells(docs_of):
    df = docs_of([(i, "copy of one text" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(900)])
    load = check(df, 8, cell_rows=16)
    assert len(load) == 8
    check(docs_of([(i, "same") for i in range(300)]), 8, cell_rows=16)


def test_slots_follow_text_and_id_when_nothing_is_split(docs_of):
    df = docs_of([(i, f"t{i % 5}") for i in range(40)])
    got = shard(df, 2, keep=True).collect()
    for s in {r.shard for r in got}:
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        keys = [(hashlib.sha256(r.row.text.encode()).hexdigest(), r.doc_id) for r in mine]
        assert keys == sorted(keys)


def test_search_with_few_walkers_finds_the_same(spark, sample):
    text = F.coalesce("text", F.lit(""))
    rows = sample.select((F.octet_length(text) + 1).cast("long").alias("size"), F.sha2(text, 256).alias("_key"),
                         F.conv(F.substring(F.sha2(text, 256), 1, 1), 16, 10).cast("int").alias("_block"))
    order = Order(rows, Scratch(spark))
    sizes, _ = group_sizes(sample.select("text").collect())
    assert order.capacity(5, walkers=3) == order.capacity(5, walkers=64) == plain_capacity(sizes, 5)


def test_written_shards(spark, sample, tmp_path):
    write_shards(sample.withColumn("slot", F.lit("mine")), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == sample.count() and {"slot", "_slot", "shard"} <= set(back.columns)
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
