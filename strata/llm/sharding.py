"""Minimax contiguous sharding over atomic groups (operator 13).

Rows with equal texts form a group that stays together. Groups are put in the
order of their text's SHA-256; shards are runs of that order. The capacity of
the largest shard is the smallest one for which the greedy cut (fill a shard
while the next group fits) needs no more than ``shards`` shards, found by
search over capacities.

The order is held as a table of groups with the running size at the end of
each group. Its digest's first hex digits make ``16 ** DIGITS`` blocks of
neighbours; only the totals of the blocks come to the driver. They bracket the
capacity: blocks taken as atomic give a feasible one. Inside the bracket
``WALKERS`` capacities are tried at once: each is a walker that cuts greedily,
and one Spark job per shard looks up the next cut of all walkers in the blocks
where they stand. So a search takes log(bracket) / log(WALKERS) rounds. Cuts
with the capacity found leave slack when a group is very large: each cut then
goes as near to an equal share of the rest as the capacity allows, for the
shards before and behind it.

A shard's end is the digest of its last group, so a row finds its shard by
comparing digests: nothing is joined to the rows. Slots number the rows of a
shard in the order (digest, id): cells of neighbours are numbered on their
own, then moved by the rows of the cells in front of them. A block with
more than ``CELL_ROWS`` rows is split into cells by a hash of the id, so a text
that a third of all rows share is spread over many tasks; only rows that
repeat both id and text can't be told apart and meet in one cell.

Native: DataFrame operations only. Null text is empty (size 1); null ids come
first. Rows that repeat an id each get a slot. An empty table gives an empty
one; columns of ``docs`` beside id and text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import Scratch, fresh

SHARDS = 8
DIGITS = 3            # hex digits of a block
WALKERS = 64          # capacities tried at once
CELL_ROWS = 256


def _greedy(sizes: list[int], capacity: int) -> int:
    """Shards that the greedy cut of atomic sizes needs."""
    n, room = 1, capacity
    for s in sizes:
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A handful of numbers as a frame."""
    body = ", ".join("(" + ", ".join(f"{int(x)}L" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


class Order:
    """Groups in order, with the running size ``end`` of each."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.spark = rows.sparkSession
        groups = rows.groupBy("_block", "_key").agg(F.sum("size").alias("_size"))
        inside = W.partitionBy("_block").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
        # range-partitioned by block: files hold neighbouring blocks, so lookups read few
        self.groups = scratch.table(
            groups.repartitionByRange("_block").withColumn("_inside", F.sum("_size").over(inside)), "shard-groups")
        totals = (self.groups.groupBy("_block").agg(F.sum("_size").alias("total"), F.max("_size").alias("largest"))
                  .orderBy("_block").collect())           # at most 16 ** DIGITS rows
        self.blocks = [r._block for r in totals]
        self.sizes = [r.total for r in totals]
        self.largest = max((r.largest for r in totals), default=0)
        self.begin = [0]
        for s in self.sizes:
            self.begin.append(self.begin[-1] + s)
        self.total = self.begin[-1]

    def around(self, targets: list[int]) -> list[tuple[int, int]]:
        """For each running size: (the last group end up to it, the first
        group end above it), one job for all."""
        ask, out = {}, {}
        for t in set(targets):
            if t >= self.total:
                out[t] = (self.total, self.total)
            else:
                b = bisect_right(self.begin, t) - 1
                ask[t] = b
        if ask:
            places = sorted({self.blocks[b] for b in ask.values()})
            wanted = _values(self.spark, "_t, _at, _begin", [(t, self.blocks[b], self.begin[b]) for t, b in ask.items()])
            end = F.col("_begin") + F.col("_inside")
            found = (
                self.groups.where(F.col("_block").isin(places))
                .join(F.broadcast(wanted), F.col("_block") == F.col("_at"))   # at most WALKERS rows
                .groupBy("_t").agg(F.max(F.when(end <= F.col("_t"), end)).alias("low"),
                                   F.min(F.when(end > F.col("_t"), end)).alias("high")))
            for r in found.collect():
                out[r._t] = (r.low if r.low is not None else self.begin[ask[r._t]], r.high)
        return [out[t] for t in targets]

    def feasible(self, capacities: list[int], shards: int) -> list[bool]:
        """Whether the greedy cut with each capacity needs at most ``shards``."""
        at = [0] * len(capacities)
        for _ in range(shards):
            at = [low for low, _ in self.around([p + c for p, c in zip(at, capacities, strict=True)])]
            if at[0] == self.total:         # the smallest capacity is there, so all are
                break
        return [p == self.total for p in at]

    def capacity(self, shards: int, walkers: int = WALKERS) -> int:
        """The smallest feasible capacity."""
        low = max(-(-self.total // shards), self.largest)
        high, floor = max(low, self.total), low
        while floor < high:                 # blocks as atoms: on the driver, over bounded totals
            middle = (floor + high) // 2
            if middle >= max(self.sizes) and _greedy(self.sizes, middle) <= shards:
                high = middle
            else:
                floor = middle + 1
        while low < high:
            step = -(-(high - low) // walkers)
            tries = list(range(low, high, step))
            ok = self.feasible(tries, shards)
            if any(ok):
                first = ok.index(True)
                high, low = tries[first], (tries[first - 1] + 1 if first else low)
            else:
                low = tries[-1] + 1
        return high

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Ends of the shards: none above ``capacity``, each as near to an
        equal share of what is left as that allows."""
        need = [self.total]                 # from behind: where a shard must end for the rest to fit
        for _ in range(shards - 1):
            t = need[-1] - capacity
            low, high = self.around([t])[0] if t > 0 else (0, 0)
            need.append(low if low == t or t <= 0 else high)
        need = need[::-1]
        ends, at = [], 0
        for k in range(shards - 1):
            (low, high), (most, _) = self.around([at + (self.total - at) // (shards - k), at + capacity])
            share = (self.total - at) / (shards - k)
            end = low if at + share - low <= high - at - share else high
            at = min(max(end, need[k], at), most)
            ends.append(at)
        return [*ends, self.total]

    def last_keys(self, ends: list[int]) -> list[str]:
        """Digest of the group at whose end each shard ends ('' if nothing is before)."""
        at = {e: bisect_right(self.begin, e - 1) - 1 for e in set(ends) if e > 0}
        keys = {0: ""}
        if at:
            rows = _values(self.spark, "_end, _at, _place", [(e, self.blocks[b], e - self.begin[b]) for e, b in at.items()])
            hit = (self.groups.where(F.col("_block").isin(sorted({self.blocks[b] for b in at.values()})))
                   .join(F.broadcast(rows), (F.col("_block") == F.col("_at")) & (F.col("_inside") == F.col("_place"))))
            keys.update({r._end: r._key for r in hit.select("_end", "_key").collect()})
        return [keys[e] for e in ends]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          keep: bool = False, digits: int = DIGITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (bytes of the text plus 1),
    text_crc32, shard and slot. With ``keep`` the struct ``row`` carries all
    columns of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.sha2(text, 256)
    rows = scratch.table(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"),
        F.conv(F.substring(key, 1, digits), 16, 10).cast("int").alias("_block"),
        *([F.struct(*docs.columns).alias("row")] if keep else [])), "shard-rows")
    order = Order(rows, scratch)
    if not order.blocks:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
                           *(["row"] if keep else []))
    ends = order.last_keys(order.cuts(shards, order.capacity(shards)))
    place = F.lit(0)
    for last in ends[:-1]:
        place = place + (F.col("_key") > F.lit(last)).cast("int")

    # cells of neighbours: a block, or a share of a large block's ids
    placed = rows.withColumn("shard", place)
    count = placed.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    split = count.select("shard", "_block", F.ceil(F.col("_rows") / cell_rows).cast("long").alias("_cells"))
    split = F.broadcast(split)              # at most 16 ** digits + shards rows
    celled = (placed.join(split, ["shard", "_block"])
              .withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.col("_cells"))).drop("_cells"))
    per_cell = celled.groupBy("shard", "_block", "_cell").agg(F.count("*").alias("_rows"))
    in_block = W.partitionBy("shard", "_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    in_shard = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = count.select("shard", "_block", F.coalesce(F.sum("_rows").over(in_shard), F.lit(0)).alias("_before"))
    ahead = (
        per_cell.withColumn("_inside", F.coalesce(F.sum("_rows").over(in_block), F.lit(0)))
        .join(F.broadcast(before), ["shard", "_block"])
        .select("shard", "_block", "_cell", (F.col("_before") + F.col("_inside")).alias("_ahead")))
    number = F.row_number().over(W.partitionBy("shard", "_block", "_cell").orderBy("_key", "doc_id"))
    return (
        celled.withColumn("_number", number)
        .join(ahead, ["shard", "_block", "_cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_ahead") + F.col("_number") - 1).cast("long").alias("slot"),
                *(["row"] if keep else [])))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet, one folder ``shard=k`` per shard,
    each row with its slot; files follow the slots."""
    named = fresh(docs, "shard", "slot")
    out = shard(docs, shards, id_col, text_col, keep=True)
    out = out.select("row.*", F.col("shard").alias(named[0]), F.col("slot").alias(named[1]))
    (out.repartitionByRange(*named).sortWithinPartitions(*named)
     .write.mode("overwrite").partitionBy(named[0]).parquet(path))
