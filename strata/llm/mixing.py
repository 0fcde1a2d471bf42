"""Mixing sources to target weights by weighted fair queueing (operator 5).

Every source is a queue of its documents in shuffled order (MD5 of the id),
served ``epochs`` times. A document's virtual finish time, of each turn, is the
number of words its source has been served when the document ends, divided
by the source's weight. All turns of all documents are range-sorted by finish
time; the mix takes them in that order and is truncated at the total budget:
turns in front of the cut are taken whole, the one on it in part (``taken``
counts its words up to the budget). So each source gets its weight's share
while its queue lasts, to within one document; when a queue runs dry the
others share on. ``target`` is the share of a fluid schedule.

Native: DataFrame operations only. The running word count of a source is a
sum over slices of the shuffled order (as many as rows fill ``SLICE_ROWS``,
pre-aggregated, in runs of ``RUN``) plus a running sum inside the slice, so that a source with a
third of all rows is spread over all tasks. The global order is never summed in
one task: ranges are totalled, the range where the budget is reached is summed
row by row, and the row found there, broadcast as a literal, tells every
document what is taken of it. Per-source arithmetic has one row per source.

Sizes are words; null texts have none. Sources go by code point, null last.
Ties of the order (repeated ids) are broken by size and text hash. Rows with
no words are taken 0 words of. An empty table gives an empty one. Columns of
``docs`` beside id, source and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import Scratch, fresh, words_in

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5   # share of all words that the mix holds
EPOCHS = 2     # a document is served so often at most
SLICE_ROWS = 256  # of the shuffled order of all sources, about
RUN = 4096        # slices whose words are summed up together


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source key, source_size, weight, target) from one row per source.

    Water level: sources in order of the virtual time at which their queues
    run dry; a source runs dry if that time is not above the level that the
    sources not yet dry would share.
    """
    by_name = W.orderBy("_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, len(weights)) + 1).cast("int"))
    dry = (
        sizes.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("_most", F.col("source_size") * F.lit(epochs))
        .withColumn("_dry", F.col("_most").cast("double") / F.col("weight")))
    everything = W.partitionBy()
    before = W.orderBy("_dry", "_rank").rowsBetween(W.unboundedPreceding, -1)
    level = (
        dry.withColumn("_total", F.sum("source_size").over(everything).cast("double") * F.lit(float(budget)))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_spent", F.coalesce(F.sum("_most").over(before), F.lit(0)).cast("double"))
        .withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_dry") <= (F.col("_total") - F.col("_spent")) / (F.col("_weights") - F.col("_gone"))))
    open_ = F.col("_weights") - F.sum(F.when(F.col("_full"), F.col("weight")).otherwise(0.0)).over(everything)
    left = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_most")).otherwise(0)).over(everything).cast("double")
    return (
        level.withColumn("_level", left / F.nullif(open_, F.lit(0.0)))
        .withColumn("target", F.when(F.col("_full"), F.col("_most").cast("double"))
                    .otherwise(F.col("weight") * F.col("_level")))
        .select("_source", "source_size", "weight", "target"))


ORDER = ("finish", "_source", "turn", "_at", "size", "_tie")


def cut(turns: DataFrame, budget: int, scratch: Scratch) -> tuple | None:
    """(key, words): the turn at which the running words of the global order
    reach the budget, and how many of its words are in front of it. None if
    they never do. ``turns`` has the columns ``ORDER``."""
    ranged = scratch.table(
        turns.repartitionByRange(*ORDER).withColumn("_pid", F.spark_partition_id()), "mix-order")
    before = 0
    for r in ranged.groupBy("_pid").agg(F.sum("size").alias("words")).orderBy("_pid").collect():  # one row a range
        if before + r.words >= budget:
            break
        before += r.words
    else:
        return None
    upto = F.sum("size").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(before)
    at = (ranged.where(F.col("_pid") == r["_pid"]).withColumn("_upto", upto).where(F.col("_upto") >= budget)
          .orderBy(*ORDER).first())
    return tuple(at[c] for c in ORDER), budget - (at["_upto"] - at["size"])


def taken_of(turn: int, found: tuple | None) -> Column:
    """Words of a document's turn that the mix takes."""
    if found is None:
        return F.col("size")
    key, words = found
    mine = F.struct(*[F.lit(turn).alias(c) if c == "turn" else _finish(turn).alias(c) if c == "finish" else F.col(c).alias(c) for c in ORDER])
    last = F.struct(*[F.lit(v).cast(_TYPES[c]).alias(c) for c, v in zip(ORDER, key, strict=True)])
    return F.when(mine < last, F.col("size")).when(mine == last, F.least("size", F.lit(words))).otherwise(F.lit(0)).cast("long")


_TYPES = {"finish": "double", "_source": "string", "turn": "int", "_at": "string", "size": "long", "_tie": "long"}


def _finish(turn: int) -> Column:
    return (F.col("begin") + F.lit(turn) * F.col("source_size") + F.col("size")) / F.col("weight")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             keep: bool = False, slice_rows: int = SLICE_ROWS, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, weight, target,
    begin (words of its source before it, first turn), taken, served (words
    taken of each turn) and finish (the virtual finish time of its first turn).
    With ``keep`` the struct ``row`` carries all columns of ``docs``."""
    epochs, budget = options.get("epochs", EPOCHS), options.get("budget", BUDGET)
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(
        F.col(id_col).alias("doc_id"),
        words_in(F.col(text_col)).alias("size"),
        # '0<name>' orders by code point, '1' (null) comes last
        F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("_source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_at"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("_tie"),
        *([F.struct(*docs.columns).alias("row")] if keep else []))
    narrow = scratch.table(whole.drop("row"), "mix-rows")
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = max(1, -(-n // slice_rows))
    at = (F.conv(F.substring("_at", 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("long")
    sliced = (whole if keep else narrow).withColumn("_slice", at)
    # running words of a source by slice: inside runs of slices, then over the runs
    per_slice = narrow.withColumn("_slice", at).groupBy("_source", "_slice").agg(F.sum("size").alias("_words")).withColumn(
        "_run", F.expr(f"_slice div {RUN}"))
    per_run = per_slice.groupBy("_source", "_run").agg(F.sum("_words").alias("_run_words"))
    before = per_run.withColumn(
        "_before", F.sum("_run_words").over(W.partitionBy("_source").orderBy("_run")) - F.col("_run_words")).drop("_run_words")
    ahead = per_slice.withColumn(
        "_in_run", F.sum("_words").over(W.partitionBy("_source", "_run").orderBy("_slice")) - F.col("_words")
    ).join(before, ["_source", "_run"]).select("_source", "_slice", (F.col("_before") + F.col("_in_run")).alias("_ahead"))
    sources = targets(per_run.groupBy("_source").agg(F.sum("_run_words").alias("source_size")), **options)
    inside = (W.partitionBy("_source", "_slice").orderBy("_at", "size", "_tie")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    queued = scratch.table(
        sliced.withColumn("_inside", F.sum("size").over(inside))
        .join(ahead.join(sources, "_source"), ["_source", "_slice"])
        .withColumn("begin", F.col("_ahead") + F.col("_inside") - F.col("size"))
        .select("doc_id", "size", "_source", "_at", "_tie", "source_size", "weight", "target", "begin", *(["row"] if keep else [])), "mix-queues")
    turn = F.explode(F.array(*[F.struct(F.lit(e).alias("turn"), _finish(e).alias("finish")) for e in range(epochs)]))
    turns = queued.where("size > 0").withColumn("_t", turn).select("_t.finish", "_source", "_t.turn", "_at", "size", "_tie")
    found = cut(turns, math.floor(total * budget), scratch) if total else None
    scratch.drop("mix-rows", "mix-order")
    out = (
        queued.withColumn("served", F.array(*[taken_of(e, found) for e in range(epochs)]))
        .withColumn("taken", F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("finish", _finish(0)))
    names = ["doc_id", "size", "source_size", "weight", "target", "begin", "taken", "served", "finish"]
    return out.select(*names, *(["row"] if keep else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated where the mix takes them
    twice, in order of virtual finish time (range-sorted). Documents are
    never cut here: the one in service at the stop goes in if at least half of
    it is served; a document without words goes in once."""
    epochs = options.get("epochs", EPOCHS)
    turn, finish, row = fresh(docs, "_turn", "_finish", "_row")
    served = F.get("served", F.col("_e"))
    return (
        schedule(docs, id_col, text_col, source_col, keep=True, **options)
        .withColumn("_e", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
        .where(F.when(F.col("size") == 0, F.col("_e") == 0).otherwise(served * 2 >= F.col("size")))
        .withColumn(finish, (F.col("begin") + F.col("_e") * F.col("source_size") + F.col("size")) / F.col("weight"))
        .withColumnRenamed("row", row)
        .select(F.col(row), F.col(finish), F.col("_e").alias(turn))
        .orderBy(finish, turn)
        .select(f"{row}.*"))
