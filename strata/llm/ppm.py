"""Language-model scores by prediction by partial matching (operator 2).

A document is its words, A-Z lowered, and one end token: as bytes, the words
joined by single spaces and closed by a line feed (which no word contains).
The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts
of the bytes that followed them in the training documents. A byte is coded in
the longest context that training saw; where the byte never followed it, an
escape (method C: d / (n + d) with n bytes seen, d of them distinct) leads to
the next shorter context, in which all bytes of the longer one are excluded,
and in the end to the bytes never seen at all, equally likely. The score is
the sum of log10 probabilities: minus the code length. Beside it stands a
unigram baseline with add-one smoothing over word tokens.

Counting, the trie's sums per context and the escape chain of every
(context, byte) that occurs anywhere are Spark aggregations and joins over
all documents; the resulting tables grow with the input. While they have no
more than ``MAX_ROWS`` rows they are broadcast to the scoring tasks; beyond,
each document's counts are joined to them.

Training documents are those whose crc32(id as text) mod ``FOLDS`` is not
``HELD_OUT`` (null ids count as ''). Null and empty texts are the end token
alone; repeated rows count and are scored each; without training documents
all bytes are equally likely. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, id_fold, text_sha, to_arrays
from strata.llm.textops import (Counter, Hasher, HashTable, U, buffer, byte_grams, lower_ascii, ragged, slices, sum_rows,
                                words)

ORDER = 5
FOLDS, HELD_OUT = 7, 2
MAX_ROWS = 8_000_000  # of each broadcast table: 12 bytes each
END = U(1)            # hash of the end token
LN10 = float(np.log(10))


def spell(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, token offsets, bytes, byte offsets) of the rows."""
    n = len(off) - 1
    low = lower_ascii(data)
    starts, ends, row = words(low, off)
    count = np.bincount(row, minlength=n)
    tokens = np.empty(len(row) + n, U)
    last = np.cumsum(count + 1) - 1
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner] = Hasher(low).span(starts, ends)
    tokens[last] = END
    # the bytes of each word and one more place for what follows it
    at = np.zeros(len(tokens), np.int64)
    length = np.zeros(len(tokens), np.int64)
    at[inner], length[inner] = starts, ends - starts + 1
    length[last] = count == 0
    text = np.append(low, np.uint8(10))[np.minimum(ragged(at, length), len(low))]
    after = np.cumsum(length) - 1
    text[after[inner]] = 32
    closing = np.where(count == 0, after[last], after[last - 1])
    text[closing] = 10
    token_off = np.concatenate([[0], last + 1])
    return tokens, token_off, text, np.concatenate([[0], closing + 1])


def count_all(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, trained, n): tokens (kind 0) and byte grams (kind 1) of all
    rows of (held_out, text), with their number in training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {(kind, held): Counter() for kind in (0, 1) for held in (0, 1)}
        for batch in slices(batches, "text"):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            tokens, t_off, text, b_off = spell(*buffer(batch.column("text")))
            for kind, keys, off in ((0, tokens, t_off), (1, byte_grams(text, b_off, order + 1), b_off)):
                out = np.repeat(held, np.diff(off))
                counters[kind, 0].add(keys[~out])
                counters[kind, 1].add(keys[out])
        for (kind, held), counter in counters.items():
            keys, n = counter.merge()
            for at in range(0, len(keys), 1 << 16):
                k, m = keys[at: at + (1 << 16)].view(np.int64), n[at: at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(m if not held else np.zeros_like(m)), pa.array(m)],
                    names=["kind", "key", "trained", "n"])

    return (docs.select("held_out", "text").mapInArrow(count, "kind int, key long, trained long, n long")
            .groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")))


def _suffix(col: str, n: int):
    return F.col(col).bitwiseAND(F.lit((1 << 8 * n) - 1))


def code_lengths(grams: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(key, ln_p) of every gram (key, trained): the last byte's probability
    after the ``order`` bytes before it."""
    seen = {order: grams.where("trained > 0").select(F.col("key").alias("g"), F.col("trained").alias("c"))}
    contexts = {}
    for k in range(order, -1, -1):  # contexts of k bytes
        seen[k] = scratch.table(seen[k], f"seen-{k}") if k < order else seen[k]
        contexts[k] = seen[k].groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
        if k:
            seen[k - 1] = seen[k].groupBy(_suffix("g", k).alias("g")).agg(F.sum("c").alias("c"))
    for k in range(order, 0, -1):  # what a context's bytes count in the next shorter one
        parent = seen[k - 1].select(F.col("g").alias("low"), F.col("c").alias("c_low"))
        covered = (seen[k].withColumn("low", _suffix("g", k)).join(parent, "low")
                   .groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c_low").alias("covered")))
        contexts[k] = contexts[k].join(covered, "x")
    state = grams.select("key", F.lit(0.0).alias("ln_p"), F.lit(None).cast("long").alias("n_ex"), F.lit(None).cast("long").alias("d_ex"))
    finished = []
    for k in range(order, -1, -1):
        here = seen[k].select(F.col("g"), F.col("c"))
        ctx = contexts[k] if k else contexts[k].withColumn("covered", F.lit(0).cast("long"))
        step = (state.withColumn("g", _suffix("key", k + 1)).join(here, "g", "left")
                .withColumn("x", F.shiftright("g", 8)).join(ctx, "x", "left"))
        # bytes and distinct bytes that can still be coded here (n_ex, d_ex: excluded by the longer context)
        n = F.col("n") - F.coalesce("n_ex", F.lit(0))
        d = F.col("d") - F.coalesce("d_ex", F.lit(0))
        escape = F.when(F.col("n").isNull() | (d == 0), 0.0).otherwise(F.log(d / (n + d)))
        step = scratch.table(step.select(
            "key", F.col("c").isNotNull().alias("hit"),
            (F.col("ln_p") + F.when(F.col("c").isNotNull(), F.log(F.col("c") / (n + d))).otherwise(escape)).alias("ln_p"),
            F.col("covered").alias("n_ex"), F.col("d").alias("d_ex")), f"coded-{k}")
        finished.append(step.where("hit").select("key", "ln_p"))
        state = step.where("NOT hit").drop("hit")
    out = state.select("key", (F.col("ln_p") - F.log(256 - F.coalesce("d_ex", F.lit(0)))).alias("ln_p"))
    for part in finished:
        out = out.unionByName(part)
    return out


def _base(c, total: float):
    return F.log10((c + 1) / F.lit(total))


SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
               max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    counts = scratch.table(count_all(rows, order), "ppm-counts")
    trained = counts.where("kind = 0 AND trained > 0")
    known = trained.select("key", F.col("trained").alias("c"))
    # a token that occurs once at all is known in its own training document and
    # nowhere else: that document knows it without a table
    several = trained.where("n > 1").select("key", F.col("trained").alias("c"))
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = float(n + v + 1)
    lengths = scratch.table(code_lengths(counts.where("kind = 1").select("key", "trained"), scratch, order), "ppm-lengths")
    if max(several.count(), lengths.count()) > max_rows:
        out = _joined(rows, known, lengths, total, order)
    else:
        words_ = to_arrays(several.select("key", F.log10((F.col("c") + 1) / total).alias("p")))
        table = HashTable(words_["key"].view(U), words_["p"])
        coded = to_arrays(lengths.select("key", (F.col("ln_p") / LN10).cast("float").alias("p")))
        held = spark.sparkContext.broadcast((table, HashTable(coded["key"].view(U), coded["p"])))
        del words_, coded, table
        new, once = float(-np.log10(total)), float(np.log10(2) - np.log10(total))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word, byte = held.value
            for batch in slices(batches, "text"):
                tokens, t_off, text, b_off = spell(*buffer(batch.column("text")))
                at = word.find(tokens)
                trained = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(t_off))
                base = np.where(trained, once, new)
                base[at >= 0] = word.values[0][at[at >= 0]]
                code = byte.values[0][byte.find(byte_grams(text, b_off, order + 1))]  # every gram was counted
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(t_off)),
                     pa.array(sum_rows((at >= 0) | trained, t_off).astype(np.int64)), pa.array(sum_rows(base, t_off)), pa.array(sum_rows(code, b_off))],
                    names=["doc_id", *[f.split()[0] for f in SCORES.split(", ")]])

        out = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCORES}")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _joined(rows: DataFrame, known: DataFrame, lengths: DataFrame, total: float, order: int) -> DataFrame:
    """The way beyond ``max_rows``: each text's counts joined to the tables.
    Kind 2 counts the rows of a text, by which its sums are divided."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, t_off, text, b_off = spell(*buffer(batch.column("text")))
            sha = batch.column("sha")
            for kind, keys, off in ((0, tokens, t_off), (1, byte_grams(text, b_off, order + 1), b_off),
                                    (2, np.zeros(batch.num_rows, U), np.arange(batch.num_rows + 1))):
                row = np.repeat(np.arange(batch.num_rows), np.diff(off))
                by = np.lexsort((keys, row))
                row, keys = row[by], keys[by]
                first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))))
                yield pa.RecordBatch.from_arrays(
                    [sha.take(pa.array(row[first])), pa.array(np.full(len(first), kind, np.int32)), pa.array(keys[first].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(keys))))], names=["sha", "kind", "key", "m"])

    keyed = rows.withColumn("sha", text_sha(F.col("text")))
    table = known.select(F.lit(0).alias("kind"), "key", F.col("c").cast("double").alias("value")).union(
        lengths.select(F.lit(1), "key", "ln_p"))
    m, value = F.col("m"), F.col("value")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    sums = (
        keyed.select("sha", "text").mapInArrow(count, "sha string, kind int, key long, m long")
        .groupBy("sha", "kind", "key").agg(F.sum("m").alias("m"))
        .join(table, ["kind", "key"], "left").groupBy("sha").agg(
            of(2, m).alias("rows"), of(0, m).alias("n_tokens"), of(0, F.when(value.isNotNull(), m).otherwise(0)).alias("n_known"),
            of(0, m * _base(F.coalesce(value, F.lit(0.0)), total)).alias("base_score"), of(1, m * value / LN10).alias("score")))
    each = [(F.col(c) / F.col("rows")).cast(t).alias(c) for c, t in
            (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]
    return keyed.join(sums, "sha").select("doc_id", "held_out", *each)
