"""Quality rules with an n-gram perplexity band per language (operator 1).

Base rules: a document needs ``MIN_WORDS`` words, and at most half of them may
stand in three-word windows that occur twice in the text. Then a byte n-gram
model with modified Kneser-Ney smoothing gives each text its perplexity a word
(as log2: bits a word), and the language's band decides: outside
[q25 - FENCE * iqr, q75 + FENCE * iqr] of the bits a word of its language (over
documents that pass the base rules) a document is rejected. Too low: repeated or templated text; too high:
text unlike the language.

The model is counted by Spark over every document: tasks count the n-grams of
their texts, continuation counts, discounts and interpolation are joins and
aggregations per (language, n-gram). Byte n-grams keep the table small
(at most the distinct ``ORDER``-byte strings of a language). For scoring it is
held as sorted 64-bit hashes with log probabilities, broadcast while it has no
more than ``MAX_ROWS`` rows; beyond, documents' n-gram counts are joined to it.

Null text has no words and fails the base rules; null language is a language
of its own; repeated rows are scored each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import Scratch, to_arrays
from strata.llm.textops import (Counter, Hasher, HashTable, U, buffer, byte_grams, mix, per_row, row_of, slices, sum_rows,
                                unique_counts, words)

ORDER = 5
MIN_WORDS = 50
FENCE = 2.5
LEAST_SPREAD = 0.2       # of the quartiles, in bits a word
MAX_ROWS = 8_000_000     # of the broadcast model: 12 bytes each
SLICE_BYTES = 1 << 19    # of text scored at once: its arrays stay in the cache
MAX_LANGS = 100_000      # of the broadcast bands: 24 bytes each
BINS = 1000              # of the histogram of perplexities, for each bit

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def base_features(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Base features of each row of a buffer."""
    n = len(off) - 1
    starts, ends, row = words(data, off)
    hasher = Hasher(data)
    head = (data & 0xC0) != 0x80  # first byte of a code point
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)

    # lines: one more than \n in each row
    nl = np.flatnonzero(data == 10)
    line_row = np.concatenate([np.arange(n), row_of(nl, off)])
    line_start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = off[1:][line_row]
    same = line_row[1:] == line_row[:-1]
    line_end[:-1][same] = line_start[1:][same] - 1
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, line_start, line_end = line_row[worded], line_start[worded], line_end[worded]
    key = mix(hasher.span(line_start, line_end) ^ mix(line_row.astype(U) + U(1)))
    dup_lines = np.bincount(line_row[_later(key)], minlength=n)

    # three-word windows
    h = hasher.span(starts, ends)
    window = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    key = mix(h[window] * U(3) + mix(h[window + 1] * U(5) + mix(h[window + 2] * U(7) + row[window].astype(U))))
    again = np.zeros(len(row) + 2, bool)
    twice = window[_several(key)]
    for k in range(3):
        again[twice + k] = True
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_row(solid & head, off),
        "n_symbols": per_row(IS_SYMBOL[data], off),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(row[again[: len(row)]], minlength=n),
    }


def _later(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _several(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


# ---------------------------------------------------------------- the model

def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c) over all rows of (lang long, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, Counter] = {}
        for batch in slices(batches, "text"):
            lang = batch.column("lang").to_numpy()
            by = np.argsort(lang, kind="stable")
            data, off = buffer(batch.column("text").take(pa.array(by)))
            grams = byte_grams(data, off, order)
            names, first = np.unique(lang[by], return_index=True)
            for name, a, b in zip(names.tolist(), off[first].tolist(), off[np.append(first[1:], len(lang))].tolist()):
                counters.setdefault(name, Counter()).add(grams[a:b])
        for name, counter in counters.items():
            grams, n = counter.merge()
            for at in range(0, len(grams), 1 << 16):
                g = grams[at: at + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), name, np.int64)), pa.array(g), pa.array(n[at: at + (1 << 16)])], names=["lang", "gram", "n"])

    return (docs.select("lang", "text").mapInArrow(count, "lang long, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("c")))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of (lang, c): one row a language."""
    seen = [F.greatest(F.count_if(F.col("c") == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05)) for k in (1, 2, 3)]
    return counts.groupBy("lang").agg(*seen).select("lang", *[x.alias(f"d{k + 1}") for k, x in enumerate(d)])


def kneser_ney(counts: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> DataFrame:
    """(lang, gram, p): interpolated modified Kneser-Ney probability of the
    last byte of every counted gram after the bytes before it.

    The grams of each order are written once. Discounts, one row a language, are
    broadcast up to ``MAX_LANGS`` languages, so gram rows are never dealt out by
    their language alone."""
    scratch = scratch or Scratch(counts.sparkSession)
    tables = {order: counts}
    for n in range(order - 1, 0, -1):  # continuation counts: distinct bytes before
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        tables[n] = scratch.table(tables[n + 1].groupBy("lang", low.alias("gram")).agg(F.count("*").alias("c")), f"grams-{n}")
    lower = None
    for n in range(1, order + 1):
        t = tables[n].withColumn("ctx", F.shiftright("gram", 8))
        by_lang = scratch.table(discounts(t), f"discounts-{n}")
        if by_lang.count() <= MAX_LANGS:
            by_lang = F.broadcast(by_lang)
        t = t.join(by_lang, "lang").withColumn(
            "d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
        t = t.join(context, ["lang", "ctx"])
        if lower is None:
            below = F.lit(1 / 256)
        else:
            t = t.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(
                lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low")), ["lang", "low"])
            below = F.col("p_low")
        lower = scratch.table(
            t.select("lang", "gram", ((F.col("c") - F.col("d") + F.col("held") * below) / F.col("total")).alias("p")), f"probabilities-{n}")
    scratch.drop(*[f"{name}-{n}" for n in range(1, order) for name in ("grams", "probabilities")], *[f"discounts-{n}" for n in range(1, order + 1)])
    return lower


def _key(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The gram's key in its language's part of the hash table."""
    return gram ^ lang * U(0x9E3779B97F4A7C15)


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of (row, lang long, text) as (row, lang, n_bytes, n_words ..
    n_repeat_words, byte_bits): base features and log2 perplexity a byte (0 for
    an empty text)."""
    features = "n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    row = docs.schema["row"].dataType.simpleString()
    if model.count() > max_rows:
        return _joined(docs, model, order, features, row)
    spark = docs.sparkSession
    table = to_arrays(model)
    held = spark.sparkContext.broadcast(HashTable(
        _key(table["gram"].astype(U), table["lang"].view(U)), np.log2(table["p"]).astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        logp = np.append(table.values[0], np.float32(-8.0))  # the last for what was not counted
        for batch in slices(batches, "text", SLICE_BYTES):
            data, off = buffer(batch.column("text"))
            lang = np.repeat(batch.column("lang").to_numpy().view(U), np.diff(off))
            bits = -sum_rows(logp[table.find(_key(byte_grams(data, off, order), lang))], off) / np.maximum(np.diff(off), 1)
            yield _batch(batch, data, off, bits)

    return docs.mapInArrow(score, f"row {row}, lang long, {features}, byte_bits double")


def _batch(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray, bits: np.ndarray | None) -> pa.RecordBatch:
    f = {"n_bytes": pa.array(np.diff(off), pa.int64())}
    f |= {k: pa.array(v, pa.int64()) for k, v in base_features(data, off).items()}
    if bits is not None:
        f["byte_bits"] = pa.array(bits)
    return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lang"), *f.values()], names=["row", "lang", *f])


def _joined(docs: DataFrame, model: DataFrame, order: int, features: str, row: str) -> DataFrame:
    """The way beyond ``max_rows``: gram counts of each text joined to the model
    (log probabilities in single precision, as in the table)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, sha = batch.column("lang").to_numpy(), batch.column("sha")
            data, off = buffer(batch.column("text"))
            grams = byte_grams(data, off, order)
            for k in range(batch.num_rows):
                g, n = unique_counts(grams[off[k]: off[k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sha[k].as_py()] * len(g), pa.string()), pa.array(np.full(len(g), lang[k])), pa.array(g.astype(np.int64)), pa.array(n)],
                    names=["sha", "lang", "gram", "n"])

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b = _batch(batch, *buffer(batch.column("text")), None)
            yield pa.RecordBatch.from_arrays([*b.columns, batch.column("sha")], names=[*b.schema.names, "sha"])

    keyed = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    # equal texts add up to the same mean
    bits = (
        keyed.select("lang", "sha", "text").mapInArrow(spell, "sha string, lang long, gram long, n long")
        .join(model, ["lang", "gram"], "left")
        .groupBy("lang", "sha").agg(
            (-F.sum(F.col("n") * F.coalesce(F.log2("p").cast("float").cast("double"), F.lit(-8.0))) / F.sum("n")).alias("byte_bits")))
    return (keyed.mapInArrow(only, f"row {row}, lang long, {features}, sha string")
            .join(bits, ["lang", "sha"], "left")
            .select("row", "lang", *[f.split()[0] for f in features.split(", ")], F.coalesce("byte_bits", F.lit(0.0)).alias("byte_bits")))


def bands(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, low, high) from the histogram of log2 perplexities of each language."""
    bins = scored.where(~F.col("base_failed")).groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    up = bins.withColumn("upto", F.sum("n").over(W.partitionBy("lang").orderBy("bin"))).withColumn(
        "all", F.sum("n").over(W.partitionBy("lang")))
    quartile = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / BINS for q in (0.25, 0.75)]
    spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(LEAST_SPREAD))
    return (up.groupBy("lang").agg(quartile[0].alias("q25"), quartile[1].alias("q75"))
            .select("lang", (F.col("q25") - fence * spread).alias("low"), (F.col("q75") + fence * spread).alias("high")))


def judge(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang",
          fence: float = FENCE, max_rows: int = MAX_ROWS) -> DataFrame:
    """Every row of ``docs``: the struct ``row`` of its ``carry`` columns (all
    by default), base features, base_failed, bits, the band (low, high), kept."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.xxhash64(F.coalesce(F.concat(F.lit("0"), F.col(lang_col).cast("string")), F.lit("1"))).alias("lang"),
        F.col(text_col).cast("string").alias("text"))
    counts = scratch.table(count_grams(rows), "gram-counts")
    model = kneser_ney(counts, scratch=scratch)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scratch.table(perplexities(rows, model, max_rows=max_rows).withColumn("base_failed", failed)
                           .withColumn("bits", F.col("byte_bits") * F.col("n_bytes") / F.greatest("n_words", F.lit(1))), "perplexities")
    scratch.drop("gram-counts", f"probabilities-{ORDER}")
    inside = F.col("bits").between(F.col("low"), F.col("high"))
    limits = scratch.table(bands(scored, fence), "bands")
    if limits.count() <= MAX_LANGS:  # else both sides are shuffled
        limits = F.broadcast(limits)
    return scored.join(limits, "lang", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judge(docs, **options).where("kept").select("row.*")
