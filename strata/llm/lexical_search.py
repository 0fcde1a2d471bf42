"""Ranked lexical search over hashed max-sketches (operator 12).

Score of a document for an item: the sum over the item's terms, repeats
included, of ``weight * impact``; the weight comes from the term's document
frequency, the impact from its occurrences ``tf`` in the document and the
document's length norm ``m`` (all integer arithmetic, see ``weight``, ``norm``
and ``impact``).

1. *Index.* Each document folds its impacts into a sketch: every distinct term
   has ``PROBES`` cells, and a cell holds the maximum over the terms that hash
   there. All terms of a document share ``m``, and the impact grows with
   ``tf``, so the maximum is kept as a code of ``tf`` in four bits (its upper end,
   see ``LEVELS``); sketches then stay valid when the corpus, and with it every
   ``m``, changes. A sketch has ``CELLS`` cells a distinct term. Sketches are
   written once and serve every batch of items.
2. *Bounds.* Items go in batches of ``BATCH_BYTES`` of text. For a batch the
   tasks look up all its terms in each sketch: the smallest of a term's cells
   bounds its impact, and the sums bound the scores of all the batch's items.
3. *Threshold.* The ``SEEDS`` documents of highest bound of every item are
   scored exactly; the k-th best of an item's scores is a floor for its k-th
   place.
4. *Rescoring.* Every document whose bound reaches an item's floor is scored
   exactly for it, by descending bound, as long as the bound is not below the
   task's own k-th best; nothing else can be among the k best. The k best rows
   of the tasks are ranked by a window.

The broadcast data is one batch (its terms, their weights, the floors), and the
ids of chosen documents while they are at most ``BROADCAST_IDS``; beyond that
they are joined by a shuffle. Terms are looked up by 64-bit hash and compared
byte by byte where counts are exact.

Null texts have no terms; an item without terms, or with none in the corpus, has
no rows. Rows that repeat an id are documents of their own; a null id
comes before others in a tie. Equal items are ranked each on its own. Empty tables give an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import textops
from strata.llm.common import BATCH_ROWS, Scratch

U = np.uint64

K = 10
CELLS = 8                 # a distinct term
PROBES = 3
SEEDS = 32                # documents an item that give its floor
BATCH_BYTES = 1 << 20     # of item text that is searched for at once
BROADCAST_IDS = 1 << 20
# code -> the largest tf that it stands for; the last one for any
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 24, 36, 64, 128, 1 << 62], np.int64)

# terms: ASCII letters and digits and every byte of other code points
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def impact_bound(m: np.ndarray) -> np.ndarray:
    """(documents, codes): the largest impact that a code allows."""
    tf = LEVELS[None, :-1]
    out = np.full((len(m), len(LEVELS)), 1_000_000, np.int64)   # an impact never gets there
    out[:, :-1] = impact(tf, m[:, None])
    return out


class Terms:
    """The terms of a slice of texts: hash, row and place of each occurrence."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = textops.lower_ascii(data)
        inside = IS_TERM[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:len(data)]
        end = inside
        end[:-1] &= ~inside[1:] | edge[1:len(data)]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.row = textops.row_of(self.starts, off)
        self.hash = textops.Hasher(self.data).span(self.starts, self.ends)
        self.n = np.bincount(self.row, minlength=len(off) - 1).astype(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, tf) of each distinct term of each row."""
        order = np.lexsort((self.hash, self.row))
        row, key = self.row[order], self.hash[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(first)
        return row[first], key[first], np.diff(np.append(first, len(row)))


def probes(keys: np.ndarray) -> list[np.ndarray]:
    """``PROBES`` 32-bit hashes of each key."""
    low = U(0xFFFFFFFF)
    return [keys >> U(32), keys & low, textops.mix(keys + U(0x9E3779B97F4A7C15)) & low]


def cell(probe: np.ndarray, cells) -> np.ndarray:
    """The place of a probe in a sketch of so many cells."""
    return ((probe * cells) >> U(32)).astype(np.int64)


def sketches(terms: Terms, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the sketch of each row, two cells a byte."""
    row, key, tf = terms.counts()
    cells = CELLS * np.bincount(row, minlength=n_rows)        # even
    base = np.concatenate(([0], np.cumsum(cells)))
    code = np.searchsorted(LEVELS, tf).astype(np.uint8)
    order = np.argsort(code, kind="stable")
    row, key, code = row[order], key[order], code[order]
    flat = np.zeros(int(base[-1]), np.uint8)
    at = np.stack([cell(p, cells[row].astype(U)) for p in probes(key)], 1) + base[row][:, None]
    flat[at.ravel()] = np.repeat(code, PROBES)                # ascending: the largest is written last
    return flat[0::2] | (flat[1::2] << 4), base // 2


def _index(batches):
    for part in textops.slices(batches, "text"):
        data, off = textops.buffer(part.column("text"))
        terms = Terms(data, off)
        packed, at = sketches(terms, part.num_rows)
        sketch = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(terms.n), sketch], names=["doc_id", "n", "sketch"])


def _blocks(batches):
    """Sketches, not too many at once for a matrix of bounds."""
    for part in textops.slices(batches, "sketch"):
        for at in range(0, part.num_rows, BATCH_ROWS):
            yield part.slice(at, BATCH_ROWS)


class Batch:
    """Items of a batch: their distinct terms, and per item which of them how often."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t for _, t in items], pa.string())
        data, off = textops.buffer(texts)
        terms = Terms(data, off)
        row, key, tf = terms.counts()
        self.items = np.array([i for i, _ in items], np.int64)
        self.keys, self.term = np.unique(key, return_inverse=True)
        self.row, self.times = row, tf.astype(np.int64)
        one = np.zeros(len(self.keys), np.int64)              # a place of each term
        one[np.searchsorted(self.keys, terms.hash)] = np.arange(len(terms.hash))
        length = (terms.ends - terms.starts)[one]
        self.probes = probes(self.keys)
        self.bytes = np.zeros(0, np.uint8)
        if len(one):
            self.bytes = terms.data[textops.ragged(terms.starts[one], length)]
        self.at = np.concatenate(([0], np.cumsum(length)))
        self.begin = np.searchsorted(row, np.arange(len(items)))
        self.full = np.flatnonzero(np.bincount(row, minlength=len(items)))  # items with terms
        self.gain = np.zeros(len(row), np.int64)
        self.floor = np.ones(len(items), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        # a term that no document holds adds nothing to any score
        w = np.array([weight(n_docs, df[t]) if t in df else 0 for t in range(len(self.keys))], np.int64)
        self.gain = w[self.term] * self.times

    def found(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of the occurrences of this batch's terms in texts."""
        at, hit = textops.lookup(self.keys, terms.hash)
        begin, end = terms.starts, terms.ends
        hit &= (end - begin) == np.diff(self.at)[at] if len(self.keys) else hit
        place = np.flatnonzero(hit)
        length = (end - begin)[place]
        same = terms.data[textops.ragged(begin[place], length)] == self.bytes[textops.ragged(self.at[at[place]], length)]
        if len(place):
            place = place[np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(length)[:-1])))]
        return terms.row[place], at[place]

    def frequencies(self, batches):
        total = np.zeros(len(self.keys), np.int64)
        for part in textops.slices(batches, "text"):
            row, term = self.found(Terms(*textops.buffer(part.column("text"))))
            pairs = np.unique(row * len(self.keys) + term)
            total += np.bincount(pairs % max(len(self.keys), 1), minlength=len(self.keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

    def bounds(self, part: pa.RecordBatch) -> np.ndarray:
        """(documents, items) upper bounds of the scores from sketches."""
        packed, at = textops.buffer(part.column("sketch"))
        n = part.column("n").to_numpy()
        top = impact_bound(norm(n, self.n_docs, self.n_terms))
        out = np.zeros((len(n), len(self.items)), np.int64)
        for d in np.flatnonzero(n):
            mine = packed[at[d]: at[d + 1]]
            cells = np.empty(2 * len(mine), np.uint8)
            cells[0::2], cells[1::2] = mine & 15, mine >> 4
            code = cells[cell(self.probes[0], U(len(cells)))]
            for p in self.probes[1:]:
                code = np.minimum(code, cells[cell(p, U(len(cells)))])
            out[d, self.full] = np.add.reduceat(top[d][code][self.term] * self.gain, self.begin[self.full])
        return out

    def _chosen(self, part: pa.RecordBatch, doc: np.ndarray, item: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(doc)), pa.array(self.items[item]), pa.array(bound)],
            names=["doc_id", "_item", "bound"])

    def best(self, batches, k: int):
        """Rows (doc_id, _item, bound): the k highest bounds of each item in a slice."""
        for part in _blocks(batches):
            b = self.bounds(part)
            doc = np.argpartition(-b, min(k, len(b)) - 1, 0)[:k].ravel()
            item = np.tile(np.arange(len(self.items)), min(k, len(b)))
            some = b[doc, item] > 0
            yield self._chosen(part, doc[some], item[some], b[doc, item][some])

    def reach(self, batches):
        """Rows (doc_id, _item, bound) of the bounds that reach the items' floors."""
        for part in _blocks(batches):
            b = self.bounds(part)
            doc, item = np.nonzero(b >= self.floor)
            yield self._chosen(part, doc, item, b[doc, item])

    def scores(self, batches, k: int, floors: bool):
        """Exact scores of (doc_id, text, wanted: items with bounds); rows
        (doc_id, _item, score) that may be among an item's k best."""
        place = {int(i): x for x, i in enumerate(self.items)}
        best: list[list[int]] = [[] for _ in self.items]       # the k best scores so far, per item
        by_item = np.split(np.arange(len(self.row)), self.begin[1:]) if len(self.items) else []
        for part in textops.slices(batches, "text"):
            terms = Terms(*textops.buffer(part.column("text")))
            row, term = self.found(terms)
            m = norm(terms.n, self.n_docs, self.n_terms)
            pair, tf = np.unique(row * max(len(self.keys), 1) + term, return_counts=True)
            row, term = np.divmod(pair, max(len(self.keys), 1))
            value = impact(tf.astype(np.int64), m[row])
            span = np.searchsorted(row, np.arange(part.num_rows + 1))
            wanted = part.column("wanted")
            flat = wanted.flatten()
            item_of, bound_of = flat.field("item").to_numpy(), flat.field("bound").to_numpy()
            doc_of = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            docs, items, out = [], [], []
            held = np.zeros(len(self.keys), np.int64)
            order = np.lexsort((-bound_of, doc_of)) if not floors else np.argsort(-bound_of, kind="stable")
            now = -1
            for x in order:
                i, d = place[int(item_of[x])], int(doc_of[x])
                top = best[i]
                if floors and len(top) == k and bound_of[x] < top[0]:
                    continue
                if d != now:
                    held[:] = 0
                    held[term[span[d]: span[d + 1]]] = value[span[d]: span[d + 1]]
                    now = d
                of = by_item[i]
                s = int((held[self.term[of]] * self.gain[of]).sum())
                if s <= 0 or (len(top) == k and s < top[0]):
                    continue
                top.append(s)
                top.sort()
                del top[:-k]
                docs.append(d)
                items.append(int(item_of[x]))
                out.append(s)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(items, pa.int64()), pa.array(out, pa.int64())],
                names=["doc_id", "_item", "score"])


def _batches(items: DataFrame, limit: int):
    """Items (_item, text) in batches of bounded text; the driver streams them."""
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r._item, r.text))
        size += len(r.text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n, sketch) of (doc_id, text)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    return scratch.table(docs.mapInArrow(_index, schema), "search-sketches")


def _rescore(docs: DataFrame, chosen: DataFrame, batch: Batch, k: int, floors: bool) -> DataFrame:
    """Exact scores of chosen (doc_id, _item, bound), read from the texts."""
    per_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("_item").alias("item"), "bound")).alias("wanted"))
    # an id has at most one entry for each item of the batch and row of the id
    few = per_doc.select("doc_id").limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    right = per_doc.withColumnRenamed("doc_id", "_id")
    rows = docs.join(F.broadcast(right) if few else right, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "wanted")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("_item", T.LongType()), T.StructField("score", T.LongType())])
    return rows.mapInArrow(lambda batches: batch.scores(batches, k, floors), schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", batch_bytes: int = BATCH_BYTES, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every row of
    ``items`` with a score above 0; equal scores by id."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = scratch.table(items.select(
        F.monotonically_increasing_id().alias("_item"), F.col(item_col).alias("item_id"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")), "search-items")
    index = build_index(docs, scratch)
    whole = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    chosen_schema = T.StructType([docs.schema["doc_id"], T.StructField("_item", T.LongType()), T.StructField("bound", T.LongType())])
    in_item = W.partitionBy("_item").orderBy(F.col("score").desc(), "doc_id")
    results = []
    for number, held in enumerate(_batches(items.select("_item", "text"), batch_bytes)):
        batch = Batch(held)
        if not len(batch.keys):
            continue
        counts = (docs.select("text").mapInArrow(batch.frequencies, "term long, df long")
                  .groupBy("term").agg(F.sum("df").alias("df")))
        batch.weigh({r.term: r.df for r in counts.collect()}, whole.docs, whole.terms)
        by_bound = W.partitionBy("_item").orderBy(F.col("bound").desc())
        first = scratch.table(
            index.mapInArrow(lambda b, batch=batch: batch.best(b, seeds), chosen_schema)
            .withColumn("_at", F.row_number().over(by_bound)).where(F.col("_at") <= seeds).drop("_at"),
            f"search-seeds-{number}")
        kth = (_rescore(docs, first.groupBy("doc_id", "_item").agg(F.max("bound").alias("bound")), batch, k, False)
               .withColumn("_at", F.row_number().over(in_item)).where(F.col("_at") == k).select("_item", "score").collect())
        place = {int(i): x for x, i in enumerate(batch.items)}
        for r in kth:
            batch.floor[place[r._item]] = r.score
        chosen = scratch.table(
            index.mapInArrow(batch.reach, chosen_schema).groupBy("doc_id", "_item").agg(F.max("bound").alias("bound")),
            f"search-chosen-{number}")
        results.append(scratch.table(
            _rescore(docs, chosen, batch, k, True).withColumn("rank", F.row_number().over(in_item)).where(F.col("rank") <= k),
            f"search-best-{number}"))
        scratch.drop(f"search-seeds-{number}", f"search-chosen-{number}")
    if not results:
        none = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"],
                             T.StructField("score", T.LongType())])
        return spark.createDataFrame([], none)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    scratch.drop("search-sketches")
    return found.join(items.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
