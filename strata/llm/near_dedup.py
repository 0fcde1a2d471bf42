"""Near-duplicate detection by improved consistent weighted sampling (operator 9).

Documents are bags of five-word shingles (words lower-cased A-Z) with weights
tf * idf ** ``DAMP``. Two documents are linked when their weighted Jaccard
similarity, sum of minima over sum of maxima, is 0.8 or more; classes are the
connected components of the links.

- Document frequencies are counted for every shingle (64-bit hash) over all
  documents: tasks deal their shingles out by ranges of the hash, each range is
  counted whole, and the counts above one go back to the texts they came from.
- Ioffe's sampling draws ``SAMPLES`` (shingle, level) samples a document; two
  documents agree on a sample with the probability of their similarity.
  ``BANDS`` bands of ``ROWS`` samples make the candidates: a pair at 0.8 is
  missed by all bands with probability 0.488 ** 10 < 0.001.
- Equal word sequences are one node. In each band bucket the members are
  first compared with one leader: pairs that agree on half of their samples
  are verified on their whole texts, which joins large groups of copies in one
  linear step. By the triangle inequality of the distance 1 - similarity,
  members close to a leader are done if nobody outside its component is near it.
- What is left of a bucket and still in different components is compared
  exactly inside a task, whole texts of at most ``BLOCK`` members and
  ``BLOCK_BYTES`` at a time, as products of shingle matrices; only the links
  that join components come out. Larger rests are dealt into blocks of half
  that size and every two blocks are compared. Rests of more than ``SPLIT``
  blocks are first split into finer buckets (two more samples, all ``PAIRS``
  choices, then again a leader), ``DEPTH`` times at most: a pair at 0.8 misses
  both splits with probability 0.36 ** 14 < 0.000001, and what is too large
  after them is compared in blocks however large it is.
- Rounds, links and components are tables; no group is gathered whole.

A text of fewer than five words is one shingle; a text without words (null,
empty, blank) is in a class of its own with nothing else but equal ones: no
links. Rows that repeat id and text are one document. Null ids are larger
than others when a class names its smallest id; a class of null ids has none.
An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, keep_chosen, text_sha
from strata.llm.components import components
from strata.llm.textops import Hasher, HashTable, U, buffer, lower_ascii, mix, slices, words

WORDS = 5
SIMILARITY = 0.8
DAMP = 0.25
PARTS = 64                 # ranges of shingle hashes at least
PART_BYTES = 3 << 20       # of text for each range
DEAL_BYTES = 1 << 20       # of text whose shingles are dealt out at once
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
PAIRS = SAMPLES // 2
AGREE = SAMPLES // 2       # samples in common before a pair is verified
NEAR = int(SAMPLES * 0.4)  # beyond the triangle inequality's 0.6, with room for sampling
BLOCK = 2500               # members of a bucket that are compared in one task
BLOCK_BYTES = 8 << 20      # and bytes of their texts
SPLIT = 16                 # blocks of a bucket before it is split
DEPTH = 2                  # splits before all blocks are compared
COLUMNS = 1024             # of the shingle matrix at once
TABLE = 1 << 16            # variates of each kind
PIECE = 1 << 14            # shingles sampled at once

_rng = np.random.default_rng(20170817)
_R = _rng.gamma(2.0, 1.0, TABLE).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, TABLE)).astype(np.float32)
_B = _rng.random(TABLE).astype(np.float32)
_ODD = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, SAMPLES)]


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row: (row, hash, tf), and 16 bytes that name the
    word sequence of each row."""
    n = len(off) - 1
    low = lower_ascii(data)
    starts, ends, row = words(low, off)
    h = Hasher(low).span(starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    # sums of word hashes times powers of two constants name the sequence
    place = (np.arange(len(row)) - first[row]).astype(U)
    node = np.empty((n, 2), U)
    for k in (0, 1):
        term = mix(h + mix(place + U(k * 0x5851F42D4C957F2D + 1)))
        total = np.zeros(len(row) + 1, U)
        np.cumsum(term, out=total[1:])
        node[:, k] = mix(total[first + count] - total[first] + count.astype(U))
    at = np.flatnonzero(row[WORDS - 1:] == row[: len(row) - WORDS + 1]) if len(row) >= WORDS else np.zeros(0, np.int64)
    key = np.zeros(len(at), U)
    for k in range(WORDS):
        key = mix(key + h[at + k])
    short = np.flatnonzero((count > 0) & (count < WORDS))
    row = np.concatenate([row[at], short])
    key = np.concatenate([key, node[short, 0]])
    # by row, then key: rows are few, and 16 bits are sorted in linear time
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    new = np.flatnonzero(new)
    return row[new], key[new], np.diff(np.append(new, len(row))), node


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each run of equal ``group`` (sorted)."""
    rows: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            if rows and row["group"] != rows[0]["group"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def document_frequencies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(sha, known, df): for each text with shingles that stand in more than
    one document their hashes and numbers of documents, as packed arrays, and
    the number of documents. The shingles of a slice of texts travel packed, a
    row for each range of hashes. The counts are a table of their own, so that
    all shingles dealt out are off the disk when the counts travel back."""
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(PARTS, -(-size // PART_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", DEAL_BYTES)):
            row, key, _, _ = shingles(*buffer(batch.column("text")))
            if not len(key):
                continue
            shas = "".join(batch.column("sha").to_pylist()).encode()
            name = int.from_bytes(hashlib.blake2b(shas + b"%d-%d" % (task, number), digest_size=8).digest(), "little", signed=True)
            part = ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # the order of rows stays
            some, first = np.unique(part[order], return_index=True)
            last = np.append(first[1:], len(order))
            row, key = row[order], key[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), name)), pa.array([shas] + [None] * (len(some) - 1), pa.binary()),
                 pa.array([np.diff(row[a:b], prepend=0).astype("<u4").tobytes() for a, b in zip(first, last)], pa.binary()),
                 pa.array([key[a:b].tobytes() for a, b in zip(first, last)], pa.binary())],
                names=["group", "slice", "shas", "steps", "known"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            keys = [np.frombuffer(r["known"], U) for r in rows]
            _, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            n, out = n[place], []
            for r, key, df in zip(rows, keys, np.split(n, np.cumsum([len(k) for k in keys])[:-1])):
                many = df > 1
                if r["shas"] is not None or many.any():
                    row = np.cumsum(np.frombuffer(r["steps"], "<u4"))[many]
                    out.append((r["slice"], r["shas"], np.diff(row, prepend=0).astype("<u4").tobytes(), key[many].tobytes(),
                                df[many].astype("<u4").tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                             names=["group", "shas", "steps", "known", "df"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            shas = next(r["shas"] for r in rows if r["shas"] is not None).decode()
            row = np.concatenate([np.cumsum(np.frombuffer(r["steps"], "<u4").astype(np.int64)) for r in rows])
            key, df = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("known", U), ("df", "<u4")))
            order = np.argsort(row, kind="stable")
            row, key, df = row[order], key[order], df[order]
            some, first = np.unique(row, return_index=True)
            last = np.append(first[1:], len(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shas[64 * k: 64 * k + 64] for k in some.tolist()], pa.string()),
                 *[pa.array([x[a:b].tobytes() for a, b in zip(first, last)], pa.binary()) for x in (key, df)]],
                names=["sha", "known", "df"])

    counted = scratch.table(
        docs.select("sha", "text").mapInArrow(deal, "group long, slice long, shas binary, steps binary, known binary")
        .repartition("group").sortWithinPartitions("group")
        .mapInArrow(count, "group long, shas binary, steps binary, known binary, df binary"), "counted")
    found = (counted.repartition("group").sortWithinPartitions("group")
             .mapInArrow(gather, "sha string, known binary, df binary"))
    found = scratch.table(found.dropDuplicates(["sha"]), "frequencies")
    scratch.drop("counted")
    return found, n_docs


def damped_idf(row: np.ndarray, key: np.ndarray, known: pa.Array, df: pa.Array, n_docs: int) -> np.ndarray:
    """Weight of each shingle; those that are not ``known`` in their row stand
    in one document."""
    data, off = buffer(known)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off) // 8)
    name = mix(data.view(U) ^ mix(owner.astype(U) + U(1)))
    table = HashTable(name, buffer(df)[0].view("<u4"))
    place = table.find(mix(key ^ mix(row.astype(U) + U(1))))
    hit = place >= 0
    number = np.ones(len(key))
    number[hit] = table.values[0][place[hit]]
    return np.log1p(n_docs / number) ** DAMP


def consistent_samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES x n matrix of 32-bit sample names (rows without shingles: 0)."""
    out = np.zeros((SAMPLES, n), np.uint32)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    ln_w = np.log(weight).astype(np.float32)
    # whole rows, few enough for all arrays of a sample to stay in the processor's cache
    cut = np.unique(np.searchsorted(first, np.arange(0, len(row), PIECE)))
    cut = np.append(cut[cut < len(first)], len(first))
    first = np.append(first, len(row))
    here = np.arange(int(np.diff(first[cut]).max()))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        low, high = int(first[a]), int(first[b])
        _sample(out, row[first[a:b]], key[low:high], ln_w[low:high], first[a:b] - low, here[: high - low])
    return out


def _sample(out: np.ndarray, rows: np.ndarray, key: np.ndarray, ln_w: np.ndarray, first: np.ndarray, here: np.ndarray) -> None:
    """The samples of ``rows``, whose shingles begin at ``first``, go to ``out``."""
    for k in range(SAMPLES):
        g = key * U(_ODD[k])  # the keys are mixed already
        r = _R.take((g >> U(48)).view(np.int64), mode="wrap")
        b = _B.take((g >> U(32) & U(0xFFFF)).view(np.int64), mode="wrap")
        t = ln_w / r
        t += b
        np.floor(t, out=t)
        b -= t
        b -= np.float32(1)
        b *= r
        b += _LN_C.take((g >> U(16) & U(0xFFFF)).view(np.int64), mode="wrap")
        bits = b.view(np.int32)
        bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)  # in the order of b
        bits <<= 32
        bits |= here
        best = np.minimum.reduceat(bits, first) & 0xFFFFFFFF
        out[k, rows] = (mix(g[best] + t[best].astype(np.int64).astype(U)) >> U(32)).astype(np.uint32) | np.uint32(1)


def sketch(docs: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, sha, node, sig, keys) of rows (doc_id, sha, text, known, df);
    texts without words have neither sig nor keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            row, key, tf, node = shingles(*buffer(batch.column("text")))
            sig = consistent_samples(row, key, tf * damped_idf(row, key, batch.column("known"), batch.column("df"), n_docs), n)
            bands = np.empty((n, BANDS), U)
            for b in range(BANDS):
                x = np.full(n, b + 1, U)
                for s in sig[b * ROWS: (b + 1) * ROWS]:
                    x = mix(x + s.astype(U))
                bands[:, b] = x
            raw, some = np.ascontiguousarray(sig.T).astype("<u4").tobytes(), np.zeros(n, bool)
            some[row] = True
            names = node.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"),
                 pa.array([names[16 * k: 16 * k + 16] for k in range(n)], pa.binary()),
                 pa.array([raw[4 * SAMPLES * k: 4 * SAMPLES * (k + 1)] if some[k] else None for k in range(n)], pa.binary()),
                 pa.array([x if s else None for x, s in zip(bands.astype(np.int64).tolist(), some)], pa.list_(pa.int64()))],
                names=["doc_id", "sha", "node", "sig", "keys"])

    return docs.mapInArrow(run, f"doc_id {kind}, sha string, node binary, sig binary, keys array<long>")


def _fixed(col: pa.Array, width: int) -> np.ndarray:
    data, _ = buffer(col)
    return data.view("<u4").reshape(-1, width)


def agreement(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, last, node, sig, root, lead, lead_sig, lead_root) with ``agree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_fixed(b.column("sig"), SAMPLES) == _fixed(b.column("lead_sig"), SAMPLES)).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(same, pa.int32())],
                                             names=[*b.schema.names[:7], "agree"])

    return (pairs.select("key", "last", "node", "sig", "root", "lead", "lead_root", "lead_sig")
            .mapInArrow(run, "key long, last int, node binary, sig binary, root binary, lead binary, lead_root binary, agree int"))


def similarities(pairs: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, on their whole texts."""

    def bag(b: pa.RecordBatch, side: str):
        row, key, tf, _ = shingles(*buffer(b.column(f"text_{side}")))
        weight = tf * damped_idf(row, key, b.column(f"known_{side}"), b.column(f"df_{side}"), n_docs)
        return row, mix(key ^ mix(row.astype(U) + U(1))), weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(slices([batch], "text_a"), "text_b"):
                n = b.num_rows
                (ra, ka, wa), (rb, kb, wb) = bag(b, "a"), bag(b, "b")
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                common = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), minlength=n)
                whole = np.bincount(ra, wa, minlength=n) + np.bincount(rb, wb, minlength=n) - common
                yield pa.RecordBatch.from_arrays(
                    [b.column("a"), b.column("b"), pa.array(common / np.maximum(whole, 1e-12))], names=["a", "b", "similarity"])

    def of(side: str) -> DataFrame:
        return texts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("text", "known", "df")])

    return (pairs.join(of("a"), "a").join(of("b"), "b")
            .mapInArrow(run, "a binary, b binary, similarity double"))


def _finer(members: DataFrame) -> DataFrame:
    """Members in every finer bucket: the key with one more pair of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _fixed(b.column("sig"), SAMPLES).astype(U)
            key, last = b.column("key").to_numpy().view(U), b.column("last").to_numpy()
            for j in range(PAIRS):
                go = np.flatnonzero(last < j)
                if not len(go):
                    continue
                x = mix(mix(mix(key[go] + U(j + 1)) + sig[go, 2 * j]) + sig[go, 2 * j + 1])
                take = pa.array(go)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(np.full(len(go), j, np.int32)), b.column("node").take(take), b.column("sig").take(take)],
                    names=["key", "last", "node", "sig"])

    return members.select("key", "last", "node", "sig").mapInArrow(run, "key long, last int, node binary, sig binary")


def joining_links(texts: list[str], roots: list[bytes], known: list[bytes], df: list[bytes], n_docs: int) -> list[tuple[int, int]]:
    """Pairs of texts with similarity >= SIMILARITY, as many as are needed to
    join the components (``roots``) that such pairs join. Exact: the sum of
    minima of tf * idf is a product of 0/1 matrices with a column for each
    (shingle, occurrence), weighted by idf."""
    m = len(texts)
    row, key, tf, _ = shingles(*buffer(pa.array(texts, pa.string())))
    weight = damped_idf(row, key, pa.array(known, pa.binary()), pa.array(df, pa.binary()), n_docs)
    total = np.bincount(row, tf * weight, minlength=m)
    at = np.repeat(np.arange(len(key)), tf)
    nth = (np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)).astype(U)
    _, column, count = np.unique(mix(key[at] + mix(nth)), return_inverse=True, return_counts=True)
    met = count[column] > 1  # a shingle of one text adds to no minimum
    column = np.unique(column[met], return_inverse=True)[1]
    row, weight = row[at[met]], weight[at[met]]
    order = np.argsort(column, kind="stable")
    row, weight, column = row[order], weight[order], column[order]
    common = np.zeros((m, m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((m, COLUMNS))
        x[row[a:b], column[a:b] - low] = np.sqrt(weight[a:b])
        common += x @ x.T
    label = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
    out = []
    for i in range(m):
        near = np.flatnonzero(common[i] >= SIMILARITY * (total[i] + total - common[i]) - 1e-9)
        other = near[label[near] != label[i]]
        for name in np.unique(label[other]).tolist():
            out.append((i, int(other[label[other] == name][0])))
            label[label == name] = label[i]
    return out


def blocked(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, node): members of buckets (key, blocks) in a group for every two
    blocks; blocks go by a hash of the node."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (members.select("key", "node").join(blocks.select("key", "blocks"), "key")
             .select("key", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
             .where("mine <> other"))
    return dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node")


def rest_links(rest: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """(a, b) links that join components within the buckets of (key, node, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def done():
            found = joining_links(*([r[k] for r in rows] for k in (2, 1, 3, 4)), n_docs)
            return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][0] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "root", "text", "known", "df"))):
                if key != held and rows:
                    yield done()
                    rows = []
                held = key
                rows.append(row)
        if rows:
            yield done()

    return (rest.select("key", "node", "root").join(texts, "node").select("key", "node", "root", "text", "known", "df")
            .repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a binary, b binary"))


def near_links(sketches: DataFrame, docs: DataFrame, found: DataFrame, n_docs: int, scratch: Scratch) -> DataFrame:
    """Components (node, root) over all verified links of the sketched nodes."""
    nodes = sketches.where("sig IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "sha", "sig", "keys")).alias("r"))
    nodes = scratch.table(nodes.select("node", "r.doc_id", "r.sha", "r.sig", "r.keys"), "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    active = scratch.table(banded.join(shared, "key", "left_semi"), "active")
    wanted = active.select("node").distinct().join(nodes.select("node", "doc_id", "sha"), "node")
    texts = scratch.table(
        docs.join(wanted.withColumnRenamed("doc_id", "_id"), (docs["sha"] == wanted["sha"]) & docs["doc_id"].eqNullSafe(F.col("_id")))
        .select("node", docs["sha"], "text").dropDuplicates(["node"]).join(found, "sha", "left").drop("sha"), "near-texts")
    members = active.join(nodes.select("node", "sig"), "node").withColumn("last", F.lit(-1))
    spark = docs.sparkSession
    links = Links(texts, n_docs, scratch, spark)
    weights = texts.select("node", F.octet_length("text").alias("bytes"))
    rest = None
    for depth in range(DEPTH + 1):  # leaders; buckets beyond SPLIT blocks go round again as finer ones
        placed = scratch.table(links.rooted(members), f"members-{links.round}")
        lead = placed.groupBy("key").agg(
            F.min(F.struct("node", "sig", "root")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        pairs = placed.join(lead.select("key", F.col("lead.node").alias("lead"), F.col("lead.sig").alias("lead_sig"),
                                        F.col("lead.root").alias("lead_root")), "key")
        compared = scratch.table(agreement(pairs), f"compared-{links.round}")
        links.verify(compared.where((F.col("agree") >= AGREE) & (F.col("root") != F.col("lead_root"))).select(
            F.col("lead").alias("a"), F.col("node").alias("b")))
        now = links.rooted(compared.drop("root", "lead_root")).join(
            links.rooted(compared.select("key", F.col("lead").alias("node")).distinct()).select("key", F.col("root").alias("lead_root")), "key")
        now = now.withColumn("with_lead", F.col("root") == F.col("lead_root"))
        state = now.groupBy("key").agg(F.max(F.when(~F.col("with_lead"), F.col("agree"))).alias("nearest")).where("nearest IS NOT NULL")
        # close to the leader and nobody else near: done
        left = now.join(state, "key").where(
            ~F.col("with_lead") | (F.col("nearest") >= NEAR) | (F.col("agree") < SAMPLES - AGREE // 2))
        left = scratch.table(left.select("key", "last", "node", "sig", "root"), f"left-{links.round}")
        sizes = left.join(weights, "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
        fits = (F.col("n") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES) | (F.col("n") == 2)
        small = left.join(sizes.where(fits).select("key"), "key", "left_semi").select("key", "node")
        rest = small if rest is None else rest.unionByName(small)
        # blocks are half full on average, two of them about one BLOCK
        blocks = F.greatest(F.ceil(2 * F.col("n") / BLOCK), F.ceil(2 * F.col("bytes") / BLOCK_BYTES))
        large = left.join(sizes.where(~fits).select("key", F.least(blocks, F.col("n")).alias("blocks")), "key")
        if large.isEmpty():
            break
        final = F.lit(depth == DEPTH) | (F.col("last") == PAIRS - 1) | (F.col("blocks") <= SPLIT)
        rest = rest.unionByName(blocked(large, large.where(final).select("key", "blocks").distinct()))
        members = large.where(~final)
        if depth == DEPTH or members.isEmpty():
            break
        members = scratch.table(_finer(members), f"finer-{links.round}")
    rooted = links.rooted(rest)
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    links.add(scratch.table(rest_links(rooted.join(open_, "key", "left_semi"), texts, n_docs), "rest"))
    return links.roots


class Links:
    """Pairs verified so far and the components of those that are links."""

    def __init__(self, texts: DataFrame, n_docs: int, scratch: Scratch, spark):
        self.texts, self.n_docs, self.scratch = texts, n_docs, scratch
        self.round, self.done = 0, None
        self.roots = spark.createDataFrame([], "node binary, root binary")

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the root of their node's component."""
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def verify(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        if self.done is not None:
            pairs = pairs.join(self.done.select("a", "b"), ["a", "b"], "left_anti")
        new = self.scratch.table(similarities(pairs, self.texts, self.n_docs), f"checked-{self.round}")
        self.done = new if self.done is None else self.done.unionByName(new)
        self.add(new.where(F.col("similarity") >= SIMILARITY).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        if not links.isEmpty():  # the stars so far stand for the earlier links
            self.roots = components(links.union(self.roots), self.scratch, f"stars-{self.round}")
        self.round += 1


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept (the
    row is its class's first), sha (of the text) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_sha(F.col(text_col)).alias("sha"), F.col(text_col).cast("string").alias("text"))
    found, n_docs = document_frequencies(rows, scratch)
    sketches = scratch.table(sketch(rows.join(found, "sha", "left").select(*rows.columns, "known", "df"), n_docs), "sketches")
    roots = near_links(sketches, rows, found, n_docs, scratch)
    # texts without words are classes of their own, by id
    classed = sketches.select("doc_id", "sha", "node", "sig").join(roots, "node", "left").select(
        "doc_id", "sha",
        F.when(F.col("sig").isNull(), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .otherwise(F.hex(F.coalesce("root", "node"))).alias("class"))
    classed = scratch.table(classed, "classed")
    # one partial row per class, id and text; the first of them stands for the class
    first = classed.groupBy("class", "doc_id", "sha").agg(F.count("*").alias("tied")).groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "sha", "tied")).alias("first"),
        F.sum("tied").alias("class_size"))
    out = classed.join(first, "class").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))).alias("kept"),
        "sha", F.col("first.tied").alias("_tied"))
    out = scratch.table(out, "near-classes")
    scratch.drop(*[name for name in scratch.paths if name != "near-classes"])
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each class, all its columns."""
    chosen = near_classes(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "_tied").distinct()
    return keep_chosen(docs, chosen, id_col, text_col)
