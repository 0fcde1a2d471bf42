"""Removal of repeated passages through suffix arrays (operator 3).

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else (in the same text or another) is removed; strings never cross texts and
are judged on the input.

- Each window of ``LENGTH`` bytes goes by the smallest hash of its
  ``GRAM``-byte substrings: equal windows have equal keys. Neighbouring windows
  share keys, so a text becomes about one segment (a run of windows) for every
  150 bytes. Segments whose key occurs once can hold no repeated window.
- The others, with their bytes, meet by key. Equal segments are one with a
  count (combined before the shuffle, so a passage that stands in every text
  is one row a task). Keys with more than ``HOT`` segments are split by further
  minima, which divides what differs while equal windows stay together. Their
  windows' hashes are counted over all tasks, and only repeated windows go on,
  those of up to ``FEW`` places each by its own hash, the others in runs by key
  and count: equal windows have equal counts, and windows of more places are few.
- In each key's segments, windows whose hash is single are left out; what
  remains is cut into strings, and equal ones are counted. All strings are
  sorted by suffix arrays (``gsaca``), those of a key that share windows in one
  and each other in its own: suffixes that agree on ``LENGTH`` bytes are
  neighbours there, and a window is repeated when its neighbours' counts add up
  to two or more. A task sorts the texts of many keys side by side.
- The byte ranges found go back to their texts.

Texts are UTF-8 bytes; null and shorter texts keep all. Equal texts are
worked on once, with a count. Columns beside id and text are not looked at;
null and repeated ids are fine; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch
from strata.llm.gsaca import suffix_arrays
from strata.llm.textops import Hasher, U, buffer, mix, ragged, slices, unique_counts

LENGTH = 400
GRAM = 64
HOT = 2000
FEW = 1000
LONGEST = 4096  # windows of one segment
SORT_BYTES = 2 << 20  # strings that a task sorts at once


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by the first of them."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    full = -(-len(x) // width) * width
    wide = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    wide[: len(x)] = x
    blocks = wide.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def window_keys(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Key of every window from its grams' hashes; ``level`` more minima."""
    key = sliding_min(hashes, width)
    for k in range(level):
        key = mix(key + sliding_min(mix(hashes + U(k + 1)), width))
    return key


def runs(values: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of equal neighbours, cut at ``breaks`` and
    to LONGEST."""
    if not len(values):
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.ones(len(values), bool)
    edge[1:] = values[1:] != values[:-1]
    if breaks is not None:
        edge |= breaks
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(values)))
    if len(length) and length.max() > LONGEST:
        parts = -(-length // LONGEST)
        starts = ragged(np.zeros(len(length), np.int64), parts) * LONGEST + np.repeat(first, parts)
        length = np.diff(np.append(starts, len(values)))
        first = starts
    return first, length


def segment(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, sha, n_bytes, keys, starts, windows, several) for each row of
    (doc_id, sha, text): its segments; ``several`` where a key's gram occurs
    twice in the text."""
    gram = min(GRAM, length)
    width = length - gram + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = buffer(batch.column("text"))
            size = np.diff(off)
            count = np.maximum(size - length + 1, 0)
            at = ragged(off[:-1], count)  # all window starts
            edges = np.concatenate([[0], np.cumsum(count)])
            key, several = np.zeros(0, U), np.zeros(0, bool)
            first = n = np.zeros(0, np.int64)
            if len(at):
                hashes = Hasher(data).windows(gram)
                least = sliding_min(hashes, width)[at]
                breaks = np.zeros(len(at) + 1, bool)
                breaks[edges] = True
                first, n = runs(least, breaks[:-1])
                key = least[first]
                # grams that equal a key, counted in each text
                row = np.searchsorted(edges, first, "right") - 1
                mark = np.zeros(1 << 20, bool)
                mark[(key & U(0xFFFFF)).astype(np.int64)] = True
                spot = np.flatnonzero(mark[(hashes & U(0xFFFFF)).astype(np.int64)])
                inside = np.searchsorted(off, spot, "right") - 1
                whole = spot + gram <= off[inside + 1]
                spot, inside = spot[whole], inside[whole]
                have = np.sort(mix(hashes[spot] + mix(inside.astype(U))))
                want = mix(key + mix(row.astype(U)))
                several = np.searchsorted(have, want, "right") - np.searchsorted(have, want, "left") > 1
            cut = pa.array(np.searchsorted(first, edges).astype(np.int32))
            local = first - np.repeat(edges[:-1], np.diff(np.searchsorted(first, edges)))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in
                     (key.view(np.int64), local.astype(np.int32), n.astype(np.int32), several)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(size), *lists],
                                             names=["doc_id", "sha", "n_bytes", "keys", "starts", "windows", "several"])

    return docs.mapInArrow(run, f"doc_id {kind}, sha binary, n_bytes long, keys array<long>, starts array<int>, "
                                "windows array<int>, several array<boolean>")


def shared_segments(segmented: DataFrame, scratch: Scratch) -> DataFrame:
    """(sha, copies, found): the segments of each distinct text whose key
    occurs again, with the splitting level of the key."""
    copies = segmented.groupBy("sha").agg(F.count("*").alias("copies"))
    texts = segmented.drop("doc_id", "n_bytes").where(F.size("keys") > 0).dropDuplicates(["sha"]).join(copies, "sha")
    flat = scratch.table(
        texts.select("sha", "copies", F.explode(F.arrays_zip("keys", "starts", "windows", "several")).alias("s"))
        .select("sha", "copies", F.col("s.keys").alias("key"), F.col("s.starts").alias("start"), F.col("s.windows").alias("windows"),
                F.col("s.several").alias("several")), "segments")
    keys = (flat.groupBy("key").agg(F.sum(F.col("copies") + F.col("several").cast("long")).alias("n"), F.count("*").alias("rows"))
            .where("n > 1")
            .select("key", F.when(F.col("rows") > HOT, F.ceil(F.log10(F.col("rows") / HOT) + 1)).otherwise(0).cast("int").alias("level")))
    return (flat.join(keys, "key").groupBy("sha").agg(
        F.first("copies").alias("copies"), F.collect_list(F.struct("key", "start", "windows", "level")).alias("found")))


def cut_segments(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sha, copies, key, start, name, seg, hot) of (sha, text, copies, found)."""
    gram = min(GRAM, length)
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = buffer(batch.column("text"))
            raw = data.tobytes()
            sha, copies = batch.column("sha").to_pylist(), batch.column("copies").to_pylist()
            rows: list[tuple] = []
            for k, found in enumerate(batch.column("found").to_pylist()):
                for s in found:
                    a = int(off[k]) + s["start"]
                    seg = raw[a: a + s["windows"] + length - 1]
                    if not s["level"]:
                        rows.append((sha[k], copies[k], s["key"], s["start"], seg, False))
                        continue
                    keys = window_keys(Hasher(np.frombuffer(seg, np.uint8)).windows(gram), s["level"], width)
                    for b, n in zip(*(v.tolist() for v in runs(keys))):
                        rows.append((sha[k], copies[k], int(keys[b].astype(np.int64)), s["start"] + b, seg[b: b + n + length - 1], True))
            for at in range(0, len(rows), 2000):
                cols = list(zip(*rows[at: at + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int32()), pa.array([_name(s) for s in cols[4]], pa.binary()), pa.array(cols[4], pa.binary()),
                     pa.array(cols[5], pa.bool_())],
                    names=["sha", "copies", "key", "start", "name", "seg", "hot"])

    return texts.select("sha", "text", "copies", "found").mapInArrow(
        run, "sha binary, copies long, key long, start int, name binary, seg binary, hot boolean")


def repeated_runs(cut: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``cut`` (without ``hot``) with the hot segments reduced to runs of windows
    whose hash occurs again in hot segments, under new keys."""
    hot = cut.where("hot")
    spans = scratch.table(hot.groupBy("key", "name").agg(F.sum("copies").alias("copies"), F.first("seg").alias("seg")), "hot-segments")

    def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data, off = buffer(batch.column("seg"))
        count = np.maximum(np.diff(off) - length + 1, 0)
        return Hasher(data).windows(length)[ragged(off[:-1], count)], count

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seg"):
            h, count = hashes(batch)
            h, n = unique_counts(h, np.repeat(batch.column("copies").to_numpy(), count))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seg"):
            h, count = hashes(batch)
            row = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column("key").take(row), batch.column("name").take(row),
                 pa.array(ragged(np.zeros(len(count), np.int64), count).astype(np.int32))], names=["h", "key", "name", "at"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = np.zeros(len(r["seg"]) - length + 1, np.int64)
                hit = np.zeros(len(key), bool)
                at = [w["at"] for w in r["on"]]
                key[at], hit[at] = [w["to"] for w in r["on"]], True
                breaks = np.zeros(len(key), bool)
                breaks[1:] = hit[1:] != hit[:-1]
                for a, n in zip(*(v.tolist() for v in runs(key, breaks))):
                    if hit[a]:
                        rows.append((r["sha"], r["copies"], int(key[a]), r["start"] + a, r["seg"][a: a + n + length - 1]))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
                 pa.array([_name(x) for x in cols[4]], pa.binary()), pa.array(cols[4], pa.binary())],
                names=["sha", "copies", "key", "start", "name", "seg"])

    again = (spans.select("seg", "copies").mapInArrow(number, "h long, n long")
             .groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    on = (spans.select("seg", "key", "name").mapInArrow(windows, "h long, key long, name binary, at int").join(again, "h")
          .select("key", "name", "at", F.when(F.col("n") <= FEW, F.col("h")).otherwise(F.xxhash64("key", "n")).alias("to"))
          .groupBy("key", "name").agg(F.collect_list(F.struct("at", "to")).alias("on")))
    cut_hot = hot.join(on, ["key", "name"]).select("sha", "copies", "start", "seg", "on")
    return cut.where("not hot").drop("hot").unionByName(
        cut_hot.mapInArrow(pieces, "sha binary, copies long, key long, start int, name binary, seg binary"))


class Strings(NamedTuple):
    """The strings of one key that hold windows whose hash is not single."""

    windows: list[int]  # of each segment
    strings: list[bytes]
    copies: list[int]
    meets: list[bool]   # shares a window's hash with another string, or holds one twice
    places: list[tuple[int, int, int]]  # segment, first window, string


def resolve(segs: list[bytes], copies: list[int], length: int = LENGTH) -> Strings:
    """What of the distinct segments of one key is left to sort: windows whose
    hash is single go, and equal strings are one."""
    if len(segs) == 1 and copies[0] > 1:
        return Strings([max(len(segs[0]) - length + 1, 0)], list(segs), list(copies), [False], [(0, 0, 0)])
    off = np.concatenate([[0], np.cumsum([len(s) for s in segs])])
    count = np.maximum(np.diff(off) - length + 1, 0)
    h = Hasher(np.frombuffer(b"".join(segs), np.uint8)).windows(length)
    if len(segs) > 1:
        h = h[ragged(off[:-1], count)]
    order = np.argsort(h)
    first = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
    edges = np.concatenate([[0], np.cumsum(count)])
    weight = np.repeat(np.array(copies, np.int64), count)
    total = np.add.reduceat(weight[order], first)
    again = np.empty(len(h), bool)
    again[order] = np.repeat(total > 1, np.diff(np.append(first, len(h))))
    breaks = np.zeros(len(h) + 1, bool)
    breaks[edges] = True
    a, n = runs(again.astype(np.int8), breaks[:-1])
    keep = again[a]
    a, n = a[keep], n[keep]
    row = np.searchsorted(edges, a, "right") - 1
    strings: dict[bytes, int] = {}
    number: list[int] = []
    spans = []
    places = []
    for r, x, m in zip(row.tolist(), (a - edges[row]).tolist(), n.tolist()):
        k = strings.setdefault(segs[r][x: x + m + length - 1], len(strings))
        if k == len(number):
            number.append(0)
            spans.append((int(edges[r]) + x, m))
        number[k] += copies[r]
        places.append((r, x, k))
    meets: list[bool] = []
    if spans:
        size = np.array([m for _, m in spans])
        own = np.concatenate([h[x: x + m] for x, m in spans])
        order = np.argsort(own)
        same = own[order[1:]] == own[order[:-1]]
        shared = np.zeros(len(own), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        meets = (np.add.reduceat(shared, np.cumsum(size) - size) > 0).tolist()
    return Strings(count.tolist(), list(strings), number, meets, places)


def repeated_windows(keys: list[Strings], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For every segment of each key which of its windows are repeated. All
    strings are sorted, those of one key that share windows as one text."""
    texts = []
    for k, found in enumerate(keys):
        texts += [[(k, i)] for i, m in enumerate(found.meets) if not m]
        texts.append([(k, i) for i, m in enumerate(found.meets) if m])
    texts = [t for t in texts if t]
    names = [name for t in texts for name in t]
    hits = dict(zip(names, sorted_windows([[keys[k].strings[i] for k, i in t] for t in texts],
                                          [keys[k].copies[i] for k, i in names], length)))
    out = []
    for k, found in enumerate(keys):
        rows = [np.zeros(c, bool) for c in found.windows]
        for r, x, i in found.places:
            rows[r][x: x + len(hits[k, i])] = hits[k, i]
        out.append(rows)
    return out


def sorted_windows(texts: list[list[bytes]], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Which windows of each string start more than once in the strings of its
    text (all with their numbers of copies): windows are equal where
    neighbours in the text's suffix array agree on ``length`` bytes."""
    strings = [s for t in texts for s in t]
    if not strings:
        return []
    size = np.array([len(s) + 1 for s in strings])
    stop = np.cumsum(size) - 1
    raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    chars = raw.astype(np.uint16) + np.uint16(1)
    chars[stop] = 0
    off = np.append(0, stop + 1)[np.append(0, np.cumsum([len(t) for t in texts]))]
    at = suffix_arrays(chars, off) + np.repeat(off[:-1], np.diff(off))
    owner = np.repeat(np.arange(len(strings)), size)
    at = at[at + length <= stop[owner[at]]]
    text = np.repeat(np.arange(len(texts)), np.diff(off))[at]
    new = np.ones(len(at), bool)
    h = Hasher(raw).windows(length)[at] if len(at) else np.zeros(0, U)  # unequal hashes: unequal windows
    maybe = np.flatnonzero((text[1:] == text[:-1]) & (h[1:] == h[:-1]))
    views = np.lib.stride_tricks.sliding_window_view(raw, length) if len(at) else raw
    for low in range(0, len(maybe), 2000):
        some = maybe[low: low + 2000]
        new[some + 1] = (views[at[some]] != views[at[some + 1]]).any(1)
    first = np.flatnonzero(new)
    several = np.zeros(len(raw), bool)
    if len(first):
        number = np.add.reduceat(np.array(copies, np.int64)[owner[at]], first)
        several[at] = np.repeat(number > 1, np.diff(np.append(first, len(at))))
    return [several[b + 1 - n: max(b - length + 1, b + 1 - n)] for b, n in zip(stop.tolist(), size.tolist())]


def _name(seg: bytes) -> bytes:
    return hashlib.blake2b(seg, digest_size=16).digest()


def repeated_ranges(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, name, ranges): byte ranges of repeated windows in each distinct
    segment that has any."""
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # keys whose strings are sorted side by side

        def flush():
            rows = []
            for (key, segs, _), hits in zip(waiting, repeated_windows([w[2] for w in waiting], length)):
                for seg, hit in zip(segs, hits):
                    a, n = runs(hit.view(np.int8))
                    on = hit[a]
                    if on.any():
                        rows.append((key, _name(seg), [{"a": x, "b": x + m + length - 1} for x, m in zip(a[on].tolist(), n[on].tolist())]))
            waiting.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], spans)],
                                              names=["key", "name", "ranges"])

        def close(key, segs, copies):
            waiting.append((key, segs, resolve(segs, copies, length)))
            return sum(len(s) for s in waiting[-1][2].strings)

        held, segs, copies, size = None, [], [], 0
        for batch in batches:
            for key, seg, n in zip(batch.column("key").to_pylist(), batch.column("seg").to_pylist(), batch.column("copies").to_pylist()):
                if key != held:
                    if segs:
                        size += close(held, segs, copies)
                    held, segs, copies = key, [], []
                    if size > SORT_BYTES:
                        yield flush()
                        size = 0
                segs.append(seg)
                copies.append(n)
        if segs:
            close(held, segs, copies)
        yield flush()

    return (segments.groupBy("key", "seg").agg(F.sum("copies").alias("copies"))
            .repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "key long, name binary, ranges array<struct<a:int,b:int>>"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """(sha, n_removed, n_spans, kept) of (sha, text, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = buffer(batch.column("text"))
            out = []
            for k, found in enumerate(batch.column("ranges").to_pylist()):
                raw = data[off[k]: off[k + 1]]
                edge = np.zeros(len(raw) + 1, np.int32)
                for r in found:
                    edge[r["a"]] += 1
                    edge[r["b"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), spans, raw[~gone].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                names=["sha", "n_removed", "n_spans", "kept"])

    return texts.select("sha", "text", "ranges").mapInArrow(run, "sha binary, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans for every row of ``docs``, and the
    remaining bytes as ``kept`` (null where nothing is removed), or with
    ``digest`` their hash as ``kept_sha256``."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    segmented = scratch.table(segment(rows, length), "segmented")
    found = shared_segments(segmented, scratch)
    texts = scratch.table(rows.select("sha", "text").join(found, "sha").dropDuplicates(["sha"]), "candidates")
    scratch.drop("segments")
    cut = scratch.table(cut_segments(texts, length), "all-cut")
    cut = scratch.table(repeated_runs(cut, length, scratch), "cut")
    scratch.drop("all-cut", "hot-segments")
    ranges = scratch.table(repeated_ranges(cut, length), "ranges")
    placed = (cut.select("sha", "key", "name", "start").join(ranges, ["key", "name"])
              .select("sha", F.explode("ranges").alias("r"), "start")
              .select("sha", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).alias("r"))
              .groupBy("sha").agg(F.collect_list("r").alias("ranges")))
    done = cut_texts(texts.select("sha", "text").join(placed, "sha"))
    if digest:
        done = done.withColumn("kept", F.unhex(F.sha2("kept", 256)))
    done = scratch.table(done, "cut-texts")
    scratch.drop("candidates", "cut", "ranges")
    out = segmented.select("doc_id", "sha", "n_bytes").join(done, "sha", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        *([F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256")] if digest else ["kept"]))
    return out
