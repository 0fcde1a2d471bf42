"""Best-fit packing with Martello-Toth dominance reduction (operator 4).

Documents are tokenised inside tasks, end with id 0 and are cut into pieces
of at most ``capacity`` tokens. How pieces are put together depends on their
lengths alone, so the packing is solved on the histogram of lengths, which has
at most ``capacity`` rows whatever the input is: that is the only thing the
driver sees. The solution is a list of (length, ranks) -> (sequences, offset)
intervals, also bounded by the histogram, and every piece finds its place by
its rank among the pieces of its length.

Reduction (Martello and Toth): for the longest open length j, with the pieces
that still fit beside it,
 - nothing fits: j is a sequence of its own;
 - one piece fills it exactly: the pair dominates every other set with j;
 - at most one piece fits beside j: the longest that fits dominates;
 - at most two fit: the longest single dominates if it is at least as long as
   the best pair.
Such sets are fixed for good; what no rule decides goes to best-fit
decreasing. Both work on counts, so a million equal pieces are one step.

Null text counts as empty and gives one piece with the id 0. Whole texts are
tokenised, equal rows are packed as separate pieces, an empty table gives an
empty result, columns beside id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import Scratch, to_arrays
from strata.llm.textops import ragged, slices

CAPACITY = 2048
END = 0
SLICE_BYTES = 6 << 20  # of text at once: larger slices repeat more chunks


class WordTokens:
    """Token ids of whole texts through a tokenizer that lower-cases and never
    looks across white space or from a letter or digit to a symbol: every
    distinct chunk is encoded once. The memo is emptied at ``limit`` chunks,
    so a task's memory stays bounded."""

    # a word's closing marks become a chunk of their own
    MARKS = (r"([A-Za-z0-9])([.,;:!?#$%&*]+)(\s|$)", r"\1 \2\3")

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, chunks: pa.Array) -> None:
        parts, lengths = [self.ids], [self.lengths]
        for at in range(0, len(chunks), 8192):
            found = [e.ids for e in self.encode(chunks.slice(at, 8192).to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        self.ids, self.lengths = np.concatenate(parts), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = pa.concat_arrays([self.known, chunks])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.known) > self.limit:
            self.clear()
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.fill_null(""), *self.MARKS))
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary
        # ASCII chunks are looked up in lower case ('<' may begin a special token, whose case counts)
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        place = pc.index_in(words, self.known)
        if place.null_count:
            new, base = words.filter(place.is_null()).unique(), len(self.known)
            self.learn(new)
            place = pc.coalesce(place, pc.add(pc.index_in(words, new), pa.scalar(base, pa.int32())))
        place = place.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
        lengths = self.lengths[place]
        ids = self.ids[ragged(self.starts[place], lengths)]
        offsets = chunks.offsets.to_numpy().astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[offsets - offsets[0]])


def worker_tokens(path: str) -> WordTokens:
    """The tokenizer and memo of this Python worker: Spark gives a worker one
    task after another, and each goes on with what the ones before have learned."""
    tokens = sys.modules.setdefault("_strata_worker", ModuleType("_strata_worker")).__dict__.setdefault("tokens", {})
    if path not in tokens:
        tokens[path] = WordTokens(path)
    return tokens[path]


# what WordTokens takes for granted of a tokenizer (fixed values)
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True}


def check_tokenizer(path: str) -> None:
    """Refuse tokenizers whose ids of a text are not those of its chunks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    same = ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0] == SPLIT and len(steps) == 2
            and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and all(t["content"].startswith("<") and not any(t[k] for k in ("single_word", "lstrip", "rstrip")) for t in spec["added_tokens"]))
    if not same:
        raise ValueError(f"{path}: pack needs a lower-casing tokenizer that splits at white space, words, digits and symbols")


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, _task long, _nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, numbered within their task and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, n = tokens(batch.column("text"))
            ends = np.cumsum(n)
            count = n // capacity + 1  # with the end id, ceil((n + 1) / capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[row] + 1 - start)
            crc = np.empty(len(row), np.int64)
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                a = int(ends[r] - n[r]) + s
                last = s + m == n[r] + 1
                c = zlib.crc32(ids[a: a + m - last].astype("<u4").tobytes())
                crc[k] = zlib.crc32(np.array([END], "<u4").tobytes(), c) if last else c
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.searchsorted(by, by, "left")
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - first
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc), pa.array(np.full(len(row), task, np.int64)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, PIECES.format(id=narrow.schema["doc_id"].dataType.simpleString()))


class Plan:
    """Sequences built from a histogram of lengths: groups of equal patterns."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.groups: list[tuple[tuple[tuple[int, int], ...], int]] = []  # ((length, copies), ...), sequences
        self.reduce()
        self.best_fit()

    def fix(self, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        for length, copies in pattern:
            self.left[length] -= copies * times
        self.groups.append((pattern, times))

    def longest(self, limit: int) -> int:
        """The longest open length up to ``limit``, 0 if none."""
        at = np.flatnonzero(self.left[1: limit + 1]) if limit > 0 else ()
        return int(at[-1]) + 1 if len(at) else 0

    def smallest(self, but: int, n: int) -> list[int]:
        """The n shortest open pieces beside one of length ``but``."""
        out: list[int] = []
        for length in np.flatnonzero(self.left)[: n + 1].tolist():
            out += [length] * min(n, int(self.left[length]) - (length == but))
        return out[:n]

    def best_pair(self, j: int, room: int) -> int:
        """The largest sum up to ``room`` of two open pieces beside one of length j."""
        have = self.left.copy()
        have[j] -= 1
        open_ = np.flatnonzero(have[: room + 1])
        if not len(open_):
            return 0
        at = np.searchsorted(open_, room - open_, "right") - 1
        ok = at >= 0
        a, b = open_[ok], open_[at[ok]]
        twice = (a == b) & (have[a] < 2)
        down = at[ok] - 1
        sums = np.where(twice, np.where(down >= 0, a + open_[np.maximum(down, 0)], 0), a + b)
        return int(sums.max()) if len(sums) else 0

    def reduce(self) -> None:
        skipped = self.capacity + 1
        while j := self.longest(skipped - 1):
            n, room = int(self.left[j]), self.capacity - j
            small = self.smallest(j, 3)
            fits = int(np.searchsorted(np.cumsum(small), room, "right"))
            if fits == 0:
                self.fix(((j, 1),), n)
                continue
            self.left[j] -= 1
            partner = self.longest(room)
            self.left[j] += 1
            exact = partner == room
            dominated = fits == 1 or (fits == 2 and partner >= self.best_pair(j, room))
            if not (exact or dominated):
                skipped = j
                continue
            if partner == j:
                self.fix(((j, 2),), n // 2)
                continue
            # an exact pair stays best for all of them; the other rules are looked at again
            # when the shortest pieces or the best pair may have changed
            times = min(n, int(self.left[partner])) if exact or fits == 1 else 1
            self.fix(((j, 1), (partner, 1)), times)

    def best_fit(self) -> None:
        """Best-fit decreasing over what is left, on counts."""
        rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        sizes = np.zeros(self.capacity + 1, np.int64)  # sequences by room left

        def put(pattern, times, room):
            if times:
                rooms.setdefault(room, []).append((pattern, times))
                sizes[room] += times

        for j in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[j])
            while n:
                open_ = np.flatnonzero(sizes[j:])
                if len(open_):
                    room = j + int(open_[0])
                    pattern, times = rooms[room].pop()
                else:
                    room, pattern, times = self.capacity, (), n
                    sizes[room] += n
                copies = room // j  # best fit goes on with the same sequence
                whole = min(times, n // copies)
                if whole:
                    put((*pattern, (j, copies)), whole, room - copies * j)
                elif n:
                    copies, whole = n, 1
                    put((*pattern, (j, copies)), 1, room - copies * j)
                n -= copies * whole
                sizes[room] -= times
                if pattern:
                    put(pattern, times - whole, room)
            self.left[j] = 0
        for found in rooms.values():
            self.groups += found

    def intervals(self) -> dict[str, np.ndarray]:
        """For each length, ranks from ``rank`` on: copies per sequence, first
        sequence and offset of the first copy."""
        used = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for pattern, times in self.groups:
            offset = 0
            for length, copies in pattern:
                rows.append((length, used[length], copies, sequence, offset))
                used[length] += copies * times
                offset += length * copies
            sequence += times
        table = np.array(rows, np.int64).reshape(-1, 5)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    check_tokenizer(tokenizer_path)
    spark = docs.sparkSession
    cut = Scratch(spark).table(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    per_task = cut.groupBy("length", "_task").agg(F.count("*").alias("_rows"))
    histogram = to_arrays(per_task.groupBy("length").agg(F.sum("_rows").alias("n")))  # at most `capacity` rows
    plan = Plan(dict(zip(histogram["length"].tolist(), histogram["n"].tolist())), capacity)
    place = spark.sparkContext.broadcast(plan.intervals())
    ahead = per_task.withColumn(
        "_ahead", F.sum("_rows").over(W.partitionBy("length").orderBy("_task")) - F.col("_rows")).drop("_rows")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        key = p["length"] << 40 | p["rank"] if len(p["length"]) else np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            k, copies = rank - p["rank"][at], p["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(p["sequence"][at] + k // copies), pa.array(p["offset"][at] + k % copies * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(ahead, ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_ahead") + F.col("_nth")).alias("_rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(put, f"{schema}, sequence_id long, offset long")
