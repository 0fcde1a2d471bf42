"""Fill-in-the-middle transformation with cuts found in a Fenwick tree (operator 11).

A text is cut at two units into prefix, middle and suffix, which are put
together again in another order. A unit is a code point or, with
``unit="word"``, a run of words' or of spaces' characters; units are lossless,
so that the three parts joined are the text.

The text is looked at in fixed blocks of ``BLOCK`` UTF-8 bytes. A Fenwick tree
over the blocks of a document holds, in each node, the number of units and of
code points that begin in the blocks below it. A cut after ``k`` units descends
the tree by binary lifting, which finds the block where unit ``k`` begins and
how many units and code points begin before that block; the boundary is then
located inside the one block. Trees and descents of all documents of an Arrow
slice are worked out together. Nothing is shuffled; a task holds one slice
(about 2 MB of text, or one longer text).

Null text is empty, a null id counts as ''. Empty texts, and texts that contain
a sentinel, stay plain. Rows that repeat an id are cut alike for their lengths.
An empty table gives an empty one; columns of ``docs`` beside id and text are
not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import textops

BLOCK = 512          # bytes
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 90     # of the documents are transformed
SPM_PERCENT = 20     # of those, with the suffix first


def draws(doc_id: Column, salt: str = "1") -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of ``salt:id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def unit_starts(data: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the bytes: a unit begins here, a code point begins here."""
    points = (data & 0xC0) != 0x80
    if unit == "char":
        return points, points
    if unit != "word":
        raise ValueError(f"unit {unit!r}: 'char' or 'word'")
    space = textops.IS_SPACE[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = space[1:] != space[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    starts[begins] = True
    return starts, points


class Forest:
    """Fenwick trees, one for the blocks of each document of a slice."""

    def __init__(self, data: np.ndarray, off: np.ndarray, unit: str, block: int = BLOCK):
        self.off, self.block = off, block
        self.units, self.points = unit_starts(data, off, unit)
        length = np.diff(off)
        self.size = -(-length // block)                      # blocks of each document
        self.root = np.concatenate(([0], np.cumsum(self.size)))
        total = int(self.root[-1])
        local = np.arange(total) - np.repeat(self.root[:-1], self.size)
        begin = np.repeat(off[:-1], self.size) + local * block
        # node i of a tree is its i-th block, from 1
        self.tree = np.zeros((2, total), np.int64)
        if total:
            self.tree[0] = np.add.reduceat(self.units, begin, dtype=np.int64)
            self.tree[1] = np.add.reduceat(self.points, begin, dtype=np.int64)
        node, last = local + 1, np.repeat(self.size, self.size)
        step = 1
        while step <= (int(self.size.max()) if len(self.size) else 0):
            # every node of this level adds itself to its parent, each to another one
            child = np.flatnonzero((node & -node == step) & (node + step <= last))
            self.tree[:, child + step] += self.tree[:, child]
            step <<= 1
        self.count = self.descend(np.arange(len(length)), np.full(len(length), np.iinfo(np.int64).max))[1]

    def descend(self, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, units before it, code points before it): the last block of
        each ``doc`` with no more than ``k`` units in front of it."""
        at = np.zeros(len(doc), np.int64)
        units, points = at.copy(), at.copy()
        size, root = self.size[doc], self.root[doc]
        step = 1 << int(self.size.max(initial=0)).bit_length()
        while step and len(self.tree[0]):
            node = at + step
            ok = np.flatnonzero(node <= size)
            here = root[ok] + node[ok] - 1
            go = self.tree[0][here] <= k[ok] - units[ok]
            ok, here = ok[go], here[go]
            at[ok] = node[ok]
            units[ok] += self.tree[0][here]
            points[ok] += self.tree[1][here]
            step >>= 1
        return at, units, points

    def cut(self, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte offset in the slice, code points before it) of the boundary
        after the first ``k`` units of each ``doc``."""
        at, units, points = self.descend(doc, k)
        begin = self.off[doc] + at * self.block
        byte = np.minimum(begin, self.off[doc + 1])
        inside = np.flatnonzero(at < self.size[doc])         # the others end at the text's end
        if len(inside):
            span = np.minimum(self.block, self.off[doc[inside] + 1] - begin[inside])
            places = textops.ragged(begin[inside], span)
            first = np.concatenate(([0], np.cumsum(span)[:-1]))
            rank = np.cumsum(self.units[places])
            rank -= np.repeat(rank[first] - self.units[places[first]], span)
            # the place in the block where unit k begins: the first with k + 1 - units begun
            found = self.units[places] & (rank == np.repeat(k[inside] - units[inside] + 1, span))
            hit = np.flatnonzero(found)
            byte[inside] = places[hit]
            chars = np.concatenate(([0], np.cumsum(self.points[places])))
            points[inside] += chars[hit] - chars[first]
        return byte, points


def _transform(batches, unit: str, block: int):
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    pre, suf, mid = sentinels
    for part in textops.slices(batches, "text"):
        data, off = textops.buffer(part.column("text"))
        n_rows = part.num_rows
        draw = [part.column(f"h{i}").to_numpy() for i in range(1, 5)]
        forest = Forest(data, off, unit, block)
        n = forest.count
        everyone = np.arange(n_rows)
        one, two = draw[0] % (n + 1), draw[1] % (n + 1)
        a, a_points = forest.cut(everyone, np.minimum(one, two))
        b, b_points = forest.cut(everyone, np.maximum(one, two))
        raw = data.tobytes()
        forms, outputs, plain = [], [], np.zeros(n_rows, bool)
        for i in range(n_rows):
            text = raw[off[i]: off[i + 1]]
            if draw[2][i] % 100 >= FIM_PERCENT or not text or any(s in text for s in sentinels):
                plain[i] = True
                forms.append("plain")
                outputs.append(text)
                continue
            x, y = a[i] - off[i], b[i] - off[i]
            if draw[3][i] % 100 < SPM_PERCENT:
                forms.append("spm")
                outputs.append(b"".join((suf, text[y:], pre, text[:x], mid, text[x:y])))
            else:
                forms.append("psm")
                outputs.append(b"".join((pre, text[:x], suf, text[y:], mid, text[x:y])))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n), pa.array(forms),
             pa.array(a_points, mask=plain), pa.array(b_points - a_points, mask=plain),
             pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char",
                   salt: str = "1", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form ('plain', 'psm' or
    'spm'), prefix_chars, middle_chars (code points, null if plain) and output
    (the transformed text)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col(id_col), salt))])
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return rows.mapInArrow(lambda batches: _transform(batches, unit, block), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        rest = F.substring_index(body, second, -1)
        return F.substring_index(body, second, 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_, middle_, suffix_))
            .otherwise(output))
