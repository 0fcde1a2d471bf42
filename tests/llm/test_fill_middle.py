"""Operator 11 against plain slicing, with edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm.fill_middle import Forest, fill_in_middle, restored

UNITS = {"char": re.compile(".", re.S), "word": re.compile(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")}


def plain_fim(doc_id, text, unit="char"):
    text = text or ""
    units = UNITS[unit].findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("unit,block", [("char", 512), ("char", 3), ("word", 512), ("word", 5)])
def test_matches_plain_slices(edge, sample, docs_of, unit, block):
    odd = docs_of([(i, t) for i, t in enumerate(
        ["a<P>b", "<S>", "x<M>", "<", "<P", "ab<", "<P<S", "é" * 2000, "\U0001f600" * 700 + "a", "  a  b\n\n", "\n", "a\x00b"] * 12)])
    for df in (edge, sample, odd):
        got = fill_in_middle(df, unit=unit, block=block)
        want = [plain_fim(r.doc_id, r.text, unit) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
        texts = df.select("doc_id", F.coalesce("text", F.lit("")))
        assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, texts.collect()), key=key)


def test_every_form_occurs(sample):
    forms = {r.form for r in fill_in_middle(sample).select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table(docs_of):
    assert fill_in_middle(docs_of([])).collect() == []


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError, match="unit"):
        Forest(np.zeros(1, np.uint8), np.array([0, 1]), "syllable")


def test_tree_nodes_hold_their_blocks_and_every_cut_is_found():
    texts = ["", "añb" * 50, "x", "\U0001f600é" * 333, "a" * 64]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    forest = Forest(data, off, "char", 8)
    assert forest.count.tolist() == [len(t) for t in texts]
    for d, r in enumerate(raw):
        starts = [sum((x & 0xC0) != 0x80 for x in r[8 * b: 8 * b + 8]) for b in range(int(forest.size[d]))]
        for node in range(1, len(starts) + 1):
            assert forest.tree[0][forest.root[d] + node - 1] == sum(starts[node - (node & -node): node])
        for k in range(len(texts[d]) + 1):
            byte, points = forest.cut(np.array([d]), np.array([k]))
            assert (byte[0] - off[d], points[0]) == (len(texts[d][:k].encode()), k)
