"""Operator 4 against direct encoding and exhaustive packing."""

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strata.llm.packing import Plan, pack


def expected_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, path, capacity):
    tok = Tokenizer.from_file(path)
    want = []
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at: at + capacity]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_matches_direct_encoding(sample, word_bpe, capacity):
    rows = pack(sample, word_bpe, capacity).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in sample.collect()], word_bpe, capacity)
    assert n <= -(-total // capacity) + 1


def test_edges(edge, word_bpe):
    check(pack(edge, word_bpe).collect(), [(r.doc_id, r.text) for r in edge.collect()], word_bpe, 2048)


def test_empty_table(docs_of, word_bpe):
    assert pack(docs_of([]), word_bpe).collect() == []


def fewest(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1:])
        place(k + 1, bins + [items[k]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(5)
    worse = 0
    for _ in range(150):
        items = sorted(rng.integers(1, 20, rng.integers(1, 10)).tolist(), reverse=True)
        plan = Plan({k: len(list(g)) for k, g in itertools.groupby(items)}, 20)
        packed = sorted((x for p, t in plan.groups for x, c in p for _ in range(c * t)), reverse=True)
        assert packed == items
        assert all(sum(x * c for x, c in p) <= 20 for p, _ in plan.groups)
        worse += sum(t for _, t in plan.groups) - fewest(items, 20)
    assert worse <= 2  # best-fit decreasing may lose one now and then


def test_other_tokenizers_are_refused(sample):
    import public_tokenizers
    from strata.llm.packing import check_tokenizer
    check_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    import os
    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    others = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(".json") and n != "word_bpe_49k.json"]
    assert others
    for path in others:
        with pytest.raises(ValueError, match="pack needs"):
            pack(sample, path)


def test_the_memo_outlives_a_task_and_stays_bounded(word_bpe):
    import pyarrow as pa
    from strata.llm.packing import WordTokens, worker_tokens
    tokens = worker_tokens(word_bpe)
    assert worker_tokens(word_bpe) is tokens
    small = WordTokens(word_bpe, limit=50)
    rng = np.random.default_rng(0)
    for _ in range(20):
        texts = [" ".join(f"w{x}.x{x % 7}," for x in rng.integers(0, 500, 40)) for _ in range(3)]
        ids, n = small(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in expected_ids(word_bpe, t)[:-1]]
        assert len(small.known) <= 50 + 120 * 2
