"""Operator 3 against a table of all windows; the suffix sorter against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strata.llm import gsaca
from strata.llm import suffix_dedup as S
from strata.llm.gsaca import suffix_array, suffix_arrays


def test_suffix_array_matches_sorting():
    rng = random.Random(4)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in (b"a" * 3000, b"ab" * 1500, b"abcab" * 400):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def expected(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i: i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def check(df, rows, length):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, length=length, digest=True).collect()]
    want = [(d, *e) for (d, _), e in zip(rows, expected([t for _, t in rows], length))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def corpus(length):
    """Passages at, under and over the length, in many places; edits; periodic text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(length // 2)[:n] for n in (length - 1, length, length + 1, 2 * length)]
    rows = [(k, prose(rng.randint(1, length)) + rng.choice(passages) + prose(rng.randint(0, length))) for k in range(40)]
    base = prose(length * 2)
    for k in range(40, 60):
        at = rng.randrange(len(base))
        rows.append((k, base[:at] + "#" + base[at + 1:]))
    rows += [(60, "ab" * length), (61, "x" * (3 * length)), (62, "abc" * length + prose(length)), (63, None), (64, ""), (65, rows[0][1]), (65, rows[0][1])]
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_matches_all_windows(docs_of, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "GRAM", 8)
    monkeypatch.setattr(S, "LONGEST", 100)
    rows = corpus(40)
    check(docs_of(rows), rows, 40)


def test_sample_and_edges(sample, edge, docs_of):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = check(sample, rows, 400)
    assert sum(g[2] for g in got) > 0
    check(edge, [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], 400)
    assert S.remove_repeats(docs_of([])).collect() == []
    kept = {r.doc_id: r.kept for r in S.remove_repeats(edge).collect()}
    assert kept[9] == b"" and kept[4] is None


@pytest.mark.parametrize("few", [1000, 20])
def test_hot_passage_between_different_texts_is_one_string(docs_of, monkeypatch, few):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "FEW", few, raising=False)
    monkeypatch.setattr(S, "GRAM", 8)
    whole = S.resolve

    def limited(segs, copies, length):
        assert len(segs) <= 5, "a hot group holds a segment for every text"
        return whole(segs, copies, length)

    monkeypatch.setattr(S, "resolve", limited)
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(60)
    rows = [(k, prose(50) + passage + prose(50)) for k in range(40)]
    got = check(docs_of(rows), rows, 40)
    assert all(g[2] >= 60 for g in got)


@pytest.mark.parametrize("cost", [0, 20])
def test_texts_side_by_side_are_sorted_as_alone(monkeypatch, cost):
    monkeypatch.setattr(gsaca, "STEP_COST", cost)
    rng = random.Random(8)
    for _ in range(25):
        texts = [[rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, rng.choice([5, 60, 150])))] for _ in range(rng.randint(0, 40))]
        texts += [[1] * rng.randint(0, 50), [0, 1] * rng.randint(0, 50), [0, 1, 2, 0, 1] * 20]
        rng.shuffle(texts)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = suffix_arrays(np.array([c for t in texts for c in t], np.uint16), off).tolist()
        assert got == [x for t in texts for x in suffix_array(t)]


def test_all_strings_of_many_keys_are_sorted_side_by_side(monkeypatch):
    """Copies of whole passages, too, are found in suffix arrays, and keys do not sort one by one."""
    alone, together = [], []
    one, many = gsaca.suffix_array, gsaca._side_by_side
    monkeypatch.setattr(gsaca, "suffix_array", lambda text: alone.append(len(text)) or one(text))
    monkeypatch.setattr(gsaca, "_side_by_side", lambda chars, size: together.append(len(size)) or many(chars, size))
    rng = random.Random(12)
    prose = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    keys, want = [], []
    for k in range(300):
        a, b, c = prose(60), prose(20), prose(60)
        segs, copies = [([a], [2]), ([prose(30) + a, a + prose(30)], [1, 1]), ([a + b, b + c, b], [1, 1, 1])][k % 3]
        keys.append(S.resolve(segs, copies, 20))
        seen = Counter(s[i: i + 20] for s, n in zip(segs, copies) for _ in range(n) for i in range(len(s) - 19))
        want.append([[seen[s[i: i + 20]] > 1 for i in range(len(s) - 19)] for s in segs])
    got = S.repeated_windows(keys, 20)
    assert [[hit.tolist() for hit in hits] for hits in got] == want
    assert len(alone) < 10 and len(alone) + sum(together) >= 300 and len(together) == 1
