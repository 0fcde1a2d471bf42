"""Operator 2 against a plain trie with explicit exclusion sets."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strata.llm.ppm import ORDER, ppm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def expected(rows):
    trie, counts = defaultdict(Counter), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            w = tokens(text)
            counts.update([*w, None])
            b = b"\n" * ORDER + (" ".join(w) + "\n").encode()
            for i in range(ORDER, len(b)):
                for k in range(ORDER + 1):
                    trie[b[i - k: i]][b[i]] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        w = tokens(text)
        b = b"\n" * ORDER + (" ".join(w) + "\n").encode()
        score = 0.0
        for i in range(ORDER, len(b)):
            excluded = set()
            for k in range(ORDER, -1, -1):
                node = trie.get(b[i - k: i])
                if not node:
                    continue
                left = {s: c for s, c in node.items() if s not in excluded}
                if left:
                    total = sum(left.values()) + len(left)
                    if b[i] in left:
                        score += math.log10(left[b[i]] / total)
                        break
                    score += math.log10(len(left) / total)
                excluded |= set(node)
            else:
                score += math.log10(1 / (256 - len(excluded)))
        out.append((doc_id, held(doc_id), len(w) + 1, sum(x in counts for x in [*w, None]), n,
                    sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), score))
    return out


def same(df, rows, **options):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(map(tuple, ppm_scores(df, **options).collect()), key=key), sorted(expected(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6, rel=1e-9) and g[6] == pytest.approx(w[6], abs=1e-3, rel=1e-5)
    return got


@pytest.mark.parametrize("limit", [10**9, 0])
def test_matches_plain_trie(sample, limit):
    df = sample.where("doc_id < 60")
    same(df, [(r.doc_id, r.text) for r in df.collect()], max_rows=limit)


def test_edges(edge, docs_of):
    for limit in (10**9, 0):
        same(edge, [(r.doc_id, r.text) for r in edge.collect()], max_rows=limit)
    assert ppm_scores(docs_of([])).collect() == []
    only = [(k, "Some text here") for k in range(40) if held(k)]
    same(docs_of(only), only)  # no training rows at all
