"""Operator 1 against plain Python: base features, Kneser-Ney, both scoring ways."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from strata.llm.quality_rules import ORDER, base_features, judge, keep_good
from strata.llm.textops import buffer, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i: i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_base_features(sample, edge):
    for df in (sample, edge):
        texts = [r.text for r in df.select("text").collect()]
        got = []
        for b in slices([pa.record_batch([pa.array(texts, pa.string())], ["text"])], "text", 20_000):
            got += list(zip(*[v.tolist() for v in base_features(*buffer(b.column(0))).values()]))
        assert got == [plain_features(t) for t in texts]


def plain_model(texts):
    """p(byte | up to 4 bytes before) by the recursive definition."""
    counts = {ORDER: Counter()}
    for t in texts:
        b = b"\n" * (ORDER - 1) + t.encode()
        counts[ORDER].update(b[i: i + ORDER] for i in range(len(b) - ORDER + 1))
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p = {}
    for n in range(1, ORDER + 1):
        c = counts[n]
        k = [None] + [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = k[1] / (k[1] + 2 * k[2])
        d = [0] + [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, held = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            held[g[:-1]] += d[min(v, 3)]
        for g, v in c.items():
            low = p[g[1:]] if n > 1 else 1 / 256
            p[g] = (v - d[min(v, 3)] + held[g[:-1]] * low) / total[g[:-1]]
    return p


def test_perplexity_both_ways(sample):
    rows = sample.collect()
    want = {}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        p = plain_model([r.text for r in mine])
        for r in mine:
            b = b"\n" * (ORDER - 1) + r.text.encode()
            bits = -sum(math.log2(p[b[i: i + ORDER]]) for i in range(len(b) - ORDER + 1))
            want[r.doc_id] = bits / len(WORD.findall(r.text))
    for limit in (10**9, 0):
        got = {r.row.doc_id: r for r in judge(sample, ["doc_id"], max_rows=limit).collect()}
        assert len(got) == len(rows)
        for k, v in want.items():
            assert abs(got[k].bits - v) < 1e-3
        for r in rows:
            g, f = got[r.doc_id], plain_features(r.text)
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == f
            assert g.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0])
            assert g.kept == (not g.base_failed and g.low <= g.bits <= g.high)


def test_separates_labelled_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = judge(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect()
    good = [r.kept for r in rows if labels.get(r.row.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.row.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4


def test_edges(edge, docs_of):
    out = keep_good(edge)
    assert out.columns == edge.columns and {r.doc_id for r in out.collect()} <= {5, 8}
    assert judge(edge).count() == edge.count()
    assert judge(docs_of([])).collect() == []
