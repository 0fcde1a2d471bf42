"""Operators 7 and 10 against plain Python versions of the whole score: token
odds, lexicon, segments, extreme-value law and curve; dictionary sample,
compressed-size difference and curve."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from strata.llm import compression_quality as Q
from strata.llm import toxicity as T

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def units(text):
    """(token, stem) of every token, A-Z lowered."""
    out = []
    for m in TOKEN.finditer((text or "").encode()):
        token = m[0].lower().decode()
        out.append((("token", token), ("stem", token[:4])))
    return out


def plain_curve(pairs):
    """Logistic curve through (x, label) by gradient steps with halving."""
    if not pairs or len({y for _, y in pairs}) < 2:
        p, n = sum(y for _, y in pairs), len(pairs)
        return lambda x: (p + 0.5) / (n + 1)
    x, y = np.array([a for a, _ in pairs], float), np.array([b for _, b in pairs], float)
    mean, spread = x.mean(), x.std() or 1.0
    z = (x - mean) / spread

    def cost(a, b):
        t = a * z + b
        return (np.logaddexp(0, t) - y * t).sum() + 1e-3 * len(y) * a * a / 2

    a, b, step = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 1.0
    for _ in range(20000):
        q = 1 / (1 + np.exp(-(a * z + b)))
        ga, gb = ((q - y) * z).mean() + 1e-3 * a, (q - y).mean()
        if max(abs(ga), abs(gb)) < 1e-9:
            break
        while cost(a - step * ga, b - step * gb) > cost(a, b) and step > 1e-6:
            step /= 2
        a, b, step = a - step * ga, b - step * gb, step * 1.5
    assert a > 0
    return lambda v: 1 / (1 + math.exp(-(a * (v - mean) / spread + b)))


def best_segment(values):
    """(score, first, last) of the best stretch, the shortest of equals."""
    best, total, start = (0.0, 0, -1), 0.0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, k
        total += v
        if total > best[0] + 1e-12:
            best = (total, start, k)
    return best


def maximal_segments(values, base=0):
    """The best stretch, then the same left and right of it."""
    score, a, b = best_segment(values)
    if b < a:
        return []
    return maximal_segments(values[:a], base) + [(base + a, base + b, score)] + maximal_segments(values[b + 1:], base + b + 1)


def plain_toxicity(rows, marks):
    """-ln P and score of every (doc_id, text); ``marks``: label by id."""
    once = {}
    for doc_id, text in rows:
        if fold(doc_id) in (1, 2, 3) and doc_id in marks:
            once.setdefault((text or "", marks[doc_id]), doc_id)
    n_docs = {0: Counter(), 1: Counter()}
    for text, label in once:
        n_docs[label].update({u for pair in units(text) for u in pair})
    n1, n0 = sum(n_docs[1].values()), sum(n_docs[0].values())
    weight, share = {}, {}
    for u in set(n_docs[0]) | set(n_docs[1]):
        t, o = n_docs[1][u], n_docs[0][u]
        prior = T.EACH + T.PRIOR * (t + o) / (n1 + n0)
        a, b = t + prior, o + prior
        ratio = math.log(a / (n1 + T.PRIOR + T.EACH)) - math.log(b / (n0 + T.PRIOR + T.EACH))
        error = T.Z * math.sqrt(1 / a + 1 / b)
        if t >= T.LEAST and ratio - error > T.DRAG:
            weight[u] = ratio - error
        elif o >= T.LEAST and ratio + error < -T.DRAG:
            weight[u] = ratio + error
        if u in weight:
            share[u] = b / (n0 + T.PRIOR)
    rest = max(1 - sum(share.values()), 1e-9)

    def excess(lam):
        return sum(p * math.exp(min(lam * weight[u], 700)) for u, p in share.items()) + rest * math.exp(-lam * T.DRAG) - 1

    low, high = 1e-3, 50.0
    while high - low > 1e-13:
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    found = []
    for _, text in rows:
        values = [max((weight[u] for u in pair if u in weight), default=-T.DRAG) for pair in units(text)]
        found.append((len(values), [s for _, _, s in maximal_segments(values)]))
    judged = [(f, marks[d]) for f, (d, _) in zip(found, rows) if fold(d) == 4 and d in marks]
    tails = [(n + 1) * math.exp(-low * max(s, default=0.0)) for (n, s), label in judged if label == 0]
    k = len(tails) / sum(tails)

    def surprise(n, scores):
        x = k * (n + 1) * math.exp(-low * max(scores, default=0.0))
        best = -math.log(-math.expm1(-x)) if x >= 1e-12 else -math.log(x)
        t = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            t += low * s - math.log(k * (n + 1))
            if t > r:
                best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r))
        return min(max(best, 0.0), T.MOST)

    curve = plain_curve([(round(surprise(*f), 2), label) for f, label in judged])
    return [(len(f[1]), surprise(*f), curve(surprise(*f))) for f in found]


def test_toxicity_matches_the_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    want = plain_toxicity(rows, marks)
    assert len(got) == len(rows) and sum(n > 0 for n, _, _ in want) > 10
    for (doc_id, _), (n, surprise, score) in zip(rows, want):
        r = got[doc_id]
        assert len(r.segments) == n
        assert -math.log(r.p_value) == pytest.approx(surprise, abs=1e-6)
        assert r.score == pytest.approx(score, abs=1e-3)
        if abs(score - T.THRESHOLD) > 1e-3:
            assert r.predicted == (score >= T.THRESHOLD)


def test_an_id_with_several_texts_or_rows_counts_each_text_once(spark):
    ids = [k for k in range(200) if fold(k) in (1, 2, 3)][:4]
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 1), (ids[1], 1), (ids[2], 0), (ids[3], 0)], "doc_id long, toxic int")
    rows = [(ids[0], "vile"), (ids[0], "vile"), (ids[0], "vile"), (ids[0], "rotten vile"), (ids[1], "vile"),
            (ids[2], "calm"), (ids[3], "calm"), (ids[3], None), (None, "calm")]
    made = []
    odds = T.token_odds

    def watched(learn):
        made.append({(r.toxic, r.other) for r in odds(learn).collect()})
        made.append(sorted((r.label, r.text or "", r.tied) for r in learn.collect()))
        return odds(learn)

    T.token_odds = watched
    try:
        assert T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).count() == len(rows)
    finally:
        T.token_odds = odds
    # "vile" stands in two distinct toxic texts and "rotten" in one, "calm" in one other text
    assert made[0] == {(2, 0), (1, 0), (0, 1)}
    assert made[1] == [(0, "", 1), (0, "calm", 1), (1, "rotten vile", 1)] + [(1, "vile", 3)] * 3


def plain_quality(rows, marks):
    by = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, t) for d, t in rows
                if d in marks and fold(d) in (1, 2) and t is not None and len(t.encode()) <= Q.SAMPLE_TEXT)
    dictionaries = []
    for label in (1, 0):
        texts = [t.encode() for _, d, t in by if marks[d] == label][: Q.SAMPLE_DOCS]
        parts = [t[at: at + Q.BLOCK] for t in texts for at in range(0, len(t), Q.BLOCK)]
        try:
            dictionaries.append(zstandard.train_dictionary(Q.DICTIONARY, parts, level=Q.LEVEL))
        except zstandard.ZstdError:  # too little text: the text itself
            dictionaries.append(zstandard.ZstdCompressionDict(b"".join(parts)[-Q.DICTIONARY:]))
    good, bad = dictionaries

    def size(text, dictionary):
        total = 0
        for at in range(0, len(text), Q.BLOCK):
            total += len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=dictionary, write_content_size=False,
                                                  write_dict_id=False).compress(text[at: at + Q.BLOCK]))
        return total

    found = [(d, (size(t, bad) - size(t, good)) / max(1, len(t))) for d, t in ((d, (t or "").encode()) for d, t in rows)]
    curve = plain_curve([(round(x, 3), marks[d]) for d, x in found if fold(d) in (3, 4) and d in marks])
    return [(x, curve(x)) for _, x in found]


def test_quality_matches_the_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10**9, None), (10**9 + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    for (doc_id, _), (x, score) in zip(rows, plain_quality(rows, marks)):
        r = got[doc_id]
        assert r.difference == pytest.approx(x, abs=1e-9)
        assert r.score == pytest.approx(score, abs=2e-3)
        if abs(score - Q.THRESHOLD) > 2e-3:
            assert r.predicted == (score >= Q.THRESHOLD)
