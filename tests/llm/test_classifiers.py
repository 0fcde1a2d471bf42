"""Operators 7 and 10: held-out accuracy, the scan against brute force, edges."""

import zlib

import numpy as np
import pytest

from strata.llm.compression_quality import quality_scores
from strata.llm.toxicity import scan, segments, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("scorer, column, least, recall, false_alarms", [
    (quality_scores, "quality", 0.95, 0.97, 0.3), (toxicity, "toxic", 0.97, 0.85, 0.01)])
def test_held_out_accuracy(spark, scorer, column, least, recall, false_alarms):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = scorer(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [(r.predicted, truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t, _ in held]) > least
    print(column, np.mean([p for p, t, _ in held if t == 1]), np.mean([p for p, t, _ in held if t == 0]))
    assert np.mean([p for p, t, _ in held if t == 1]) > recall
    assert np.mean([p for p, t, _ in held if t == 0]) < false_alarms
    assert abs(np.mean([s for _, _, s in held]) - np.mean([t for _, t, _ in held])) < 0.03  # calibrated


@pytest.mark.parametrize("scorer", [quality_scores, toxicity])
def test_edges(spark, scorer, edge, docs_of):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (99, 1, 1), (None, 0, 0), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = scorer(edge, marks).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert scorer(docs_of([]), labels).collect() == []


def brute(values):
    """Maximal scoring segments by their definition: the best segment, then
    the same left and right of it."""
    if not values or max(v for _, v in values) <= 0:
        return []
    best = max(((sum(v for _, v in values[a:b + 1]), -(b - a), -a), a, b) for a in range(len(values)) for b in range(a, len(values)))
    (s, _, _), a, b = best
    return brute(values[:a]) + [(values[a][0], values[b][0], s)] + brute(values[b + 1:])


def test_segments_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        hot = np.flatnonzero(rng.random(n) < 0.35)
        scores = rng.uniform(0.05, 3.0, len(hot))
        values = [(k, -0.7) for k in range(n)]
        for k, s in zip(hot, scores):
            values[k] = (int(k), float(s))
        got = segments(hot.tolist(), scores.tolist(), 0.7)
        want = brute(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_with_negative_scores_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        at = np.flatnonzero(rng.random(n) < 0.6)
        scores = rng.uniform(-3.0, 3.0, len(at))
        values = [(k, -0.7) for k in range(n)]
        for k, s in zip(at, scores):
            values[k] = (int(k), float(s))
        got = segments(at.tolist(), scores.tolist(), 0.7)
        want = brute(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_second_passage_of_the_same_words(spark):
    import pyarrow as pa

    from strata.llm.toxicity import tokens
    from strata.llm.textops import buffer

    passage, calm = "vile rotten scum", " ".join(["plain"] * 200)
    key = tokens(*buffer(pa.array([passage + " soothing"])))[3]
    order = np.argsort(key)
    scores = np.array([2.0, 1.5, 3.0, -4.0])
    text = f"{passage} {calm} {passage} {calm} scum soothing vile scum scum"
    docs = spark.createDataFrame([(1, 0, text)], "doc_id long, fold int, text string")
    found = scan(docs, key[order], scores[order]).first()
    raw = text.encode()
    assert [(raw[s.start: s.end].decode(), round(s.score, 6)) for s in found.segments] == [
        (passage, 6.5), (passage, 6.5), ("scum", 3.0), ("vile scum scum", 8.0)]
    assert round(found.best, 6) == 8.0


def test_dictionary_sample_has_one_short_text_an_id(spark, monkeypatch):
    from strata.llm import compression_quality as Q

    monkeypatch.setattr(Q, "SAMPLE_DOCS", 3)
    monkeypatch.setattr(Q, "SAMPLE_TEXT", 10)
    rows = [(k, 1, f"text {k}") for k in range(3)] + [(k, 1, "b" * n) for k in range(3) for n in (5, 5, 6, 50)]
    got = Q.sample(spark.createDataFrame(rows, "doc_id long, fold int, text string"),
                   spark.createDataFrame([(k, 1) for k in range(3)], "doc_id long, label int"))
    assert got[0] == [] and sorted(got[1]) == [b"bbbbb"] * 3
