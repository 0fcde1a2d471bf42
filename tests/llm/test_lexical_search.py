"""Operator 12 against a plain ranking, with edge cases and planted passages."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from strata.llm import lexical_search as S
from strata.llm import textops

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (d, bag), n in zip(bags, lengths, strict=True):
            m = 25 + (75 * n * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def both(spark, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = S.search(docs, table, **options).select("item_id", "rank", "doc_id", "score").collect()
    want = plain_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items, options.get("k", 10))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return got


def test_matches_plain_ranking(spark, sample):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert len(both(spark, sample, items)) > 100
    # several batches of items, one seed, shuffled instead of broadcast ids
    both(spark, sample, items[:12], batch_bytes=600, seeds=1, k=3)


def test_shuffled_ids_give_the_same(spark, sample, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5).collect()]
    monkeypatch.setattr(S, "BROADCAST_IDS", 0)
    both(spark, sample, items)


def test_edge_cases(spark, edge, docs_of):
    items = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "B b a"), (4, "nowhere-in any-text"), (5, "İΣ é"), (6, "!?")]
    both(spark, edge, items)
    assert both(spark, docs_of([]), items) == []
    assert both(spark, edge, []) == []
    assert both(spark, docs_of([(1, None), (2, "")]), items) == []


def test_ties_and_copies_go_by_id(spark, docs_of):
    docs = docs_of([(i, "alpha beta gamma" if i % 2 else f"alpha delta{i}") for i in range(80)] + [(7, "alpha beta gamma")] * 3)
    got = both(spark, docs, [(1, "beta alpha alpha"), (2, "alpha"), (3, "delta4")])
    assert [r.doc_id for r in sorted((r for r in got if r.item_id == 1), key=lambda r: r.rank)][:6] == [1, 3, 5, 7, 7, 7]


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, size=int(n))) for n in rng.integers(0, 600, 60)] + ["z " * 5000 + "w1"]
    items = [(i, " ".join(rng.choice(vocabulary, size=20))) for i in range(15)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    index = list(S._index([part]))
    batch = S.Batch(items)
    df = Counter()
    for p in batch.frequencies([part]):
        df.update(dict(zip(p.column("term").to_pylist(), p.column("df").to_pylist(), strict=True)))
    bags = [Counter(terms(t)) for t in texts]
    total = sum(sum(b.values()) for b in bags)
    n_docs = sum(bool(b) for b in bags)
    batch.weigh(df, n_docs, total)
    bounds = np.concatenate([batch.bounds(p) for p in index])
    exact = np.zeros_like(bounds)
    for item, _, d, s in plain_search(list(enumerate(texts)), items, k=1000):
        exact[d, item] = s
    assert (bounds >= exact).all()
    # sketches tell documents apart: most bounds are exact or nearly so
    assert np.median((bounds - exact)[exact > 0] / exact[exact > 0]) < 0.2


def test_a_hash_collision_is_no_match(monkeypatch):
    monkeypatch.setattr(textops.Hasher, "span", lambda self, a, b: np.full(len(a), 5, np.uint64))
    batch = S.Batch([(0, "aa")])
    row, _ = batch.found(S.Terms(*textops.buffer(pa.array(["aa ab", "abc", "aa"]))))
    assert row.tolist() == [0, 2]
