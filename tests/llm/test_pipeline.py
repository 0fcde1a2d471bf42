"""The pipeline against a brute-force version of its stages."""

import math
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from strata.llm import near_dedup as N
from strata.llm.quality_rules import BINS, FENCE, LEAST_SPREAD, ORDER
from tests_llm_helpers import lowered, packed_rows, plain_features, plain_mix_rows, plain_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def quality(rows):
    out = []
    for lang in sorted({r.lang for r in rows}):
        mine = [r for r in rows if r.lang == lang]
        p = plain_model([r.text for r in mine])
        judged = []
        for r in mine:
            n, _, _, _, again = plain_features(r.text)
            b = b"\n" * (ORDER - 1) + r.text.encode()
            bits = -sum(np.log2(p[b[i: i + ORDER]]) for i in range(len(b) - ORDER + 1)) / max(n, 1)
            judged.append((r, n < 50 or 100 * again > 50 * n, bits))
        bins = sorted(int(np.floor(x * BINS)) for _, failed, x in judged if not failed)
        if not bins:
            continue
        q = [bins[int(np.ceil(f * len(bins))) - 1] / BINS for f in (0.25, 0.75)]
        spread = max(q[1] - q[0], LEAST_SPREAD)
        out += [r for r, failed, x in judged if not failed and q[0] - FENCE * spread <= x <= q[1] + FENCE * spread]
    return out


def exact(rows):
    best = {}
    for r in rows:
        k = lowered(r.text)
        if k not in best or r.doc_id > best[k].doc_id:
            best[k] = r
    return list(best.values())


def plain_shingles(text):
    """Runs of five words, lower-cased A-Z; a shorter text is one."""
    words = [lowered(w) for w in WORD.findall(text)]
    return [tuple(words[i: i + N.WORDS]) for i in range(max(1, len(words) - N.WORDS + 1))] if words else []


def near(rows):
    bags = [Counter(plain_shingles(r.text)) for r in rows]
    df = Counter(x for bag in bags for x in bag)
    bags = [{x: n * math.log1p(len(rows) / df[x]) ** N.DAMP for x, n in bag.items()} for bag in bags]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            common = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if common and common / (sum(a.values()) + sum(b.values()) - common) >= N.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    first = {}
    for i, r in enumerate(rows):
        k = root(i)
        if k not in first or r.doc_id < first[k].doc_id:
            first[k] = r
    return list(first.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = near(exact(quality(docs.collect())))
    mixed = plain_mix_rows(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(packed_rows(mixed))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_keep_columns_and_edges(spark, edge, docs_of):
    for docs in (edge, docs_of([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
