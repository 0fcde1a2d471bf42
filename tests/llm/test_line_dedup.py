"""Operator 8 against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np

from strata.llm.line_dedup import clean_lines

SPACE = " \t\n\x0b\x0c\r"


def expected(rows, least):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(SPACE)].add(site)
    out = []
    for doc_id, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not x.strip(SPACE) or len(sites[x.strip(SPACE)]) < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept) if lines else None))
    return out


def check(df, rows, least):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in clean_lines(df, min_sites=least).collect()]
    assert sorted(got, key=key) == sorted(expected(rows, least), key=key)


def test_spread_around_the_threshold(docs_of):
    rng = np.random.default_rng(1)
    rows = []
    for spread in range(1, 60, 2):  # lines on 1, 3, .. sites, one site more often than others
        for site in list(range(spread)) + [0] * 5:
            rows.append([len(rows), f"  line of {spread} \n\nown {rng.integers(1 << 40)}\t", f"s{site}"])
    for least in (2, 8, 30):
        check(docs_of([tuple(r) for r in rows]), rows, least)


def test_sample_and_edges(sample, edge, docs_of):
    check(sample, [(r.doc_id, r.text, r.source) for r in sample.collect()], 8)
    check(edge, [(r.doc_id, r.text, r.source) for r in edge.collect()], 1)
    assert clean_lines(docs_of([])).collect() == []
    assert hashlib.sha256(b"").hexdigest() in {r.sha for r in clean_lines(edge).collect()}


def test_a_text_of_many_lines_takes_linear_time(spark, docs_of):
    import time
    common = [f"boiler {i % 50}" for i in range(40_000)]
    long = "\n".join(x for i, c in enumerate(common) for x in (c, f"own {i}"))
    df = docs_of([(i, "\n".join(common[:50]), f"s{i}") for i in range(9)] + [(100 + i, long, "z") for i in range(8)])
    began = time.time()
    got = clean_lines(df).where("doc_id >= 100").select("n_lines", "n_removed", "text").collect()
    assert time.time() - began < 60
    assert {(r.n_lines, r.n_removed) for r in got} == {(80_000, 40_000)}
    assert {r.text for r in got} == {"\n".join(f"own {i}" for i in range(40_000))}
