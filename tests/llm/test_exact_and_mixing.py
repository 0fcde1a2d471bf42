"""Operators 5 and 6 against plain Python, with edge cases, and every SQL."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from strata.llm.exact_dedup import drop_exact_copies, exact_classes
from strata.llm.mixing import mix, schedule
from strata.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NULL = object()
key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows, wanted = [tuple(r) for r in got.select(*columns).collect()], want.fetchall()
    assert len(rows) > 0 and sorted(rows, key=key) == sorted(wanted, key=key)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_classes(edge, sample, docs_of):
    for df in (edge, sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for d, t in rows:
            groups[lowered(t)].append(d)
        want = []
        for d, t in rows:
            ids = groups[lowered(t)]
            keep = max((x for x in ids if x is not None), default=None)
            want.append((d, keep, len(ids), hashlib.sha256(lowered(t).encode()).hexdigest(), d == keep))
        got = [tuple(r) for r in exact_classes(df).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        left = drop_exact_copies(df)
        assert left.columns == df.columns
        best = {t: max(ids, key=lambda x: (x is not None, x or 0)) for t, ids in groups.items()}
        assert sorted(((r.doc_id, lowered(r.text)) for r in left.collect()), key=key) == sorted(((v, k) for k, v in best.items()), key=key)
    assert exact_classes(docs_of([])).collect() == [] == drop_exact_copies(docs_of([])).collect()


def size_of(text):
    return len(WORD.findall(text or ""))


def plain_mix(rows):
    """Targets by raising the water level source by source; turns taken in the
    order of their virtual finish times up to the budget."""
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), size(t), d))
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(x[1] for x in by[s]) for s in names}
    left, open_, target = Fraction(3, 2) * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * total[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = Fraction(2 * total[s])
            left -= target[s]
            open_.remove(s)
    out, turns = [], []
    for k, s in enumerate(names):
        at = 0
        for _, n, d in sorted(by[s], key=lambda x: x[:2]):
            for e in (0, 1):
                turns.append(((at + e * total[s] + n) / weight[s], k, e, at, len(out)))
            out.append([d, n, total[s], float(target[s]), 0])
            at += n
    left = sum(total.values()) * 3 // 2
    for *_, x in sorted(turns):
        words = min(out[x][1], left)
        out[x][4] += words
        left -= words
    return [tuple(x) for x in out]


def test_mixing(docs_of, edge, sample):
    many = [(k, "w " * (k * 7 % 40), f"s{k % 9}" if k % 3 else "big") for k in range(300)] + [(k, "a b", None) for k in range(300, 305)]
    for df, rows in ((docs_of(many), many), (edge, None), (sample, None)):
        rows = rows or [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = [tuple(r) for r in schedule(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
        want = plain_mix(rows)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * max(1, w[3]) and g[4] == w[4]
        assert sum(g[4] for g in got) == sum(g[1] for g in got) * 3 // 2
        again = [tuple(r) for r in schedule(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
        assert sorted(got, key=key) == sorted(again, key=key)
        by_source = defaultdict(lambda: [0, 0, 0])
        for (_, t, s), w in zip(sorted(rows, key=lambda r: (key((r[0],)), size_of(r[1]))), sorted(want, key=lambda w: (key((w[0],)), w[1])), strict=True):
            x = by_source[s]
            x[0], x[1], x[2] = x[0] + w[4], w[3], max(x[2], w[1])
        for served, target, longest in by_source.values():
            assert abs(served - target) <= 2 * longest + 1
    out = mix(docs_of(many))
    assert out.columns == docs_of(many).columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    taken = {g[0]: g for g in plain_mix(many)}
    for d, g in taken.items():
        assert abs(times[d] * g[1] - g[4]) <= g[1]
    assert mix(edge).columns == edge.columns
    assert schedule(docs_of([])).collect() == [] == mix(docs_of([])).collect()
