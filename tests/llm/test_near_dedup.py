"""Operator 9 against brute force over all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import near_dedup as N
from strata.llm.textops import buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return Counter()
    return Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def jaccard(a, b):
    union = a | b
    return sum((a & b).values()) / sum(union.values()) if union else 0.0


def make(rng, n, vocab=400, size=120):
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, size)) if n else ""


def corpus():
    rng = np.random.default_rng(11)
    rows, k = [], 0
    passage = make(rng, 1, size=60)
    for _ in range(12):  # families: edits of one text
        base = make(rng, 1, vocab=5000, size=int(rng.integers(40, 300))).split()
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[at] = f"x{rng.integers(10**6)}"
            rows.append((k := k + 1, " ".join(w)))
    for _ in range(25):  # a hot passage in short texts that are no copies
        rows.append((k := k + 1, passage + " " + make(rng, 1, vocab=5000, size=int(rng.integers(20, 60)))))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \n"), (k + 4, "Two words"), (k + 5, "two WORDS"), (k + 6, rows[3][1]), (k + 6, rows[3][1])]
    return rows


def brute(rows):
    bags = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and jaccard(bags[i], bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))], bags


@pytest.mark.parametrize("block", [2500, 3])
def test_classes_match_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(N, "DAMP", 0.0)  # then the weights are the counts
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus()
    roots, _ = brute(rows)
    want = {}
    for i, (doc_id, _) in enumerate(rows):
        want.setdefault(roots[i], set()).add(doc_id)
    got = N.near_classes(docs_of(rows)).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    assert {frozenset(v) for v in classes.values()} == {frozenset(v) for v in want.values()}
    assert all(k == min(v) for k, v in classes.items())


def test_kept_rows(docs_of, edge):
    rows = corpus()
    out = N.drop_near_copies(docs_of(rows)).collect()
    kept = {r.class_id for r in N.near_classes(docs_of(rows)).collect()}
    assert sorted(r.doc_id for r in out) == sorted(kept)
    out = N.drop_near_copies(edge)
    assert out.columns == edge.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(4) == 1 and None not in ids and {1, 2, 3, 5, 6, 7, 8, 9} <= set(ids)
    assert N.drop_near_copies(docs_of([])).collect() == [] == N.near_classes(docs_of([])).collect()


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(2)
    hits, truth = [], []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(12):
            keys = rng.integers(0, 2**63, 400).astype(np.uint64)
            wa = rng.uniform(0.5, 4, 400)
            wb = np.where(rng.random(400) < share, wa, rng.uniform(0.5, 4, 400))
            s = [N.consistent_samples(np.zeros(400, int), keys, w, 1)[:, 0] for w in (wa, wb)]
            hits.append((s[0] == s[1]).mean())
            truth.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(hits) - np.mean(truth)) < 0.03
    assert np.corrcoef(hits, truth)[0, 1] > 0.6


@pytest.mark.parametrize("piece", [1, 50, 1 << 14])
def test_samples_are_taken_in_pieces_of_whole_rows(monkeypatch, piece):
    """Row by row the smallest variate names the sample, and no array of a step is longer than a piece and a row."""
    monkeypatch.setattr(N, "PIECE", piece)
    seen, part = [], N._sample
    monkeypatch.setattr(N, "_sample", lambda out, rows, key, *rest: seen.append(len(key)) or part(out, rows, key, *rest))
    rng = np.random.default_rng(3)
    size = rng.integers(0, 40, 30)
    row = np.repeat(np.arange(30), size)
    key, weight = rng.integers(0, 2**64, len(row), dtype=np.uint64), rng.uniform(0.5, 4, len(row))
    got = N.consistent_samples(row, key, weight, 30)
    assert sum(seen) == len(row) and max(seen) <= piece + max(size)
    for k in range(N.SAMPLES):
        for r in range(30):
            mine = np.flatnonzero(row == r)
            if not len(mine):
                assert got[k, r] == 0
                continue
            g = key[mine] * np.uint64(N._ODD[k])
            one, two, three = ((g >> np.uint64(16 * lane) & np.uint64(0xFFFF)).astype(int) for lane in (3, 2, 1))
            t = np.floor(np.log(weight[mine]).astype(np.float32) / N._R[one] + N._B[two])
            best = np.argmin(N._LN_C[three] - N._R[one] * (t - N._B[two] + np.float32(1)))
            name = N.mix(g[best: best + 1] + np.uint64(int(t[best]) % 2**64))
            assert got[k, r] == int(name[0] >> np.uint64(32)) | 1


def test_weights_of_shingles_are_looked_up_in_their_row():
    rng = np.random.default_rng(4)
    row = np.repeat(np.arange(20), 30)
    key = rng.integers(0, 9, len(row)).astype(np.uint64) + np.uint64(10) * np.arange(len(row)).astype(np.uint64)
    many = [{int(x): int(rng.integers(2, 50)) for x in rng.permutation(key[row == r])[: r]} for r in range(20)]
    known = pa.array([np.array(list(m), np.uint64).tobytes() or None for m in many], pa.binary())
    df = pa.array([np.array(list(m.values()), "<u4").tobytes() or None for m in many], pa.binary())
    number = np.array([many[r].get(int(x), 1) for r, x in zip(row, key)])
    assert N.damped_idf(row, key, known, df, 100).tolist() == (np.log1p(100 / number) ** N.DAMP).tolist()
    assert N.damped_idf(row[:0], key[:0], known[:0], df[:0], 100).tolist() == []
    assert set(N.damped_idf(row, key, known[:1].take(pa.array([0] * 20)), df[:1].take(pa.array([0] * 20)), 100)) == {np.log1p(100.0) ** N.DAMP}


def test_shingles():
    texts = ["a b c d e f", None, "A b", "a  b\n", "x x x x x x x"]
    row, key, tf, node = N.shingles(*buffer(pa.array(texts)))
    assert np.bincount(row, minlength=5).tolist() == [2, 0, 1, 1, 1] and tf[-1] == 3
    assert node[2].tolist() == node[3].tolist() != node[0].tolist()


def test_idf_is_the_document_frequency_of_each_shingle(docs_of, monkeypatch):
    monkeypatch.setattr(N, "DAMP", 1.0)
    rng = np.random.default_rng(5)
    hot = make(rng, 1, vocab=5000, size=60)
    rows = [(k, hot + " " + make(rng, 1, vocab=5000, size=30)) for k in range(60)]  # alike only in what is frequent
    for k in range(60, 100, 2):  # the same own part behind the hot passage or not
        own = make(rng, 1, vocab=5000, size=120)
        rows += [(k, hot + " " + own), (k + 1, own)]
    bags = [grams(t) for _, t in rows]
    df = Counter(g for bag in bags for g in bag)
    weights = [{g: n * np.log1p(len(rows) / df[g]) for g, n in bag.items()} for bag in bags]

    def similar(a, b):
        common = sum(min(w, b[g]) for g, w in a.items() if g in b)
        return common / (sum(a.values()) + sum(b.values()) - common) >= 0.8

    want = {frozenset((rows[i][0], rows[j][0])) for i in range(len(rows)) for j in range(i) if similar(weights[i], weights[j])}
    plain = {frozenset((rows[i][0], rows[j][0])) for i in range(len(rows)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8}
    classes = {}
    for r in N.near_classes(docs_of(rows)).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    print(len(want), len(plain))
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == want != plain


@pytest.mark.parametrize("limits", [{"BLOCK_BYTES": 2500}, {"BLOCK_BYTES": 2500, "SPLIT": 1}, {"BLOCK": 3, "SPLIT": 2}])
def test_large_buckets_are_compared(docs_of, monkeypatch, limits):
    monkeypatch.setattr(N, "DAMP", 0.0)
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value, raising=False)
    # members agree on all samples, and none is verified with its leader
    samples = N.SAMPLES
    monkeypatch.setattr(N, "consistent_samples", lambda row, key, weight, n: np.full((samples, n), 7, np.uint32))
    monkeypatch.setattr(N, "AGREE", samples + 1)
    monkeypatch.setattr(N, "PAIRS", 3)
    rows = corpus()[:40]
    roots, bags = brute(rows)
    want = {}
    for i, (doc_id, _) in enumerate(rows):
        want.setdefault(roots[i], set()).add(doc_id)
    classes = {}
    for r in N.near_classes(docs_of(rows)).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in classes.values()} == {frozenset(v) for v in want.values()}


def test_recall_where_buckets_are_split(docs_of, monkeypatch):
    """Many small families of one template share buckets without being near
    copies; beyond a few blocks such buckets are split by further samples."""
    monkeypatch.setattr(N, "DAMP", 0.0)
    monkeypatch.setattr(N, "BLOCK", 6)
    monkeypatch.setattr(N, "SPLIT", 2)
    splits, finer = [], N._finer
    monkeypatch.setattr(N, "_finer", lambda members: splits.append(members.count()) or finer(members))
    rng = np.random.default_rng(23)
    base = make(rng, 1, vocab=10**6, size=200).split()

    def edited(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        return words

    rows = []
    for _ in range(45):
        own = edited(base, int(rng.integers(6, 10)))
        rows += [(len(rows) + k, " ".join(edited(own, int(rng.integers(0, 4))))) for k in range(int(rng.integers(2, 5)))]
    bags = [grams(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8]
    class_of = {r.doc_id: r.class_id for r in N.near_classes(docs_of(rows)).collect()}
    found = np.mean([class_of[rows[i][0]] == class_of[rows[j][0]] for i, j in links])
    print(f"{len(rows)} documents, {len(links)} pairs, members of split buckets {splits}, recall {found}")
    assert len(splits) >= 2 and min(splits) > 50
    roots, _ = brute(rows)
    together = {}
    for i, (doc_id, _) in enumerate(rows):
        together.setdefault(class_of[doc_id], set()).add(roots[i])
    assert all(len(r) == 1 for r in together.values())  # nothing is joined without links
    assert found >= 0.99


def test_dealt_shingles_are_counted_once_and_go(docs_of, monkeypatch):
    """The rows of all shingles pass one shuffle, and it is off the disk when the counts travel back."""
    steps = {}

    class Watched(N.Scratch):
        def table(self, df, name):
            plan = df._jdf.queryExecution().executedPlan().toString()
            steps[name] = (len(re.findall(r"\bExchange hashpartitioning", plan)), "counted" in self.paths)
            return super().table(df, name)

    monkeypatch.setattr(N, "Scratch", Watched)
    N.near_classes(docs_of(corpus()[:30])).collect()
    assert steps["counted"] == (1, False) and steps["frequencies"] == (2, True) and steps["sketches"][1] is False
