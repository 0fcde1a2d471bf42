"""Toxic passages by maximum-scoring segments (operator 10).

Tokens (runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered) and
their stems (first ``STEM`` code points) get the log-odds of appearing in
toxic against other documents, with a Dirichlet prior that follows their share
in all labelled text; what counts is the end of the confidence interval nearer
to 0, and for a token the higher of its own and its stem's. Tokens that are not
significantly toxic or harmless cost ``DRAG``. In the sequence of all tokens
the Ruzzo-Tompa scan finds every maximal scoring segment in linear time; each
occurrence of a token counts. Maxima of random sequences follow an extreme-value law
P(S >= s) = 1 - exp(-K n e^(-lambda s)): lambda solves sum p e^(lambda s) = 1
over the other documents' tokens, K is its maximum-likelihood value on them.
Several segments are judged together by the law of the sum of the r best,
P ~ e^-T T^(r-1) / (r! (r-1)!) with T = sum(lambda S) - r ln(K n); the r with
the smallest P counts. A logistic curve over -ln P gives the score.

Labels are used only from rows whose crc32(id as text) mod ``FOLDS`` is not 0:
folds 1 to 3 give the log-odds (every distinct text counts a token once), fold
4 K and the curve. The fit is on a bounded sample: about ``FIT_DOCS`` labelled
documents, chosen by hash of the id, which bounds the token table too. Only
significant tokens (``LEAST`` documents at least) are broadcast.

Whole texts are scanned. Empty or null texts have no segment and get the
score of the curve there; null ids count as '' for the fold; repeated rows are
scored each; without labels of both kinds the score is constant. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, fit_logistic, id_fold, logistic, text_sha, to_arrays
from strata.llm.textops import Counter, Hasher, U, buffer, lookup, lower_ascii, row_of, slices

FOLDS = 5
FIT_DOCS = 200_000
STEM = 4
PRIOR = 1000.0    # total weight of the prior that follows the shares
EACH = 0.5        # prior weight of every token beside that
Z = 2.5           # standard errors taken off a log-odds ratio
LEAST = 3         # documents of its kind a token needs
DRAG = 0.1        # cost of any other token
THRESHOLD = 0.5
MOST = 20.0       # -ln P beyond this says no more

IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[128:] = True
IN_TOKEN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, hash, hash of the stem) of every token of a buffer."""
    low = lower_ascii(data)
    n = len(low)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U), np.zeros(0, U)
    solid = IN_TOKEN[low]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    heads = np.append(np.flatnonzero((low & 0xC0) != 0x80), n)  # first bytes of code points
    stem = heads[np.minimum(np.searchsorted(heads, starts) + STEM, len(heads) - 1)]
    hasher = Hasher(low)
    return (starts, ends, row_of(starts, off), hasher.span(starts, ends),
            hasher.span(starts, np.minimum(stem, ends)) ^ U(1))


def segments(at: list[int], scores: list[float], drag: float = DRAG) -> list[tuple[int, int, float]]:
    """Maximal scoring segments (Ruzzo and Tompa 1999) of a sequence whose
    positions ``at`` score ``scores`` and all others ``-drag``, as
    (first, last, score) in order."""
    stack: list[list] = []  # first, last, left sum, right sum
    total, before = 0.0, None
    for p, s in zip(at, scores):
        if before is not None:
            total -= (p - before - 1) * drag
        before = p
        if s <= 0:
            total += s
            continue
        part = [p, p, total, total + s]
        total += s
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= part[2]:
                j -= 1
            if j < 0 or stack[j][3] >= part[3]:
                break
            part = [stack[j][0], part[1], stack[j][2], part[3]]
            del stack[j:]
        stack.append(part)
    return [(a, b, right - left) for a, b, left, right in stack]


def token_odds(learn: DataFrame) -> DataFrame:
    """(token, toxic, other): distinct texts with the token or stem, by label,
    from rows (label, text, tied); each of ``tied`` equal rows is a part of one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int], Counter] = {}
        for batch in slices(batches, "text"):
            _, _, row, key, stem = tokens(*buffer(batch.column("text")))
            row, key = np.concatenate([row, row]), np.concatenate([key, stem])
            label, tied = (batch.column(c).to_numpy() for c in ("label", "tied"))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            for k, t in sorted(set(zip(label.tolist(), tied.tolist()))):
                counters.setdefault((k, t), Counter()).add(key[once & ((label == k) & (tied == t))[row]])
        for (k, t), c in counters.items():
            key, n = c.merge()
            zero = np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n / t if k else zero), pa.array(zero if k else n / t)],
                                             names=["token", "toxic", "other"])

    def whole(side: str) -> Column:
        return F.round(F.sum(side)).cast("long").alias(side)

    return (learn.select("label", "text", F.col("tied").cast("long").alias("tied"))
            .mapInArrow(count, "token long, toxic double, other double").groupBy("token").agg(whole("toxic"), whole("other")))


def lexicon(odds: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted token hashes, scores, lambda) of the significantly toxic and the
    significantly harmless tokens."""
    n1, n0 = (odds.agg(F.sum("toxic"), F.sum("other")).first() or (0, 0))
    n1, n0 = float(n1 or 0), float(n0 or 0)
    if not n1 or not n0:
        return np.zeros(0, U), np.zeros(0), 1.0
    prior = EACH + PRIOR * (F.col("toxic") + F.col("other")) / (n1 + n0)
    a, b = F.col("toxic") + prior, F.col("other") + prior
    ratio = F.log(a / (n1 + PRIOR + EACH)) - F.log(b / (n0 + PRIOR + EACH))
    error = Z * F.sqrt(1 / a + 1 / b)
    score = (F.when((F.col("toxic") >= LEAST) & (ratio - error > DRAG), ratio - error)
             .when((F.col("other") >= LEAST) & (ratio + error < -DRAG), ratio + error))
    table = to_arrays(odds.select("token", score.alias("score"), (b / (n0 + PRIOR)).alias("p")).where("score IS NOT NULL"))
    key = table["token"].astype(np.int64).view(U)
    order = np.argsort(key)
    s, p = table["score"].astype(float)[order], table["p"].astype(float)[order]
    rest = max(1.0 - p.sum(), 1e-9)
    low_, high = 0.0, 50.0
    for _ in range(100):  # the root above 0 of sum p e^(lambda s) = 1
        mid = (low_ + high) / 2
        if (p * np.exp(np.minimum(mid * s, 700))).sum() + rest * np.exp(-mid * DRAG) > 1:
            high = mid
        else:
            low_ = mid
    return key[order], s, max(low_, 1e-3) if (s > 0).any() else 1.0


def scan(docs: DataFrame, keys: np.ndarray, scores: np.ndarray) -> DataFrame:
    """Every row of (doc_id, fold, text): number of tokens, the best segment's
    score and all segments as byte spans, over every occurrence of a token."""
    held = docs.sparkSession.sparkContext.broadcast((keys, scores))  # bounded by FIT_DOCS
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight = held.value
        for batch in slices(batches, "text"):
            data, off = buffer(batch.column("text"))
            starts, ends, row, key, stem = tokens(data, off)
            n = np.bincount(row, minlength=batch.num_rows)
            odds = np.full(len(key), np.nan)
            for unit in (key, stem):
                place, hit = lookup(table, unit)
                odds[hit] = np.fmax(odds[hit], weight[place[hit]])
            hit = np.flatnonzero(~np.isnan(odds))
            cut = np.searchsorted(row[hit], np.arange(batch.num_rows + 1))
            best, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(np.diff(cut)).tolist():
                mine = hit[cut[k]: cut[k + 1]]
                found = segments(mine.tolist(), odds[mine].tolist())
                best[k] = max((s for _, _, s in found), default=0.0)  # harmless tokens alone make none
                spans[k] = [{"start": int(starts[a] - off[k]), "end": int(ends[b] - off[k]), "score": s} for a, b, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fold"), pa.array(n, pa.int64()), pa.array(best), pa.array(spans, pa.list_(span))],
                names=["doc_id", "fold", "n_tokens", "best", "segments"])

    return docs.mapInArrow(find, f"doc_id {kind}, fold int, n_tokens long, best double, segments array<struct<start:int,end:int,score:double>>")


def _several(found: Column, lam: float, room: Column) -> Column:
    """Largest -ln P of the r best segments together, r = 1, 2, .. (0 if T <= r)."""
    scores = F.reverse(F.array_sort(F.transform(found, lambda s: s["score"])))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "t", "fact", "best")])

    def add(a, s):
        r, t = a["r"] + 1, a["t"] + lam * s - room
        fact = a["fact"] + F.log(r)  # ln r!
        value = F.when(t > r, t - (r - 1) * F.log(t) + fact + a["fact"]).otherwise(0.0)
        return F.struct(r.alias("r"), t.alias("t"), fact.alias("fact"), F.greatest(a["best"], value).alias("best"))

    return F.aggregate(scores, zero, add, lambda a: a["best"])


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, segments (byte spans with scores), p_value, score,
    predicted for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), id_fold(F.col(id_col), FOLDS).cast("int").alias("fold"),
                       F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    share = min(1.0, FIT_DOCS / max(1, marks.count()))
    chosen = F.crc32(F.md5(F.col("doc_id").cast("string").cast("binary")).cast("binary")) < share * 2**32
    # one id for each distinct labelled text: FIT_DOCS rows, so that texts needn't be shuffled
    sha = F.unhex(text_sha(F.col("text")))
    picked = (rows.where("fold IN (1, 2, 3)").where(chosen).select("doc_id", sha.alias("sha"))
              .join(marks.distinct(), "doc_id").groupBy("sha", "label", "doc_id").agg(F.count("*").alias("tied"))
              .groupBy("sha", "label").agg(F.min(F.struct("doc_id", "tied")).alias("one")).select("one.*", "sha", "label"))
    # the id may stand on other texts too, and several times on this one
    learn = rows.join(F.broadcast(picked), "doc_id").where(F.col("sha") == sha)
    keys, scores, lam = lexicon(scratch.table(token_odds(learn), "token-odds"))
    scratch.drop("token-odds")
    found = scratch.table(scan(rows, keys, scores), "segments")
    judged = found.where("fold = 4").join(marks, "doc_id")
    tail = (F.col("n_tokens") + 1) * F.exp(-lam * F.col("best"))
    k = judged.where("label = 0").agg(F.count("*") / F.sum(tail)).first()[0] or 1.0
    # ln of 1 - exp(-x), which is ln x for small x
    x = F.lit(k) * tail
    best = F.when(x < 1e-6, -F.log(x)).otherwise(-F.log(-F.expm1(-x)))
    surprise = F.least(F.greatest(best, _several(F.col("segments"), lam, F.log(F.lit(k) * (F.col("n_tokens") + 1)))), F.lit(MOST))
    bins = to_arrays(judged.groupBy(F.round(surprise, 2).alias("x")).agg(F.sum("label").alias("y"), F.count("*").alias("n")))
    curve = fit_logistic(bins["x"].astype(float), bins["y"].astype(float), bins["n"].astype(float))
    return found.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "segments", F.exp(-surprise).alias("p_value"),
        logistic(surprise, curve).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
