"""Quality by compression (operator 7).

Two zstandard dictionaries are trained, on good and on bad labelled text. A
document's blocks of ``BLOCK`` bytes are compressed with each; the difference
of the compressed sizes (bad minus good) divided by the document's bytes says
which kind of text it resembles. A logistic curve fitted on other labelled
documents turns that into a score from 0 to 1.

Labels are used only from rows whose crc32(id as text) mod ``FOLDS`` is not 0:
folds 1 and 2 give dictionary text, 3 and 4 the curve. Dictionaries are fitted
on a bounded sample: the first ``SAMPLE_DOCS`` labelled documents of each
class in MD5 order of the id, texts over ``SAMPLE_TEXT`` bytes left out. The
curve uses every labelled document of its folds (counted in bins).

Whole texts are scored. An empty or null text has difference 0 and so the
score of the curve there; null ids count as '' for the fold; repeated rows are
scored each; without labels of both kinds the score is constant. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, fit_logistic, id_fold, logistic, to_arrays
from strata.llm.textops import buffer, slices

FOLDS = 5
BLOCK = 512
DICTIONARY = 64 << 10
LEVEL = 3
SAMPLE_DOCS = 1500
SAMPLE_TEXT = 64 << 10
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[at: at + BLOCK] for at in range(0, len(text), BLOCK)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; for too little text the text itself."""
    samples = [b for t in texts for b in blocks(t)]
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    parts = blocks(text)
    return sum(len(bad.compress(b)) - len(good.compress(b)) for b in parts) / max(1, len(text))


def sample(rows: DataFrame, marks: DataFrame) -> dict[int, list[bytes]]:
    """The texts for each dictionary. Only ids are sorted; the chosen ones, at
    most 2 * SAMPLE_DOCS, are broadcast to fetch their texts."""
    by = F.md5(F.col("doc_id").cast("string").cast("binary"))
    short = rows.where(F.col("fold").isin(1, 2) & (F.octet_length("text") <= SAMPLE_TEXT))
    ids = short.select("doc_id", by.alias("by")).join(marks, "doc_id").distinct()
    first = [ids.where(F.col("label") == k).orderBy("by").limit(SAMPLE_DOCS) for k in (0, 1)]
    found = (short.join(F.broadcast(first[0].union(first[1])), "doc_id")
             .groupBy("label", "by", "doc_id").agg(F.min("text").alias("text")).collect())  # one text an id
    return {k: [r.text.encode() for r in sorted(found, key=lambda r: (r.by, r.text or "")) if r.label == k and r.text] for k in (0, 1)}


def differences(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(doc_id, fold, difference) of every row of (doc_id, fold, text)."""
    held = docs.sparkSession.sparkContext.broadcast((good, bad))  # two dictionaries of DICTIONARY bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = [compressor(d) for d in held.value]
        for batch in slices(batches, "text"):
            data, off = buffer(batch.column("text"))
            raw = data.tobytes()
            d = [difference(raw[a:b], *ours) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fold"), pa.array(d, pa.float64())], names=["doc_id", "fold", "difference"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"doc_id {kind}, fold int, difference double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, difference, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), id_fold(F.col(id_col), FOLDS).cast("int").alias("fold"),
                       F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    texts = sample(rows, marks)
    good, bad = (train_dictionary(texts[k]) for k in (1, 0))
    found = Scratch(docs.sparkSession).table(differences(rows, good, bad), "differences")
    bins = to_arrays(
        found.where("fold IN (3, 4)").join(marks, "doc_id")
        .groupBy(F.round("difference", 3).alias("x")).agg(F.sum("label").alias("y"), F.count("*").alias("n")))
    curve = fit_logistic(bins["x"].astype(float), bins["y"].astype(float), bins["n"].astype(float))
    return found.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "difference", logistic(F.col("difference"), curve).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
