"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import delete_path, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BATCH_ROWS = 1000  # whole texts that a task holds in Arrow form at once
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"

_left: list[tuple[SparkSession, str]] = []


class Scratch:
    """Intermediate tables of one call, in the shared checkpoint folder.

    ``table`` writes a frame once as Parquet and reads it back: the lineage
    is cut and a lost executor costs a re-read. The shuffle files behind the
    frame go as soon as it is written, so a chain of steps needs the disk of its
    largest step and not of all (older Spark ignores that setting). ``drop`` removes what the
    returned result no longer reads; whatever is still needed goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        conf = self.spark.conf
        rows, was = int(conf.get(ARROW_ROWS)), {k: conf.get(k, None) for k in (ARROW_ROWS, CLEANUP)}
        conf.set(ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in was.items():
                conf.unset(k) if v is None else conf.set(k, v)
        self.paths[name] = path
        _left.append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.paths):
            path = self.paths.pop(name, None)
            if path:
                delete_path(self.spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written once; every intermediate table that it
    left behind goes, since nothing reads it any more."""
    mark = len(_left)
    out = Scratch(spark).table(make(), name)
    for _, path in _left[mark:-1]:
        delete_path(spark, path)
    del _left[mark:-1]
    return out


class Leftovers:
    """Tables of steps that hand on by files: one goes when a later step
    starts on rows that are not read from it."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def take(self, mark: int) -> None:
        """The tables written since ``mark`` (see ``written``) are left by the step that ends."""
        self.held += _left[mark:]

    def drop_unread(self, rows: DataFrame) -> None:
        files = rows.inputFiles() if self.held else []
        for entry in [e for e in self.held if not any(e[1].split(":")[-1].lstrip("/") in f for f in files)]:
            delete_path(*entry)
            self.held.remove(entry)
            if entry in _left:
                _left.remove(entry)


def written() -> int:
    """How many tables there are so far."""
    return len(_left)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def to_arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a frame whose size was checked, on the driver."""
    table: pa.Table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def fit_logistic(x: np.ndarray, positives: np.ndarray, rows: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve through binned counts, slope not
    negative (Newton steps with a small ridge; without both labels a constant)."""
    p, n = float(np.sum(positives)), float(np.sum(rows))
    base = float(np.log((p + 0.5) / (n - p + 0.5)))
    if n == 0 or p in (0.0, n):
        return 0.0, base
    mean = float(np.average(x, weights=rows))
    spread = float(np.sqrt(np.average((x - mean) ** 2, weights=rows))) or 1.0
    z = (x - mean) / spread
    w = np.array([0.0, base])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (positives - rows * q) - ridge * n * np.array([w[0], 0.0])
        hess = (design * (rows * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ design + np.diag([ridge * n, 1e-9])
        step = np.clip(np.linalg.solve(hess, grad), -2.0, 2.0)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    if w[0] <= 0:
        return 0.0, base
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def logistic(x: Column, curve: tuple[float, float]) -> Column:
    return 1.0 / (1.0 + F.exp(-(x * F.lit(curve[0]) + F.lit(curve[1]))))


def text_sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keep_chosen(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are in ``chosen`` (_id, _sha, _tied),
    all columns; of rows that repeat both (_tied > 1) one."""
    sha, = fresh(docs, "_text_sha")
    rows = docs.withColumn(sha, text_sha(F.col(text_col)))
    stay = rows.join(chosen, (rows[sha] == chosen["_sha"]) & rows[id_col].eqNullSafe(chosen["_id"]))
    once = stay.where("_tied = 1").select(*[rows[c] for c in docs.columns])
    again = stay.where("_tied > 1").dropDuplicates(["_id", "_sha"]).select(*[rows[c] for c in docs.columns])
    return once.unionByName(again)
