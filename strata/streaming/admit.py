"""Age-gated admission: a file becomes eligible once it is old enough.

A streaming file source offers each file once, at first sight, so a file that
is still young when first listed would never be offered again; filtering by
age inside the stream loses it. The default form is therefore a tick: each
tick takes the current inventory, keeps files older than the age bound and
not yet in the ledger, and appends them to the ledger with the tick's clock.
Ticks are idempotent (the ledger anti-join), and the clock is a parameter, so
replays and tests are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.files import older_than
from strata.session import literal_ts, path_exists


def admit_tick(spark: SparkSession, inventory: DataFrame, ledger_path: str, hours: float,
               now: str, key: str = "path") -> DataFrame:
    """Admit files older than ``hours`` at clock ``now`` that the ledger does not
    hold; append them with ``admitted_at = now``. Returns the admitted rows."""
    eligible = older_than(inventory, hours, literal_ts(now)).select(key)
    if path_exists(spark, ledger_path):
        done = spark.read.parquet(ledger_path).select(key)
        eligible = eligible.join(done, key, "left_anti")
    fresh = eligible.distinct().withColumn("admitted_at", literal_ts(now))
    fresh.write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path).where(F.col("admitted_at") == literal_ts(now))


# ---------------------------------------------------------------- stateful form

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED_SCHEMA = "path STRING, mtime_ms BIGINT, admitted_ms BIGINT"


REMEMBER_HOURS = 24 * 30


def _age_gate(age_ms: int, remember_ms: int):
    """Build the per-path processor: admit at first sight when old enough,
    otherwise keep the modification time in state and fire a processing-time
    timer when the file comes of age. Each path is admitted once while it is
    remembered: the mark of an admitted path expires by the state's time to live."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class AgeGate(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.pending = handle.getValueState("pending", "mtime_ms BIGINT")
            self.done = handle.getValueState("done", "admitted_ms BIGINT", ttlDurationMs=remember_ms)

        def _emit(self, path, mtime_ms, now):
            self.done.update((now,))
            self.pending.clear()
            return pd.DataFrame({"path": [path], "mtime_ms": [mtime_ms], "admitted_ms": [now]})

        def handleInputRows(self, key, rows, timerValues):
            newest = max(int(pdf["mtime_ms"].max()) for pdf in rows)
            if self.done.exists():
                return
            now = timerValues.getCurrentProcessingTimeInMs()
            if newest + age_ms < now:  # strictly older than the age bound
                yield self._emit(key[0], newest, now)
                return
            if self.pending.exists():
                self.handle.deleteTimer(self.pending.get()[0] + age_ms + 1)
            self.pending.update((newest,))
            self.handle.registerTimer(newest + age_ms + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.done.exists() or not self.pending.exists():
                return
            yield self._emit(key[0], self.pending.get()[0], timerValues.getCurrentProcessingTimeInMs())

        def close(self):
            pass

    return AgeGate()


def admit_stream(stream: DataFrame, hours: float, path_col: str = "path",
                 mtime_col: str = "modificationTime", remember_hours: float = REMEMBER_HOURS) -> DataFrame:
    """Streaming age gate keyed by path (J2, stateful form).

    ``stream`` is a file listing stream (e.g. ``watch(..., 'binaryFile')``).
    Old-enough files pass at first sight; younger ones wait in keyed state for
    a processing-time timer, so a file that is young when first listed is not
    lost. State lives in the RocksDB state store (set on the session here if
    no provider is configured) and in the query checkpoint.

    An admitted path is remembered for ``remember_hours`` (processing time), so
    that state holds the files of that time and not all files ever seen. Let it
    be longer than the source can offer a path again (``maxFileAge``, one week by
    default): a path offered later passes once more. Waiting files stay until
    they are admitted.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or "HDFSBackedStateStoreProvider" in current:
        spark.conf.set(key, ROCKSDB_PROVIDER)
    keyed = stream.select(
        F.col(path_col).alias("path"),
        F.unix_millis(F.col(mtime_col).cast("timestamp")).alias("mtime_ms"),
    )
    return keyed.groupBy("path").transformWithStateInPandas(
        statefulProcessor=_age_gate(int(hours * 3600 * 1000), int(remember_hours * 3600 * 1000)),
        outputStructType=ADMITTED_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
