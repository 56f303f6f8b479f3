"""The token gate as a stream: token jobs wait for tokenisation, with timers.

A job that reports WAITING is checked every ``wait_seconds``; the first check that finds its
tokenisation ready lets it go on, the ``checks``-th fails it whatever it finds.
``transformWithState`` keeps two numbers a job (when it began to wait, when it became ready)
and two timers: one at the check that lets it go on, set when readiness arrives, and one at
the last check. Nothing polls between them.

The clock is either the processing time (live use) or the event time (``clock="event"``: a watermark
of ``delay``; timers fire when it passes them), so the same events give the decisions of
:func:`tessera.streaming.jobs.token_gate`, whatever the micro-batches and restarts. Under the processing clock Spark always has a next
batch to run, so such a stream takes a trigger of an interval (or ``once``), not ``availableNow``.

Late rows: a WAITING row of a job that already waits changes nothing, and so does any row
after the decision; under the event clock, rows behind the watermark are dropped. Within a
micro-batch rows may come in any order. Null job ids are one job.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import from_micros, micros
from ..schema import MSG_TOKEN_TIMEOUT, TOKEN_WAIT_CHECKS, TOKEN_WAIT_SECONDS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "job_id string, state string, checks long, t0_us long, ready_us long, at_us long, message string"


class Gate(StatefulProcessor):
    """Waiting, ready and decided jobs; emits a row when a job enters WAITING and one when it is decided."""

    def __init__(self, wait_us: int, checks: int):
        self.wait_us, self.checks = wait_us, checks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "t0 long, ready long, decided boolean")

    def _row(self, key, state, checks, t0, ready, at, message=None) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "state": [state], "checks": pd.array([checks], "Int64"),
                             "t0_us": [t0], "ready_us": pd.array([ready], "Int64"), "at_us": [at], "message": [message]})

    def _timer(self, us: int) -> int:
        return -(-us // 1000)  # timers are in milliseconds; not before the moment itself

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun, became = [], []
        for piece in rows:  # of a job's rows only their times are held
            us = piece["us"].to_numpy()
            is_wait = (piece["state"] == "WAITING").to_numpy()
            begun += [us[is_wait].min()] if is_wait.any() else []
            became.append(us[(piece["state"] == "ENCODING").to_numpy()])
        if self.waiting.exists():
            t0, ready, decided = self.waiting.get()
        elif begun:
            t0, ready, decided = int(min(begun)), None, False
            self.handle.registerTimer(self._timer(t0 + self.checks * self.wait_us))
            yield self._row(key, "WAITING", 0, t0, None, t0)
        else:
            return
        later = [int(x[x > t0].min()) for x in became if (x > t0).any()]
        if not decided and ready is None and later:
            ready = min(later)
            check = math.ceil((ready - t0) / self.wait_us)
            if check < self.checks:
                self.handle.registerTimer(self._timer(t0 + check * self.wait_us))
        self.waiting.update((t0, ready, decided))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t0, ready, decided = self.waiting.get()
        if decided:
            return
        self.waiting.update((t0, ready, True))
        check = self.checks if ready is None else math.ceil((ready - t0) / self.wait_us)
        if check < self.checks:
            yield self._row(key, "ENCODING", check, t0, ready, t0 + check * self.wait_us)
        else:
            yield self._row(key, "FAILED", self.checks, t0, ready, t0 + self.checks * self.wait_us, MSG_TOKEN_TIMEOUT)

    def close(self) -> None:
        pass


def token_gate_stream(events: DataFrame, wait_seconds: int = TOKEN_WAIT_SECONDS, checks: int = TOKEN_WAIT_CHECKS,
                      clock: str = "processing", delay: str = "0 seconds") -> DataFrame:
    """State changes (job_id, state, checks, t0, ready_at, decided_at, message) of an (job_id, ts, state) event stream.

    ``state`` is WAITING when a job enters the gate and ENCODING or FAILED when it leaves; FAILED rows bring
    the message for its owner.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    # the worker that checks the processor on the driver does not get the shipped package: send the class itself
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # wall-clock times are read as UTC, whatever the session's zone
    rows = events.select("job_id", "state", micros("ts").alias("us")).withColumn("moment", F.timestamp_micros("us"))
    if clock == "event":
        rows = rows.withWatermark("moment", delay)
    out = rows.groupBy("job_id").transformWithStateInPandas(
        Gate(wait_seconds * 1_000_000, checks), outputStructType=DECISIONS, outputMode="append",
        timeMode="ProcessingTime" if clock == "processing" else "EventTime")
    return out.select("job_id", "state", "checks", from_micros(F.col("t0_us")).alias("t0"),
                      from_micros(F.col("ready_us")).alias("ready_at"), from_micros(F.col("at_us")).alias("decided_at"), "message")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decided jobs of a gate stream's output, in the columns of the batch rule and the message."""
    return spark.read.parquet(path).where("state <> 'WAITING'").select(
        "job_id", "t0", F.when(F.col("state") == "ENCODING", F.col("ready_at")).alias("ready_at"),
        F.col("state").alias("outcome"), "checks", "decided_at", "message")
