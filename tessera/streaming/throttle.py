"""Per-key throttle: pass a row only if more than ``period`` passed since the last *passed* row of its key.

Suppressed rows do not move the clock; the first row of a key always passes.
Rows are taken in (ts, id) order; a row whose ts is not later than the last
passed ts plus the period is suppressed wherever it arrives (late rows too).

The rule depends on its own output, so no window frame expresses it. It is a walk: every row has
one *successor*, the first row of its key more than a period later, and the rows that pass are those
the walk from the key's first row meets.

Batch form: keys are dealt by hash and walked where they are, but for *hot* keys, those with more than
a partition's even share of all rows (and than ``SPLIT_ROWS``). Rows of hot keys are
range-partitioned by (key, ts, id), so each lies in many partitions, as *segments*. The walk
of a hot key can enter a segment only within a period after its first row: each such
entry is followed through its segment (all segments at once), which leads to an entry of a
later one. These links are doubled until they end (as often as the number
of segments has binary digits), which tells each segment where the walk enters it;
then all segments are walked at once, too. Only the list of segments, a few
a partition, is known to every task.

Stream form: ``applyInPandasWithState`` keyed by the same key, the state being the last passed
timestamp. Late rows of a later micro-batch are measured against it like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import micros
from ..session import fresh_path

SPLIT_ROWS = 1_000_000  # a key of fewer rows is never split


def _to_micros(col: str):
    return micros(col)


def _staged(df: DataFrame, tag: str) -> DataFrame:
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walk(us: np.ndarray, first: int, period_us: int) -> np.ndarray:
    """Positions that pass among ascending times, from position ``first`` on."""
    out, i = [], first
    while i < len(us):
        out.append(i)
        i = int(np.searchsorted(us, us[i] + period_us, side="right"))
    return np.array(out, dtype=np.int64)


def walk_ends(us: np.ndarray, period_us: int) -> np.ndarray:
    """For each of ascending times, the last time that the walk from there meets."""
    n = len(us)
    after = np.searchsorted(us, us + period_us, side="right")
    step = np.where(after < n, after, np.arange(n))
    while True:  # pointer doubling
        twice = step[step]
        if (twice == step).all():
            return us[step]
        step = twice


def _scan(key: str, period_us: int):
    """Keep the rows that pass; whole keys come one after the other, rows in order, in pieces of any size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None  # one open key (null keys are one key)
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            null, keys, us = pdf[key].isna().to_numpy(), pdf[key].to_numpy(), pdf["_us"].to_numpy()
            new = (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (keys[1:] != keys[:-1]))
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                k = (null[lo], None if null[lo] else keys[lo])
                first = int(np.searchsorted(us[lo:hi], last + period_us, side="right")) if k == current else 0
                met = walk(us[lo:hi], first, period_us)
                keep[lo + met] = True
                if len(met):
                    last = us[lo + met[-1]]
                current = k
            yield pdf[keep]
    return run


def segments(df: DataFrame, key: str, ts: str, id_col: str, num_partitions: int) -> DataFrame:
    """The rows with their time in microseconds and the number of their range, written once (which fixes the ranges)."""
    return _staged(df.withColumn("_us", _to_micros(ts)).repartitionByRange(num_partitions, key, "_us", id_col)
                   .withColumn("_segment", F.spark_partition_id()), "throttle")


def _entries(bounds, period_us: int):
    """Where the walk goes from each time at which it can enter a segment: (key number, segment, entry, next, bound)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["_us"].to_numpy())
        number, segment = int(pdf["_number"].iloc[0]), int(pdf["_segment"].iloc[0])
        ends = walk_ends(us, period_us)
        entry, at = np.unique(us, return_index=True)
        # the walk's last time before is not after the segment's first: it enters up to the first row beyond a period
        can = slice(0, int(np.searchsorted(entry, us[0] + period_us, side="right")) + 1)
        bound = ends[at[can]] + period_us
        of_segment, last = bounds.value[number]
        k = np.searchsorted(last, bound, side="right")  # the first segment that has a later row
        follows = np.where(k < len(last), of_segment[np.minimum(k, len(last) - 1)], -1)
        return pd.DataFrame({"number": number, "segment": segment, "entry": entry[can], "next": follows, "bound": bound})
    return run


def _links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Bounds that lead to a segment, as its first entries beyond them."""
    entry = np.sort(right["entry"].to_numpy())
    to = entry[np.searchsorted(entry, left["bound"].to_numpy(), side="right")] if len(left) else entry[:0]
    return pd.DataFrame({"number": left["number"], "segment": left["segment"], "entry": left["entry"],
                         "to_segment": left["next"], "to_entry": to})


def _met(links: DataFrame, starts: DataFrame) -> DataFrame:
    """All (number, segment, entry) that walks along ``links`` from ``starts`` meet, by pointer doubling."""
    at = ["number", "segment", "entry"]
    to = F.col("to_segment").alias("segment"), F.col("to_entry").alias("entry")
    onward = [F.col("number"), F.col("segment").alias("to_segment"), F.col("entry").alias("to_entry"),
              F.col("to_segment").alias("far_segment"), F.col("to_entry").alias("far_entry")]
    while not links.isEmpty():
        starts = _staged(starts.unionByName(starts.join(links, at).select("number", *to)).distinct(), "throttle-met")
        links = _staged(links.join(links.select(*onward), ["number", "to_segment", "to_entry"]).select(
            *at, F.col("far_segment").alias("to_segment"), F.col("far_entry").alias("to_entry")), "throttle-links")
    return starts


def throttle_by_key(df: DataFrame, key: str, ts: str, id_col: str, period_seconds: int,
                    num_partitions: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows of ``df`` that pass the throttle (same columns)."""
    period_us = int(period_seconds) * 1_000_000
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(key).alias("_key")).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    least = max(split_rows, (total or 0) // n)
    scan = _scan(key, period_us)

    def walked(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_us", _to_micros(ts)).repartition(n, key).sortWithinPartitions(key, "_us", id_col)
        return placed.mapInPandas(scan, placed.schema).drop("_us")

    if (most or 0) <= least:
        return walked(df)
    hot = _staged(counts.where(F.col("count") > least).select("_key"), "throttle-keys")  # fewer than n keys
    is_hot = df[key].eqNullSafe(hot["_key"])
    return walked(df.join(F.broadcast(hot), is_hot, "left_anti")).unionByName(
        _walked_in_segments(df.join(F.broadcast(hot), is_hot, "left_semi"), key, ts, id_col, period_us, n))


def _walked_in_segments(df: DataFrame, key: str, ts: str, id_col: str, period_us: int, n: int) -> DataFrame:
    """The rows of few keys with many rows that pass."""
    spark = df.sparkSession
    rows = segments(df, key, ts, id_col, n)
    spans = rows.groupBy(key, "_segment").agg(F.min("_us").alias("first"), F.max("_us").alias("last"))
    found = spans.groupBy(F.col(key).alias("_key")).agg(
        F.collect_list(F.struct("_segment", "first", "last")).alias("spans")).collect()  # 2 n segments at most
    listed = [sorted(map(tuple, r["spans"])) for r in found]
    numbers = spark.createDataFrame(
        [(r["_key"], i, s[0]) for i, (r, spans) in enumerate(zip(found, listed)) for s in spans],
        T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_number", T.IntegerType()),
                      T.StructField("_of", T.IntegerType())]))
    here = [rows[key].eqNullSafe(numbers["_key"]), rows["_segment"] == numbers["_of"]]
    split = _staged(rows.join(F.broadcast(numbers), here).drop("_key", "_of"), "throttle-split")
    bounds = spark.sparkContext.broadcast([(np.array([s[0] for s in spans]), np.array([s[2] for s in spans])) for spans in listed])
    entries = _staged(split.select("_number", "_segment", "_us").groupBy("_number", "_segment").applyInPandas(
        _entries(bounds, period_us), "number int, segment int, entry long, next int, bound long"), "throttle-entries")
    links = entries.where("next >= 0").groupBy("number", "next").cogroup(entries.groupBy("number", "segment")).applyInPandas(
        _links, "number int, segment int, entry long, to_segment int, to_entry long")
    starts = spark.createDataFrame([(i, spans[0][0], spans[0][1]) for i, spans in enumerate(listed)],
                                   "number int, segment int, entry long")
    met = _met(_staged(links, "throttle-links"), starts)
    names = df.columns

    def follow(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["_us", id_col], kind="stable")
        us = left["_us"].to_numpy()
        if not len(right):
            return left.iloc[:0][names]
        return left.iloc[walk(us, int(np.searchsorted(us, right["entry"].iloc[0], side="left")), period_us)][names]

    return split.groupBy("_number", "_segment").cogroup(met.groupBy("number", "segment")).applyInPandas(follow, df.schema)


def throttle_stream(stream: DataFrame, key: str, ts: str, id_col: str, period_seconds: int) -> DataFrame:
    """Streaming throttle: state per key is the last passed timestamp (microseconds)."""
    period_us = int(period_seconds) * 1_000_000
    staged = stream.withColumn("_us", _to_micros(ts))
    out_schema = staged.schema
    state_schema = T.StructType([T.StructField("last_us", T.LongType())])

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", id_col], kind="stable")
        keep = np.zeros(len(pdf), dtype=bool)
        for i, t in enumerate(pdf["_us"].to_numpy()):
            if last is None or t - last > period_us:
                last = int(t)
                keep[i] = True
        if last is not None:
            state.update((last,))
        yield pdf[keep]

    return (staged.groupBy(key)
            .applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
            .drop("_us"))
