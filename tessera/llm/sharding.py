"""Shards by minimax contiguous partition of atomic groups.

Groups are the sets of equal texts; they are never divided. A document's size is its
UTF-8 bytes (null: none) plus 1, a group's the sum. Groups stand in the order of a
128-bit hash of the text; shards are contiguous runs of that order, cut so that
the largest shard is as small as any such cut can make it. The smallest feasible
capacity is found by binary search; a capacity is feasible if greedy filling
needs no more than the given number of shards. Under that capacity the cuts are
put next to even shares, so that one huge group leaves the others level. The
law kept is ``bytes``.

At scale the ordered groups never meet in one place. They are first
summed in 2**16 bins of the leading hash bits. Greedy runs over the bins give
bounds of the capacity and, for every cut, the few bins in which it can fall;
only those bins are divided further by the next bits (down to groups, if needed),
so the driver holds a bounded table and the result is exactly that of the full
list of groups.

Cases: null and empty texts are one group of size 1 a row (a null counts as an empty
text); repeated rows are one group; null ids are placed like others; fewer groups than shards leave shards
empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import ordinal_within
from .frames import staged

SHARDS = 16
BIN_BITS = 16
SPLIT_BITS = 10


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Ends of greedily filled shards over ordered sizes, or None if ``shards`` don't suffice."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    for _ in range(shards):
        nxt = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if nxt == at and at < len(sizes):
            return None
        at = nxt
        ends.append(at)
        if at == len(sizes):
            return np.array(ends + [at] * (shards - len(ends)))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search for the smallest capacity that greedy filling can keep."""
    if not len(sizes):
        return 0
    lo, hi = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def balanced_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Ends of the shards: none above the capacity, each as near an even share of what is left as that allows."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    for left in range(shards, 0, -1):
        far = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        share = total[at] + (total[-1] - total[at]) / left
        near = int(np.searchsorted(total, share, side="left"))
        if near > at + 1 and share - total[near - 1] < total[min(near, len(sizes))] - share:
            near -= 1
        end = min(far, max(near, min(at + 1, len(sizes))))
        if greedy_cuts(sizes[end:], capacity, left - 1) is None and end < len(sizes):
            end = far
        ends.append(end)
        at = end
    return np.array(ends)


def _reach(sizes: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Boolean per interval: a greedy cut of some capacity in [low, high] may fall inside it.

    Intervals hold several groups; a cut can fall anywhere in them.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(sizes), dtype=bool)
    first, last = 0, 0  # prefix sums between which the previous cut lies
    for _ in range(shards):
        a = int(np.searchsorted(total, first + low, side="right")) - 1   # the interval where the earliest cut falls
        b = int(np.searchsorted(total, last + high, side="right")) - 1   # and the latest
        a, b = min(a, len(sizes) - 1), min(b, len(sizes) - 1)
        marked[a:b + 1] = True
        first, last = int(total[a]), min(last + high, int(total[-1]))
    return marked


def _grouped(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))


class Interval:
    """A run of the hash order: from its first value of (k1, k2); atomic if it holds a single group."""

    __slots__ = ("k1", "shift", "bytes", "groups", "largest", "k2")

    def __init__(self, k1, shift, bytes_, groups, largest, k2=None):
        self.k1, self.shift, self.bytes, self.groups, self.largest, self.k2 = k1, shift, bytes_, groups, largest, k2


def _bins(groups: DataFrame, shift: int) -> DataFrame:
    return groups.groupBy(F.shiftright("k1", shift).alias("bin")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest"))


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], int]:
    """First (k1, k2) of shards 1, 2, ... that have any, and the largest shard's size.

    ``groups`` has k1, k2 (signed longs, the order) and bytes.
    """
    shift = 64 - BIN_BITS
    spans = [Interval(r["bin"] << shift, shift, r["bytes"], r["n"], r["largest"])
             for r in _bins(groups, shift).orderBy("bin").collect()]
    while True:
        sizes = np.array([s.bytes for s in spans], dtype=np.int64)
        if not len(sizes):
            return [], 0
        low = max(max(s.largest for s in spans), -(-int(sizes.sum()) // shards))
        # with intervals taken whole, an upper bound; every group below the true minimum is no larger than ``largest``
        high = smallest_capacity(sizes, shards)
        open_ = [i for i in np.flatnonzero(_reach(sizes, low, high, shards)) if spans[i].groups > 1]
        if not open_:
            ends = balanced_cuts(sizes, high, shards)  # no cut can fall inside an interval, so ``high`` is exact
            starts = sorted({int(e) for e in ends[:-1] if e < len(spans)})
            return [(spans[i].k1, spans[i].k2) for i in starts], high
        spans = _divided(groups, spans, open_)


def _divided(groups: DataFrame, spans: list[Interval], open_: list[int]) -> list[Interval]:
    """Replace the open intervals by their parts of the next SPLIT_BITS bits (by single groups at the end)."""
    spark = groups.sparkSession
    chosen = [(int(spans[i].k1), int(spans[i].shift), int(i)) for i in open_]
    parts: dict[int, list[Interval]] = {i: [] for i in open_}
    for shift in sorted({s for _, s, _ in chosen}):
        rows = [(k >> shift, i) for k, s, i in chosen if s == shift]
        marked = groups.withColumn("bin", F.shiftright("k1", shift)).join(
            F.broadcast(spark.createDataFrame(rows, "bin long, at long")), "bin")
        fewest = sum(spans[i].groups for _, i in rows)
        if shift == 0 or fewest <= 1 << 16:  # few enough to list
            for r in marked.select("at", "k1", "k2", "bytes").orderBy("k1", "k2").collect():
                parts[r["at"]].append(Interval(r["k1"], 0, r["bytes"], 1, r["bytes"], r["k2"]))
        else:
            below = max(0, shift - SPLIT_BITS)
            for r in (marked.groupBy("at", F.shiftright("k1", below).alias("sub"))
                      .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest"))
                      .orderBy("sub").collect()):
                parts[r["at"]].append(Interval(r["sub"] << below, below, r["bytes"], r["n"], r["largest"]))
    out = []
    for i, s in enumerate(spans):
        out += parts.get(i, [s])
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = staged(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")), "sized")
    groups = staged(_grouped(keyed), "groups")
    cuts, _ = cut_keys(groups, shards)
    place = F.lit(0)
    for k1, k2 in cuts:  # one comparison for each of the few cuts
        after = F.col("k1") >= k1 if k2 is None else (F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))
        place = place + after.cast("int")
    placed = keyed.withColumn("shard", place.cast("int"))
    return ordinal_within(placed, ["shard"], ["k1", "k2", "doc_id"], out_col="slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
