"""Exact top-k by block-at-a-time pruning.

Every component x of a vector becomes floor(64 * x); a vector's components are its
terms. A task cuts its candidates into ranges, and a range into blocks of ``BLOCK``
rows, each with its forward index (the rows' terms) and the largest and smallest value of every
term. A query's bound in a block is the sum over its terms of the larger of its weight times
either. A query visits blocks in descending bound and stops when the bound is
below its k-th score so far; blocks equal to it are still visited, for the ties.

Scores are exact integers: where a block's could reach 2**53, they are summed in 64-bit integers instead of
doubles. Scores beyond 2**62, which a long may not hold, are refused with an error, never rounded.

Queries are taken in blocks of at most ``QUERY_BLOCK`` vectors, broadcast one after
another; each task returns at most k rows for a query, which are written before the next block's
broadcast, and a window over all of them merges them.

Cases: vectors that are null, or hold null or non-finite components, take no part;
rows without an id neither; a shorter vector's missing terms are 0; rows with a query's
own id are not its candidates; an id that repeats is one query (its smallest vector)
but each of its rows is a candidate; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path

K = 20
BLOCK = 256
RANGE = 1 << 14
QUERY_BLOCK = 1 << 13
SCALE = 64
EXACT, LARGEST = 2.0 ** 53, 2.0 ** 62
FOUND = "query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", lambda x: F.coalesce(bad(x), F.lit(True))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """floor(64 x) as float64 (exact); rows padded or cut to ``width`` terms."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = col < width
    out[row[ok], col[ok]] = flat[ok]
    return out


class Best:
    """The k best (score, id) of every query so far, in order."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE, dtype=np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        hot = (scores >= self.score[rows, -1][:, None]) & (scores != NONE)
        some = np.flatnonzero(hot.any(axis=1))
        if not len(some):
            return
        rows, scores = rows[some], np.where(hot[some], scores[some], NONE)
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s descends without overflow
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.id[rows] = np.take_along_axis(i, order, axis=1)


def _scores(q: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
    """Exact inner products of integer rows."""
    about = q @ v.T
    if reach < EXACT:
        return about.astype(np.int64)
    if max(np.abs(about).max(), np.abs(q).max(), np.abs(v).max()) >= LARGEST:
        raise ValueError("a score or a component is beyond 2**62: a long does not hold such scores")
    return q.astype(np.int64) @ v.astype(np.int64).T  # wraps on the way at most, not in the end


def search_range(best: Best, q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray) -> int:
    """Let all queries visit the blocks of one range; returns the number of (query, block) visits."""
    cuts = range(0, len(v), BLOCK)
    high = np.stack([v[a:a + BLOCK].max(axis=0) for a in cuts])
    low = np.stack([v[a:a + BLOCK].min(axis=0) for a in cuts])
    reach = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T  # no sum of a block's terms is larger, in any order
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bound = np.where(reach < EXACT, bound, bound + reach * (q.shape[1] + 2) * 2.0 ** -52)  # doubles round there
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q))
    visits = 0
    for turn in range(order.shape[1]):
        block = order[live, turn]
        stay = bound[live, block] >= best.score[live, -1]  # bounds only fall: who stops here stops for good
        live, block = live[stay], block[stay]
        if not len(live):
            break
        visits += len(live)
        for b in np.unique(block):
            rows = live[block == b]
            a = int(b) * BLOCK
            scores = _scores(q[rows], v[a:a + BLOCK], float(reach[rows, b].max()))
            scores[q_ids[rows][:, None] == ids[None, a:a + BLOCK]] = NONE
            best.merge(rows, scores, ids[a:a + BLOCK])
    return visits


def _query_blocks(queries: DataFrame, size: int):
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).orderBy("id").collect()
        for lo in range(0, len(rows), size):
            part = rows[lo:lo + size]
            width = max(len(r["v"]) for r in part)
            yield (np.array([r["id"] for r in part], dtype=np.int64),
                   _matrix(pa.array([r["v"] for r in part], type=pa.list_(pa.float64())), width))


def top_k(vectors: DataFrame, every: int = 20, k: int = K, *, id_col: str = "vec_id", vec_col: str = "embedding",
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vec_col)
    queries = usable.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    path = fresh_path(spark, "top-k")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for q_ids, q in _query_blocks(queries, query_block):
        shared = spark.sparkContext.broadcast((q_ids, q))
        _one_block(usable, shared, k).write.mode("append").parquet(path)
        shared.destroy()
    out = spark.read.schema(FOUND).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_block(usable: DataFrame, shared, k: int) -> DataFrame:
    def run(batches):
        q_ids, q = shared.value
        best = Best(len(q_ids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, RANGE):
                part = batch.slice(lo, RANGE)
                search_range(best, q, q_ids, _matrix(part.column(1), q.shape[1]), part.column(0).to_numpy())
        found = best.score != NONE
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, found.sum(axis=1))), pa.array(best.id[found]),
                                          pa.array(best.score[found])], names=["query_id", "vec_id", "score"])

    return usable.mapInArrow(run, FOUND)
