"""Top-k nearest neighbours by cosine similarity.

Exact search without materialising pairs: the query block (size-checked) is
broadcast to the executors; each task multiplies its slice of the collection
with the query block in numpy and keeps, per query, only its local top-k
(ties broken by the neighbour id). A final ``row_number`` over at most
(#tasks × k) candidates per query picks the global top-k. The collection is
scanned once per query block; when the queries exceed the broadcast bound they
are split into blocks by a hash of the query id and each block is written to
the result table in turn (a loop over block numbers, not over data). Scores are
computed in pieces of at most ``MAX_SCORE_CELLS``, whatever the sizes of block and batch: all
in float32 first, then those that can be among the best in float64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path

# Largest query block broadcast to the executors (bytes of float64 vectors).
MAX_QUERY_BLOCK_BYTES = 256 << 20
# Largest number of scores a task holds at a time.
MAX_SCORE_CELLS = 1 << 22

CAND_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("neighbor_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def hyperplane_signature(vec: Column, n_bits: int, seed: int, positions: Column | None = None) -> Column:
    """Random-hyperplane LSH bucket: bit j = sign of the projection on hyperplane j.

    Hyperplane coordinates are ±1 from xxhash64(seed, j, i); nothing is stored. Where ``positions``
    are not null, ``vec`` holds the values at them and the rest are zeros.
    """
    x = vec.cast("array<double>")

    def plane(j):
        return lambda x, i: x * F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(j), i), F.lit(2)) == 0,
                                       F.lit(1.0)).otherwise(F.lit(-1.0))

    total = F.lit(0)
    for j in range(n_bits):
        parts = F.transform(x, plane(j))
        if positions is not None:
            parts = F.when(positions.isNull(), parts).otherwise(F.zip_with(x, positions, plane(j)))
        proj = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
        total = total + F.when(proj >= 0, F.lit(1 << j)).otherwise(F.lit(0))
    return total.cast("int")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


NEG = np.int64(-(1 << 40))   # below any rounded cosine; marks excluded pairs


class Best:
    """The k best (score, id) of every query so far, in order; ids are compared as strings."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NEG, dtype=np.int64)
        self.id = np.full((queries, k), "", dtype=object)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores`` of the candidates ``ids`` (sorted, 1-D) to the queries ``rows``."""
        k = self.score.shape[1]
        hot = ((scores >= self.score[rows, -1:]) & (scores > NEG)).any(axis=1)
        rows, scores = rows[hot], scores[hot]
        if not len(rows):
            return
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]      # stable: ties keep the order of the ids
        s = np.concatenate([self.score[rows], np.take_along_axis(scores, top, axis=1)], axis=1)
        i = np.concatenate([self.id[rows], ids[top]], axis=1)
        _, name = np.unique(i.astype(str), return_inverse=True)
        order = np.lexsort((name.reshape(i.shape), -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.id[rows] = np.take_along_axis(i, order, axis=1)

    def merge_pairs(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer the candidate ``ids[i]`` with ``scores[i]`` to the query ``rows[i]`` (all 1-D, any order)."""
        k = self.score.shape[1]
        hot = np.unique(rows)
        r = np.concatenate([np.repeat(hot, k), rows])
        s = np.concatenate([self.score[hot].ravel(), scores])
        i = np.concatenate([self.id[hot].ravel(), ids])
        _, name = np.unique(i.astype(str), return_inverse=True)
        order = np.lexsort((name, -s, r))
        starts = np.searchsorted(r[order], hot)
        top = order[starts[:, None] + np.arange(k)]                  # a query has its k entries of before at least
        self.score[hot], self.id[hot] = s[top], i[top]


@dataclass(frozen=True)
class Probe:
    """Approximate search: a query meets the candidates whose ``bits`` signs of random projections
    differ from its own in at most ``flips``. ``flips = bits`` is the exact search."""

    bits: int = 8
    flips: int = 3
    seed: int = 7

    def codes(self, unit: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(self.seed).normal(size=(unit.shape[1], self.bits))
        return ((unit @ planes) >= 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def meets(self, query_codes: np.ndarray, code: int) -> np.ndarray:
        return np.flatnonzero(np.bitwise_count(query_codes ^ code) <= self.flips)


# Pairs whose exact score a task computes at a time.
EXACT_PAIRS = 1 << 16


def _same_ids(q_ids: np.ndarray, q_order: np.ndarray, q_sorted: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of the pairs with equal ids; ``q_sorted`` are the query ids as strings, in ``q_order``."""
    text = ids.astype(str)
    first, end = np.searchsorted(q_sorted, text), np.searchsorted(q_sorted, text, side="right")
    n = end - first
    rows = q_order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    columns = np.repeat(np.arange(len(ids)), n)
    same = q_ids[rows] == ids[columns]                               # a null id is no "None"
    return rows[same], columns[same]


def _local_topk(q_ids: np.ndarray, q_mat: np.ndarray, k: int, exclude_self: bool, places: int, cells: int,
                probe: Probe | None):
    """The best ``k`` of a task's candidates for each query.

    Scores are first computed in float32, whose error has a bound: a pair that even with it stays below the
    query's k-th score so far, or below the k-th of the piece, can't be among the best. Only the rest, some ``k``
    a query, are computed in float64, rounded and ranked.
    """
    scale = 10 ** places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(q_ids), k)
        everyone = np.arange(len(q_ids))
        q_codes = probe.codes(q_mat) if probe and len(q_ids) else None
        q_short = q_mat.astype(np.float32)
        slack = (q_mat.shape[1] + 8) * 2.0 ** -23                    # twice the bound for unit vectors
        q_order = np.argsort(q_ids.astype(str), kind="stable")
        q_sorted = q_ids.astype(str)[q_order]

        def offer(rows: np.ndarray, ids: np.ndarray, mat: np.ndarray) -> None:
            width = max(1, min(len(ids), cells))
            height = max(1, cells // width)                       # at most ``cells`` scores at a time
            short = mat.astype(np.float32)
            own = _same_ids(q_ids, q_order, q_sorted, ids) if exclude_self else (everyone[:0], everyone[:0])
            for c in range(0, len(ids), width):
                here = (own[1] >= c) & (own[1] < c + width)
                own_rows, own_columns = own[0][here], own[1][here] - c
                for a in range(0, len(rows), height):
                    part = rows[a:a + height]
                    at = np.minimum(np.searchsorted(part, own_rows), len(part) - 1)
                    inside = part[at] == own_rows
                    excluded = at[inside], own_columns[inside]
                    rough = q_short[part] @ short[c:c + width].T
                    rough[excluded] = -np.inf
                    kth = best.score[part, -1]
                    limit = (kth - 0.75) / scale - slack
                    new = np.flatnonzero(kth == NEG)
                    if len(new) and rough.shape[1] > k:
                        here_kth = np.partition(rough[new], rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
                        limit[new] = here_kth.astype(np.float64) - 2 * slack - 1.5 / scale
                    r, col = np.nonzero((rough >= limit[:, None].astype(np.float32)) & (rough > -np.inf))
                    if len(r) * 8 > rough.size and len(r) > EXACT_PAIRS:   # many equal scores
                        s = np.rint(np.round(q_mat[part] @ mat[c:c + width].T, places) * scale).astype(np.int64)
                        s[excluded] = NEG
                        best.merge(part, s, ids[c:c + width])
                        continue
                    for p in range(0, len(r), EXACT_PAIRS):
                        x, y = part[r[p:p + EXACT_PAIRS]], c + col[p:p + EXACT_PAIRS]
                        s = np.rint(np.round(np.einsum("ij,ij->i", q_mat[x], mat[y]), places) * scale).astype(np.int64)
                        best.merge_pairs(x, s, ids[y])

        for pdf in batches:
            if len(pdf) == 0 or len(q_ids) == 0:
                continue
            ids = pdf["id"].to_numpy(dtype=object)
            order = np.argsort(ids.astype(str), kind="stable")
            ids, mat = ids[order], _unit_rows(np.vstack(pdf["vector"].to_numpy()[order]).astype(np.float64))
            finite = np.isfinite(mat).all(axis=1)
            if not finite.all():                                     # such a vector has no score
                ids, mat = ids[finite], mat[finite]
            if probe is None:
                offer(everyone, ids, mat)
                continue
            codes = probe.codes(mat)
            for code in np.unique(codes):
                at = np.flatnonzero(codes == code)
                offer(probe.meets(q_codes, code), ids[at], mat[at])
        r, c = np.nonzero(best.score > NEG)
        yield pd.DataFrame({"query_id": q_ids[r] if len(r) else np.array([], dtype=object),
                            "neighbor_id": best.id[r, c] if len(r) else np.array([], dtype=object),
                            "score": best.score[r, c] / scale if len(r) else np.array([], dtype=np.float64)})
    return run


def _block(queries_pdf: pd.DataFrame, collection: DataFrame, k: int, exclude_self: bool, places: int,
           probe: Probe | None) -> DataFrame:
    q_ids = queries_pdf["id"].to_numpy(dtype=object)
    q_mat = _unit_rows(np.vstack(queries_pdf["vector"].to_numpy()).astype(np.float64)) if len(q_ids) else \
        np.zeros((0, 0))
    cands = collection.select("id", "vector").mapInPandas(
        _local_topk(q_ids, q_mat, k, exclude_self, places, MAX_SCORE_CELLS, probe), CAND_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("neighbor_id"))
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_topk(queries: DataFrame, collection: DataFrame, k: int = 10, exclude_self: bool = False,
             places: int = 6, probe: Probe | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, score) for every query; both inputs have (id string, vector array).

    Exact unless ``probe`` asks for the approximate search (see :class:`Probe`).

    Scores are cosine similarities rounded to ``places`` before ranking, so
    ties are resolved by neighbour id identically everywhere.
    """
    spark = queries.sparkSession
    q = queries.select(F.col("id").cast("string"), F.col("vector").cast("array<double>"))
    n_q = q.count()
    dim = len((q.first() or [None, []])[1] or []) if n_q else 0
    per_query = max(1, dim * 8 + 64)
    block_rows = max(1, MAX_QUERY_BLOCK_BYTES // per_query)
    coll = collection.select(F.col("id").cast("string"), F.col("vector").cast("array<double>"))
    if n_q <= block_rows:
        return _block(q.toPandas(), coll, k, exclude_self, places, probe)
    n_blocks = -(-n_q // block_rows)
    out = fresh_path(spark, "knn")
    for b in range(n_blocks):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()
        _block(part, coll, k, exclude_self, places, probe).write.mode("append").parquet(out)
    return spark.read.parquet(out)
