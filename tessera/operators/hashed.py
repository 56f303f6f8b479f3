"""Signed feature hashing of words (the offline stand-in for a model embedder).

Bucket and sign of a word come from its md5 (see ``functions.hashing``);
a unit's vector is the sum of signs per bucket, L2-normalised. Everything is a
JVM expression over the unit's own row, so it needs no fitted state and no shuffle.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of_hex, py_bucket_sign
from ..functions.text import run_end, run_starts, words
from ..session import spread
from ..schema import HASH_DIM, WORD_PATTERN

UNIT_KEYS = ["job_id", "record_id", "sub_key"]


def hashed_embed(units: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Sparse (job_id, record_id, sub_key, position, value) of hashed, normalised word counts.

    Everything happens inside the unit's row: words become codes (twice the bucket, plus
    1 for a positive sign), sorted codes are summed by bucket, and the norm is taken
    over those sums. Nothing is shuffled.
    """
    codes = F.col("_codes")

    def code(hexes):
        return bucket_of_hex(hexes, dim) * 2 + (F.substring(hexes, 9, 1) < "8").cast("int")

    def bucket(c):
        return F.shiftright(c, 1)

    def summed(a, i):
        part = F.slice(codes, a + 1, run_end("_starts", i, codes) - a)
        total = F.aggregate(part, F.lit(0.0), lambda acc, c: acc + (c.bitwiseAND(F.lit(1)) * 2 - 1))
        return F.struct(bucket(F.get(codes, a)).alias("position"), total.alias("v"))

    rows = spread(units).select(*UNIT_KEYS, F.sort_array(F.transform(F.transform(words(F.col("text")), F.md5), code)).alias("_codes"))
    rows = rows.select(*UNIT_KEYS, "_codes", run_starts(codes, bucket).alias("_starts"))
    rows = rows.select(*UNIT_KEYS, F.transform("_starts", summed).alias("_sums"))
    norm = F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda acc, e: acc + e["v"] * e["v"]))
    rows = rows.select(*UNIT_KEYS, "_sums", norm.alias("_norm"))
    # inline() of an expression, not of a column: for a column the optimizer would infer a filter on its
    # size and push that, with all the expressions above written out, below the projections
    value = lambda e: F.when(F.col("_norm") > 0, e["v"] / F.col("_norm")).otherwise(F.lit(0.0))
    return rows.select(*UNIT_KEYS, F.inline(F.transform("_sums", lambda e: F.struct(
        e["position"].alias("position"), value(e).alias("value")))))


CACHED_WORDS = 1_000_000
_WORD = regex.compile(WORD_PATTERN)


def hashed_model(dim: int = HASH_DIM):
    """Factory of the built-in model function: texts -> (n, dim) float64 matrix.

    Same numbers as :func:`hashed_embed`, computed in the Python worker; this is
    the default model of ``model_embed`` when no provider function is given.
    """
    cache: dict[str, int] = {}     # twice the bucket, plus 1 for a positive sign; at most CACHED_WORDS, then started anew

    def embed(texts: list[str]) -> np.ndarray:
        words, lens = [], []
        for t in texts:
            found = _WORD.findall(t.lower()) if t else []
            words += found
            lens.append(len(found))
        codes = []
        for w in words:
            code = cache.get(w)
            if code is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                bucket, sign = py_bucket_sign(w, dim)
                code = cache[w] = 2 * bucket + (sign > 0)
            codes.append(code)
        code = np.array(codes, dtype=np.int64)
        at = np.repeat(np.arange(len(texts)) * dim, lens) + (code >> 1)
        out = np.bincount(at, weights=2.0 * (code & 1) - 1, minlength=len(texts) * dim).reshape(len(texts), dim)
        # sums of whole numbers: exact in any order
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm > 0, norm, 1.0)[:, None]

    return embed
