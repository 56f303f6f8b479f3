"""Hash-derived values: feature-hash buckets and signs, job seeds.

Buckets and signs come from ``md5(term)`` hex digits, so the same numbers can
be recomputed by any SQL engine (and by ``hashlib`` inside a Python worker).
The PCA sketch signs use the bits of ``md5(seed:term)`` (see operators.pca).
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HASH_DIM


def job_seed(name: str) -> int:
    """Seed of a job: adler32 of its name (computed once, on the driver)."""
    return zlib.adler32(bytes(name or "", "utf-8"))


def hash_bucket(term: Column, dim: int = HASH_DIM) -> Column:
    """Bucket = first 8 hex digits of md5(term), as an integer, modulo dim."""
    return bucket_of_hex(F.md5(term), dim)


def bucket_of_hex(hexes: Column, dim: int = HASH_DIM) -> Column:
    return F.pmod(F.conv(F.substring(hexes, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hash_sign(term: Column) -> Column:
    """+1 or -1 from the 9th hex digit of md5(term) (< 8 gives +1)."""
    digit = F.conv(F.substring(F.md5(term), 9, 1), 16, 10).cast("int")
    return F.when(digit < 8, F.lit(1.0)).otherwise(F.lit(-1.0))


def py_bucket_sign(term: str, dim: int = HASH_DIM) -> tuple[int, float]:
    """The same bucket and sign, for Python workers."""
    h = hashlib.md5(term.encode("utf-8")).hexdigest()
    return int(h[:8], 16) % dim, (1.0 if int(h[8], 16) < 8 else -1.0)
