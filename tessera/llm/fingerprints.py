"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its terms are its words (runs without ASCII white space, A-Z
lower-cased), their weights how often they occur. For every sample k a term of weight w
draws r and c from Gamma(2, 1) and b from [0, 1), all fixed by (term, k), and sets
``t = floor(ln w / r + b)`` and ``ln a = ln c - r * (t - b) - r``; the term with the least
a is the sample, known by (term, t). Two sets have the same sample with
probability sum(min weights) / sum(max weights), the generalised Jaccard similarity, so
the share of equal samples (``likeness``) estimates it with a standard error of at
most 0.5 / sqrt(samples).

A fingerprint keeps 16 bits of each sample, as 4 hex digits. All draws come from tables of
rounded logarithms and from sums and products in single precision, so the same text gives
the same fingerprint on every machine.

``fingerprints`` adds a fingerprint to each row of any table. ``with_successors`` also
compares each text with an edited one and with the next document's: rows are dealt by ranges of the id
(bounds taken from the ids alone), and the first rows of a range go to the range before it as
well, so texts cross the shuffle once and no range grows with the corpus.

Cases: null and empty texts have no terms and the fingerprint of zeros, alike among
themselves (likeness 1), unlike any other; documents are in the order of their ids,
equal ids in the order of their texts, null ids first; a single document is its own
successor; an empty table gives no rows; other columns are not read; repeated rows stay.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import shuffle_width

SAMPLES = 128
KEPT_TERMS = 1 << 16       # terms whose draws a worker keeps: at most 128 MB
PART_CHARS = 1 << 20       # long texts are counted in parts of this many characters
RANGE_BYTES = 8 << 20      # text of a range of documents, about
# -ln of the middles of 65536 equal parts of (0, 1), in single precision
_EXPONENTIAL = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], dtype=np.uint64)


def _logarithm(c: np.ndarray) -> np.ndarray:
    """Logarithm of single-precision numbers, rounded from double precision."""
    return np.log(c, dtype=np.float64).astype(np.float32)


class Sampler:
    """Signatures of weighted term sets; keeps the draws of the terms it has met."""

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT_TERMS):
        self.samples, self.kept = samples, kept
        self.rows: dict[bytes, int] = {}
        self.hash = np.zeros(kept, dtype=np.uint64)
        # per term: r, ln c - r, b, and ln a at weight 1 (where t is 0)
        self.r, self.base, self.b, self.once = (np.zeros((kept, samples), dtype=np.float32) for _ in range(4))
        with np.errstate(over="ignore"):
            seeds = _mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.seeds = seeds[:samples], seeds[samples:samples + -(-samples // 4)]

    def _learn(self, terms: list[bytes]) -> None:
        """Draws of new terms (no more than ``kept``), after forgetting all where there is no room."""
        if len(self.rows) + len(terms) > self.kept:
            self.rows.clear()
        at = slice(len(self.rows), len(self.rows) + len(terms))
        h = self.hash[at] = _term_hashes(terms)
        with np.errstate(over="ignore"):
            x, y = (_mix(h[:, None] + s).view("<u2") for s in self.seeds)
        x = x.reshape(len(terms), self.samples, 4)  # r and c of a sample come from 64 bits, b from 16 more
        b = y[:, :self.samples].astype(np.float32) / np.float32(1 << 16)
        r = _EXPONENTIAL.take(x[..., 0]) + _EXPONENTIAL.take(x[..., 1])
        base = _logarithm(_EXPONENTIAL.take(x[..., 2]) + _EXPONENTIAL.take(x[..., 3])) - r
        self.r[at], self.b[at], self.base[at] = r, b, base
        self.once[at] = base + r * b
        self.rows.update(zip(terms, range(at.start, at.stop)))

    def _part(self, weights: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Least ln a and the hash of its (term, t), per sample."""
        new = [t for t, _ in weights if t not in self.rows]
        if new:
            full = len(self.rows) + len(new) > self.kept
            self._learn([t for t, _ in weights] if full else new)
        row = np.array([self.rows[t] for t, _ in weights], dtype=np.int64)
        weight = np.array([n for _, n in weights])
        order = np.argsort(weight == 1, kind="stable")  # heavier terms first
        row, weight = row[order], weight[order]
        a = self.once.take(row, axis=0)
        t = np.zeros((0, self.samples), dtype=np.float32)
        many = int((weight > 1).sum())
        if many:
            heavy = row[:many]
            ln_w = np.log(weight[:many]).astype(np.float32)[:, None]
            r, b = self.r.take(heavy, axis=0), self.b.take(heavy, axis=0)
            t = np.floor(ln_w / r + b)
            a[:many] = self.base.take(heavy, axis=0) - r * (t - b)
        best = a.argmin(axis=0)
        k = np.arange(self.samples)
        level = np.zeros(self.samples, dtype=np.uint64)
        if many:
            level = np.where(best < many, t[np.minimum(best, many - 1), k], 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            return a[best, k], _mix(self.hash[row[best]] + level * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, weights: dict[bytes, int]) -> np.ndarray:
        """16 bits per sample; zeros without terms."""
        items = list(weights.items())  # in the order of the text, which settles ties of a
        if not items:
            return np.zeros(self.samples, dtype=np.uint16)
        least, kind = self._part(items[:self.kept])
        for lo in range(self.kept, len(items), self.kept):
            a, other = self._part(items[lo:lo + self.kept])
            kind = np.where(a < least, other, kind)
            least = np.minimum(least, a)
        return (kind >> np.uint64(48)).astype(np.uint16)


def terms(text: str) -> Counter:
    """Words of a text, A-Z lower-cased, with their numbers; long texts are read in parts cut at spaces."""
    out: Counter = Counter()
    start, n = 0, len(text)
    while start < n:
        end = text.find(" ", start + PART_CHARS)
        end = n if end < 0 else end
        out.update(text[start:end].encode().lower().split())
        start = end
    return out


def to_text(signature: np.ndarray) -> str:
    """Four hex digits a sample."""
    return signature.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=">u2") for v in (a, b))
    return float((x == y).mean())


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    """This process's sampler."""
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``df`` with the fingerprint of a text column added."""
    @F.pandas_udf(T.StringType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sign = sampler(samples)
        for s in texts:
            yield s.fillna("").map(lambda x: to_text(sign(terms(x))))

    return df.withColumn(out_col, of(F.col(text_col)))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first as many characters (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SUCCESSOR_FIELDS = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
                    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def id_ranges(docs: DataFrame, key: str, size_col: str, range_bytes: int, least: int) -> np.ndarray:
    """First keys of consecutive ranges of about ``range_bytes`` of text each, or of ``least`` ranges; every range has rows.

    The bounds grow with the corpus as its number of partitions does (one of 8 bytes for 8 MB of text).
    """
    total, n = docs.agg(F.sum(size_col), F.count(F.lit(1))).first()
    if not n:
        return np.zeros(0, dtype=np.int64)
    ranges = min(n, max(least, -(-(total or 0) // range_bytes)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx(key, F.lit(shares), F.lit(max(10_000, 20 * ranges)))).first()[0] if shares else []
    first = docs.agg(F.min(key)).first()[0]
    # percentiles are keys that occur, so each range begins with its own bound
    return np.unique(np.array([first, *cuts], dtype=np.int64))


def with_successors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: its fingerprint, the edited text's, and their likeness to each other and to the next document's.

    ``id_col`` is an integer column; the document after the last is the first.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    narrow = docs.select(key.alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    bounds = id_ranges(narrow, "key", "size", range_bytes, shuffle_width(docs.sparkSession))
    if not len(bounds):
        bounds = np.zeros(1, dtype=np.int64)
    last = len(bounds) - 1

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.to_numpy(), side="right") - 1
        first = bounds[at] == keys.to_numpy()
        # rows that begin a range are read at the end of the range before it, too (marked by a negative number)
        return pd.Series([[k, -1 - (k - 1 if k else last)] if f else [k] for k, f in zip(at.tolist(), first.tolist())])

    dealt = docs.select(F.col(id_col), F.col(text_col), key.alias("_key")) \
        .select("*", F.explode(ranges_of("_key")).alias("_range")) \
        .select(id_col, text_col, "_key", (F.col("_range") < 0).alias("_ahead"),
                F.when(F.col("_range") < 0, -1 - F.col("_range")).otherwise(F.col("_range")).alias("_range")) \
        .repartitionById(len(bounds), F.col("_range")).sortWithinPartitions("_range", "_ahead", "_key", text_col) \
        .select(id_col, text_col, "_range", "_ahead")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *SUCCESSOR_FIELDS])

    def run(batches):
        sign = sampler(samples)
        held = None       # the document read last: its range, id, text and signature
        out: list[tuple] = []

        def compare(text, own, following, following_sign):
            other = edited(text, following)
            data = other.encode()
            of_other = own if other == text else sign(terms(other))
            return (len(text), hashlib.sha256(data).hexdigest(), to_text(own), to_text(of_other),
                    float((own == of_other).mean()), float((own == following_sign).mean()))

        def emit(batch_type):
            cols = list(zip(*out))
            types = [batch_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.fieldNames())

        for batch in batches:
            for row in range(batch.num_rows):
                doc, text, place, ahead = (batch.column(k)[row].as_py() for k in range(4))
                text = text or ""
                if held is None or held[0] != place:
                    # of rows read ahead only the first counts; a range has rows of its own before it
                    held = None if ahead else (place, doc, text, sign(terms(text)))
                    continue
                own = sign(terms(text))
                out.append((held[1], *compare(held[2], held[3], text, own)))
                held = None if ahead else (place, doc, text, own)
                if len(out) >= 1024:
                    yield emit(batch.schema.field(0).type)
            if out:
                yield emit(batch.schema.field(0).type)

    return dealt.mapInArrow(run, schema)
