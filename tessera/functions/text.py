"""Text expressions: words, characters, tokens and long-text parts.

These are JVM-side column expressions, evaluated per row on the executors (the lambdas of
``transform`` are interpreted, the rest is generated code), except the character counts: those
count the code points of an Arrow batch with numpy, as a sorted array of one-character strings
takes several times as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SPLIT_CHARS, WORD_PATTERN


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def term_counts(units: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """(keys, term, n): occurrences of each term per unit, one row per distinct term.

    A unit is one row, so its terms are sorted and counted inside that row: neither
    the texts nor the term rows cross a shuffle.
    """
    if kind != "words":
        return char_counts(units, keys)
    by_row, counted = _counted(units, keys)
    # the generator takes the expression itself: of a column made before it Spark would evaluate parts once an entry
    return by_row.select(*keys, F.inline(counted))


def _counted(units: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Rows with the sorted words of their text, and the column that counts them: an array of (term, n)."""
    terms = F.col("_terms")
    by_row = units.select(*keys, F.sort_array(words(F.col("text"))).alias("_terms"))
    by_row = by_row.select(*keys, "_terms", run_starts(terms).alias("_starts"))
    return by_row, F.transform("_starts", lambda a, i: F.struct(
        F.get(terms, a).alias("term"), (run_end("_starts", i, terms) - a).cast("long").alias("n")))


def word_counts(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts): one row a unit with its distinct words and their numbers, an array of (term, n); null for a null text."""
    by_row, counted = _counted(units, keys)
    return by_row.select(*keys, counted.alias("counts"))


COUNT_PIECE_BYTES = 1 << 18   # texts are counted in pieces of so many bytes: a count takes about 50 times its piece


def _code_points(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points of a UTF-8 text, ascending, and how often each occurs."""
    found, counts, at = [], [], 0
    while at < len(text):
        end = min(at + COUNT_PIECE_BYTES, len(text))
        while end < len(text) and end > at + 1 and text[end] & 0xC0 == 0x80:
            end -= 1                                    # a piece ends between characters
        points = np.frombuffer(text[at:end].decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        one, n = np.unique(points, return_counts=True)
        found.append(one)
        counts.append(n)
        at = end
    if len(found) <= 1:
        return (found[0], counts[0]) if found else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
    points, place = np.unique(np.concatenate(found), return_inverse=True)
    return points, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def _pieces(ends: np.ndarray) -> Iterator[slice]:
    """Runs of texts of at most COUNT_PIECE_BYTES together (or a single text); ``ends`` are their byte offsets."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + COUNT_PIECE_BYTES, side="right")) - 1)
        yield slice(at, to)
        at = to


def _count_piece(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code point, count) of the texts ``data[ends[i]:ends[i + 1]]``, in order."""
    n = len(ends) - 1
    whole, ends = data[ends[0]:ends[-1]], ends - ends[0]
    leads = (whole & 0xC0) != 0x80
    if n > 1 and leads[ends[:-1][ends[:-1] < len(whole)]].all():   # every text begins with a character
        try:
            points = np.frombuffer(whole.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.int64)
        except UnicodeDecodeError:
            pass
        else:
            before = np.concatenate([[0], np.cumsum(leads)])       # characters before each byte
            keys, counts = np.unique((np.repeat(np.arange(n), np.diff(before[ends])) << 21) | points, return_counts=True)
            return keys >> 21, keys & 0x1FFFFF, counts
    per_text = [_code_points(whole[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:])]
    return (np.repeat(np.arange(n), [len(p) for p, _ in per_text]), np.concatenate([p for p, _ in per_text]).astype(np.int64),
            np.concatenate([c for _, c in per_text]))


def batch_counts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row in these, code point, count) of a batch's texts (binary ``column``) in pieces; null texts have none."""
    texts = batch.column(column).fill_null(b"").cast(pa.large_binary())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    for piece in _pieces(ends):
        yield piece.start, piece.stop - piece.start, *_count_piece(data, ends[piece.start:piece.stop + 1])


def char_counts(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, n) of the characters of each lower-cased text; null and empty texts give no row.

    A batch's texts are counted together, in pieces of COUNT_PIECE_BYTES: short texts (tokens) cost no call each.
    """
    schema = T.StructType([T.StructField(k, units.schema[k].dataType) for k in keys]
                          + [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, row, point, n in batch_counts(batch, len(keys)):
                points, place = np.unique(point, return_inverse=True)
                terms = pa.array([chr(c) for c in points], pa.string()).take(pa.array(place))
                rows = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keys))), terms,
                                                  pa.array(n.astype(np.int64))], names=[*keys, "term", "n"])

    text = F.lower(F.col("text")).cast("binary")
    return units.select(*keys, text.alias("_text")).mapInArrow(count, schema)


def run_starts(values: Column, key=lambda x: x) -> Column:
    """Indexes at which another ``key`` begins in a sorted array."""
    return F.array_compact(F.transform(values, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(values, i - 1))), i)))


def run_end(starts: str, i: Column, values: Column) -> Column:
    """Index after the last element of run ``i``."""
    return F.coalesce(F.get(starts, i + 1), F.size(values))


def tokenize(records: DataFrame, attribute: str, key: str = "record_id",
             text_col: str = "text") -> DataFrame:
    """tokens(record_id, attribute, token_idx, token): one row per word."""
    return records.select(
        F.col(key).alias("record_id"),
        F.lit(attribute).alias("attribute"),
        F.posexplode(words(F.col(text_col))).alias("token_idx", "token"),
    ).withColumn("token_idx", F.col("token_idx").cast("int"))


def split_parts(units: DataFrame, keys: list[str], max_chars: int = SPLIT_CHARS) -> DataFrame:
    """Cut each text into consecutive parts of at most ``max_chars`` characters.

    (keys, part_idx, part, part_len, n_parts). Whole texts are processed: every
    character lands in exactly one part. Empty or null texts give no part.
    """
    n_parts = F.ceil(F.length("text") / F.lit(max_chars)).cast("int")
    # one pass over the text; the part rows carry their part only
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
    return (units
            .select(*keys, n_parts.alias("n_parts"), F.posexplode(parts).alias("part_idx", "part"))
            .withColumn("part_len", F.length("part")))
