"""Word counts of units in blocks, whose distinct words are looked up once a block.

A unit of 1,000 words holds some 300 distinct ones, most of which its neighbours hold too. One row for each
(unit, word) would be shuffled and sorted by its word to find the word's position. Here instead

1. units are ordered by their keys over range partitions, so that a job's units are neighbours, and cut into
   blocks of about ``BLOCK_WORDS`` words; copies of a unit (equal keys) stay in one block;
2. a block numbers its distinct (job, word) pairs: one row a unit with the numbers of its words and how often it
   has each, and one row a pair with the units that hold it. Both are written as one table;
3. only the pairs' rows are joined to the vocabulary (:func:`place`); each block's units meet the positions of its pairs.

A task holds one block at a time, whatever the vocabulary and the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..session import default_parallelism, delete_path, fresh_path, release

BLOCK_WORDS = 1 << 19   # a unit counts as a word too; a block takes about 60 bytes for each
PART_BLOCKS = 64        # see ``parts``


def write(units: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of ``units`` (keys, text), written: rows of units (block, keys, unit, codes, counts) and rows of
    their distinct words (block, job, term, code, df), told apart by a null ``term``.

    The first of ``keys`` names the job. ``unit`` numbers the distinct keys of a block, ``df`` counts the
    rows of units that hold the term. A null text has no words.
    """
    spark = units.sparkSession
    schema = T.StructType([T.StructField("block", T.LongType()),
                           *[T.StructField(k, units.schema[k].dataType) for k in keys],
                           T.StructField("unit", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("term", T.StringType()),
                           T.StructField("code", T.IntegerType()), T.StructField("df", T.LongType())])
    most = BLOCK_WORDS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, rows in enumerate(_cut(batches, len(keys), most)):
            yield from _encoded(rows, keys, first + i)

    n = max(default_parallelism(spark), spark.sparkContext.defaultParallelism)
    ordered = units.select(*keys, "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    path = fresh_path(spark, "word-blocks")
    ordered.select(*keys, words(F.col("text")).alias("words")).mapInArrow(encode, schema).write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def parts(blocks: DataFrame, numbers: Iterable[int] | None = None) -> list[DataFrame]:
    """``blocks`` in runs of ``PART_BLOCKS``, for steps whose shuffles are not to fill the disk at once; ``numbers`` of all blocks, if known."""
    if numbers is None:
        numbers = [r["block"] for r in blocks.select("block").distinct().collect()]
    numbers = sorted(numbers)
    cuts = [numbers[a:a + PART_BLOCKS] for a in range(0, len(numbers), PART_BLOCKS)]
    return [blocks.filter(F.col("block").between(c[0], c[-1])) for c in cuts] or [blocks]


def delete(blocks: DataFrame) -> None:
    """Delete what :func:`write` has written; nothing may read ``blocks`` any more."""
    for folder in {f.rsplit("/", 1)[0] for f in blocks.inputFiles()}:
        delete_path(blocks.sparkSession, folder)


def frequencies(blocks: DataFrame, job: str) -> DataFrame:
    """(job, term, df): the units that hold each term of a job."""
    return blocks.filter(F.col("term").isNotNull()).groupBy(job, "term").agg(F.sum("df").alias("df"))


def place(blocks: DataFrame, vocab: DataFrame, keys: list[str], normed: bool, whole: bool) -> DataFrame:
    """(keys, entries): one row for each row of units with an array of (position, value); words not in ``vocab`` drop out.

    ``vocab(job, term, position, idf)``. The value is the word's count, or with ``normed`` count x idf over the norm of
    all rows of the unit. With ``whole`` entries are ascending by position and copies of a unit share those of all.
    """
    entry = T.StructType([T.StructField("position", T.LongType()), T.StructField("value", T.DoubleType())])
    schema = T.StructType([*[T.StructField(k, blocks.schema[k].dataType) for k in keys],
                           T.StructField("entries", T.ArrayType(entry))])

    def put(units: pa.Table, at: pa.Table) -> pa.Table:
        return _placed(units, at, keys, normed, whole)

    return met(blocks, vocab, put, schema, keys)


def met(blocks: DataFrame, vocab: DataFrame, put, schema, keys: list[str] = ["job_id"]) -> DataFrame:  # noqa: B006 - not changed
    """``put`` (units, found) of each block: its rows of units with ``keys``, and (code, position, idf) of its words in ``vocab``."""
    pairs = blocks.filter(F.col("term").isNotNull()).select(keys[0], "term", "block", "code")
    found = pairs.join(vocab, [keys[0], "term"]).select(F.col("block").alias("of_block"), "code", "position", "idf")
    rows = blocks.filter(F.col("term").isNull()).select("block", *keys, "unit", "codes", "counts")
    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(put, schema)


def _numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal values and for nulls, and the value of each number."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _one(rows: pa.Table) -> pa.RecordBatch:
    return rows.combine_chunks().to_batches()[0]


def _run_starts(rows: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Indexes at which other keys than those of the row before begin."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in range(n_keys):
        number, _ = _numbered(rows.column(k))
        new[1:] |= number[1:] != number[:-1]
    return np.flatnonzero(new)


def _cut(batches: Iterator[pa.RecordBatch], n_keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batches`` (keys, words) in order of the keys as blocks of at most ``most`` words and rows, or of one unit's rows."""
    held, fresh = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            fresh += batch.num_rows + int(_lengths(batch.column(n_keys)).sum())
        if fresh >= most:
            *ready, last = _blocks(_one(pa.Table.from_batches(held)), n_keys, most)
            yield from ready
            held, fresh = [last], 0   # its last unit may go on in the next batch
    if held:
        yield from _blocks(_one(pa.Table.from_batches(held)), n_keys, most)


def _blocks(rows: pa.RecordBatch, n_keys: int, most: int) -> Iterator[pa.RecordBatch]:
    edges = np.append(_run_starts(rows, n_keys), rows.num_rows)
    size = np.concatenate([[0], np.cumsum(_lengths(rows.column(n_keys)) + 1)])[edges]
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield rows.slice(edges[at], edges[to] - edges[at])
        at = to


def _encoded(rows: pa.RecordBatch, keys: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """A block's rows of units and of words; see :func:`write`."""
    n = rows.num_rows
    lists = rows.column(len(keys))
    term, terms = _numbered(lists.flatten())
    d = max(len(terms), 1)
    held, counts = np.unique(np.repeat(np.arange(n), _lengths(lists)) * d + term, return_counts=True)
    row, job = held // d, _numbered(rows.column(0))
    pairs, code = np.unique(job[0][row] * d + held % d, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    unit = np.zeros(n, np.int32)
    unit[_run_starts(rows, len(keys))] = 1
    array = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
    key_types = [rows.schema.field(i).type for i in range(len(keys))]
    names = ["block", *keys, "unit", "codes", "counts", "term", "code", "df"]
    ints = pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), *[rows.column(i) for i in range(len(keys))], pa.array(np.cumsum(unit, dtype=np.int32) - 1),
         array(code), array(counts), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
    m = len(pairs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, block)), job[1].take(pa.array(pairs // d)), *[pa.nulls(m, t) for t in key_types[1:]],
         pa.nulls(m, pa.int32()), pa.nulls(m, ints), pa.nulls(m, ints), terms.take(pa.array(pairs % d)),
         pa.array(np.arange(m, dtype=np.int32)), pa.array(np.bincount(code, minlength=m).astype(np.int64))], names=names)


def unit_rows(units: pa.Table) -> Iterator[tuple[str, int, np.ndarray]]:
    """(job, block, row numbers) of each job in one block's rows of units, in the order of ``unit``; copies stand together."""
    if not units.num_rows:
        return
    order = np.argsort(units.column("unit").to_numpy(), kind="stable")
    number, jobs = _numbered(units.column("job_id").combine_chunks())
    block = units.column("block")[0].as_py()
    for i, job in enumerate(jobs.to_pylist()):
        yield job, block, order[number[order] == i]


def unit_entries(units: pa.Table, found: pa.Table) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(job, block, row, position, count) of each job's entries in one block; rows count in the order of :func:`unit_rows`.

    Copies of a unit each have the entries of all of them.
    """
    codes = units.column("codes").combine_chunks()
    lens, flat = _lengths(codes), codes.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lens)])
    counts = units.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
    position = np.full(max(flat.max(initial=-1), found.column("code").to_numpy().max(initial=-1)) + 1, -1, np.int64)
    position[found.column("code").to_numpy()] = found.column("position").to_numpy()
    unit = units.column("unit").to_numpy()
    for job, block, rows in unit_rows(units):
        row, source = np.arange(len(rows)), rows
        if len(np.unique(unit[rows])) < len(rows):
            first = np.searchsorted(unit[rows], unit[rows])
            copies = np.searchsorted(unit[rows], unit[rows], side="right") - first
            row = np.repeat(row, copies)
            source = rows[np.repeat(first, copies) + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)]
        n = lens[source]
        at = np.repeat(ends[source] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, known = position[flat[at]], position[flat[at]] >= 0
        yield job, block, np.repeat(row, n)[known], place[known], counts[at][known]


def _placed(units: pa.Table, found: pa.Table, keys: list[str], normed: bool, whole: bool) -> pa.Table:
    """The entries of one block's units; ``found`` has the position of each of its words that the vocabulary has."""
    number = lambda t, name: t.column(name).to_numpy()
    n, of = units.num_rows, number(found, "code")
    if not n:
        entries = pa.array([], pa.list_(pa.struct([("position", pa.int64()), ("value", pa.float64())])))
        return pa.Table.from_arrays([*[units.column(k) for k in keys], entries], names=[*keys, "entries"])
    codes = units.column("codes").combine_chunks()
    row, code, value = np.repeat(np.arange(n), _lengths(codes)), codes.flatten().to_numpy(), \
        units.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
    position = np.full(max(code.max(initial=-1), of.max(initial=-1)) + 1, -1, np.int64)
    position[of] = number(found, "position")
    known = position[code] >= 0
    row, code, value = row[known], code[known], value[known]
    unit, place = number(units, "unit"), position[code]
    if normed:
        idf = np.zeros(len(position))
        idf[of] = number(found, "idf")
        value = value * idf[code]
        value = value / np.sqrt(np.bincount(unit[row], weights=value * value, minlength=unit.max() + 1))[unit[row]]
    if whole:
        first = np.unique(unit, return_index=True)[1]   # the first row of each unit
        order = np.lexsort((value, place, unit[row]))
        row, place, value = unit[row][order], place[order], value[order]
        last = np.ones(len(row), bool)                  # a unit's copies have a word twice
        last[:-1] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        row, place, value = row[last], place[last], value[last]
        n = len(first)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    order = np.argsort(row, kind="stable")
    entries = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
        [pa.array(place[order]), pa.array(value[order])], names=["position", "value"]))
    if whole and n < units.num_rows:
        entries = entries.take(pa.array(np.searchsorted(np.unique(unit), unit)))
    return pa.Table.from_arrays([*[units.column(k) for k in keys], entries], names=[*keys, "entries"])
