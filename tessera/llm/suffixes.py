"""Suffix-array deduplication by a distributed difference-cover algorithm.

A byte goes if a string of ``min_bytes`` bytes that covers it also starts
anywhere else, in the same or another document. Only the order of suffixes up
to that depth matters, so the difference cover has period v = 133 (for 200
bytes) where the full-depth algorithm takes 3, and its names stand for prefixes
instead of triples:

1. *Sort sampled prefixes.* Positions whose offset modulo v is in a difference
   cover D are sampled (12 of 133). For any two equal 200-byte strings some shift
   below v makes both positions sampled. Every sample is named by its first
   200 - v + 1 bytes; names are sorted and adjacent ones compared.
2. *Recurse on names.* Samples with a repeated name are named anew by
   their block, which reaches v - 1 bytes to the left and 200 to the right of the sample.
   If a block repeats, every string that starts in the v positions up to the
   sample repeats, and is decided. Then each pack sends its distinct names of round 1 with
   flags (several blocks, something undecided). Samples whose name class has nothing
   undecided are finished; a class with undecided samples goes on, each of its
   distinct blocks by one sample.
3. *Merge the remaining suffixes.* Strings that start in the v positions up
   to the samples that go on are named by all their 200 bytes, sorted and
   compared with their neighbours. A string that is still open and its copy
   both have a sample of the same name class, so both are in that last sort.

Documents are laid into packs of about ``PACK_BYTES`` (compressed), one row
each, and cross the network once; all rounds reuse that exchange. A round sends a
pack's distinct names, sorted, dealt by their leading bits; a name that a pack holds
thousands of times is sent once, so no hot name gathers in one task: blocks are dealt by their own
names, not by those of round 1, which come once a pack with their flags. Names
travel as 32 bits beside their bucket in round 1 and with the flags (filters: blocks and strings use
63 and 64 bits, and equal hashes count as equal bytes there).

Cases: null texts read as empty (0 bytes, nothing removed); texts shorter than
``min_bytes`` keep everything; repeated rows are removed whole if long enough; a
document is held whole in memory (about 40 bytes a byte); empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import SpanHasher, covered, repeat_ranges
from .frames import nullable, shuffle_width, text_bytes

MIN_BYTES = 200
PACK_BYTES = 1 << 20
BUCKETS_PER_TASK = 4
LEAST_BUCKETS = 256
TASK_BYTES = 32 << 20

# A perfect difference set modulo 133.
_COVER_133 = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)


def difference_cover(v: int) -> tuple[int, ...]:
    """Offsets whose differences give every residue modulo v."""
    if v == 133:
        return _COVER_133
    step = max(1, int(np.ceil(np.sqrt(v))))
    return tuple(sorted(set(range(min(step, v))) | set(range(0, v, step))))


def period(min_bytes: int) -> int:
    """Two thirds of the string length: names keep a third of it."""
    return 133 if min_bytes == MIN_BYTES else max(1, min_bytes * 2 // 3)


PACKS = T.StructType([T.StructField("pack", T.LongType()), T.StructField("sizes", T.BinaryType()),
                      T.StructField("body", T.BinaryType()), T.StructField("rest", T.BinaryType())])
SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pack", T.LongType()),
                     T.StructField("first", T.LongType()), T.StructField("names", T.BinaryType()),
                     T.StructField("more", T.BinaryType())])
REPLY = T.StructType([T.StructField("pack", T.LongType()), T.StructField("answer", T.BinaryType())])


def lay_packs(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows of about PACK_BYTES: document sizes, compressed texts, and the other columns as an Arrow stream."""
    columns = docs.columns

    def build(batches):
        number, part = 0, TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = columns.index(text_col)
            others = [i for i in range(len(columns)) if i != at]
            lo = 0
            while lo < batch.num_rows:
                texts, size, hi = [], 0, lo
                while hi < batch.num_rows and (hi == lo or size < PACK_BYTES):
                    texts.append((batch.column(at)[hi].as_py() or "").encode())
                    size += len(texts[-1])
                    hi += 1
                rest = pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in others],
                                                  names=[str(i) for i in others]) if others else None
                sink = pa.BufferOutputStream()
                if rest is not None:
                    with pa.ipc.new_stream(sink, rest.schema) as w:
                        w.write_batch(rest)
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part << 33) + number], type=pa.int64()), pa.array([sizes.tobytes()], type=pa.binary()),
                    pa.array([squeeze.compress(b"".join(texts))], type=pa.binary()),
                    pa.array([sink.getvalue().to_pybytes()], type=pa.binary())], names=PACKS.fieldNames())
                number, lo = number + 1, hi

    return docs.mapInArrow(build, PACKS)


class Pack:
    """One pack's bytes with the names of every round; each round derives its names from the answers before it."""

    def __init__(self, sizes: bytes, body: bytes, min_bytes: int):
        self.w, self.v = min_bytes, period(min_bytes)
        self.core = self.w - self.v + 1
        n = np.frombuffer(sizes, dtype=np.int64)
        total = int(n.sum())
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, total)), dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.hash = SpanHasher(self.buf)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions that a whole string can follow within v, and their documents."""
        begin, size = self.bounds[:-1], np.diff(self.bounds)
        cover = np.array(difference_cover(self.v), dtype=np.int64)
        longest = int(size.max()) if len(size) else 0
        pattern = (np.arange(longest // self.v + 1, dtype=np.int64)[:, None] * self.v + cover).ravel()
        count = np.where(size >= self.w, np.searchsorted(pattern, size - self.core, side="right"), 0)
        index, doc = repeat_ranges(np.zeros(len(size), dtype=np.int64), count)
        return pattern[index] + begin[doc], doc

    def cores(self) -> None:
        """Round 1: distinct core names, sorted."""
        self.pos, self.doc = self.samples()
        self.cores_1, self.core_of, self.core_count = np.unique(
            self.hash(self.pos, self.pos + self.core), return_inverse=True, return_counts=True)

    def blocks(self, answer: np.ndarray) -> None:
        """Round 2: distinct block names of the samples whose core repeats, sorted."""
        repeated = self.core_count > 1
        repeated[answer] = True
        keep = repeated[self.core_of]
        self.pos, self.doc, self.core_of = self.pos[keep], self.doc[keep], self.core_of[keep]
        start, end = self.bounds[self.doc], self.bounds[self.doc + 1]
        left = np.maximum(self.pos - (self.v - 1), start)
        right = np.minimum(self.pos + self.w, end)
        self.lo, self.hi = left, np.minimum(self.pos, end - self.w) + 1  # starts of the strings up to the sample
        block = self.hash(left, right) ^ ((self.pos - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        block &= ~np.uint64(1)
        names, self.block_example, self.block_of, count = np.unique(block, return_index=True, return_inverse=True, return_counts=True)
        self.block_core = self.core_of[self.block_example]  # a block holds its core
        self.block_name = names | (count > 1).astype(np.uint64)  # the last bit tells that this pack has several

    def flags(self, at: np.ndarray, said: np.ndarray) -> None:
        """Round 2, cores: distinct cores, sorted, and what this pack knows of each. ``said``: REPEATED or FIRST, of the blocks ``at``."""
        self.repeated, self.first = np.zeros(len(self.block_name), dtype=bool), np.zeros(len(self.block_name), dtype=bool)
        self.repeated[at], self.first[at] = True, said == FIRST
        core, self.flag_of, count = np.unique(self.block_core, return_inverse=True, return_counts=True)
        self.flag_name, self.several = self.cores_1[core], count > 1
        self.undecided, first = (np.bincount(self.flag_of, weights=x, minlength=len(core)) > 0 for x in (~self.repeated, self.first))
        self.flag = (self.undecided * UNDECIDED | (self.undecided & ~self.several) * ASKS_SEVERAL
                     | (first & ~self.undecided) * ASKS_UNDECIDED).astype(np.uint8)

    def strings(self, at: np.ndarray, said: np.ndarray) -> None:
        """Round 3: distinct names of the whole strings that are still open, sorted. ``said``: what was asked, of the cores ``at``."""
        several, undecided = self.several.copy(), self.undecided.copy()
        several[at] |= said & SEVERAL > 0
        undecided[at] |= said & UNDECIDED > 0
        open_ = ~self.repeated & several[self.flag_of]
        stands_in = self.first & undecided[self.flag_of]
        self.decided = self.repeated[self.block_of]
        go = np.concatenate([np.flatnonzero(open_[self.block_of]), self.block_example[stands_in]])
        lo, hi = self.lo[go], np.maximum(self.hi[go], self.lo[go])
        self.open = np.flatnonzero(covered(lo, hi, len(self.buf)))
        self.names_3, self.name_of, count = np.unique(self.hash(self.open, self.open + self.w),
                                                      return_inverse=True, return_counts=True)
        self.name_many = count > 1

    def removed(self, answer: np.ndarray) -> np.ndarray:
        """Boolean for each byte."""
        repeated = self.name_many.copy()
        repeated[answer] = True
        single = self.open[repeated[self.name_of]]
        lo = np.concatenate([self.lo[self.decided], single])
        hi = np.concatenate([self.hi[self.decided] - 1, single]) + self.w
        ok = hi - self.w >= lo
        return covered(lo[ok], hi[ok], len(self.buf))


REPEATED, FIRST = 1, 2  # a block that repeats; its first entry
SEVERAL, UNDECIDED, ASKS_SEVERAL, ASKS_UNDECIDED = 1, 2, 4, 8  # of a core


def _parts(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the sorted names' buckets (leading bits, scaled)."""
    bucket = ((names >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64), side="left")


def _sent(pack: int, names: np.ndarray, buckets: int, width: np.dtype, more: np.ndarray | None = None):
    cut = _parts(names, buckets)
    full = np.flatnonzero(np.diff(cut))
    low = names.astype(width)
    return pa.RecordBatch.from_arrays([
        pa.array(full, type=pa.int32()), pa.array(np.full(len(full), pack), type=pa.int64()),
        pa.array(cut[full], type=pa.int64()),
        pa.array([low[cut[b]:cut[b + 1]].tobytes() for b in full], type=pa.binary()),
        pa.array([None if more is None else more[cut[b]:cut[b + 1]].tobytes() for b in full], type=pa.binary())],
        names=SENT.fieldNames())


def _compare(names: np.ndarray, _) -> np.ndarray:
    """Which names also stand elsewhere: sort, compare adjacent ones."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    repeated = np.zeros(len(names), dtype=np.uint8)
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    return repeated


def _compare_blocks(names: np.ndarray, _) -> np.ndarray:
    """REPEATED for each entry of a block that repeats, FIRST for one of them."""
    _, first, number, count = np.unique(names >> np.uint64(1), return_index=True, return_inverse=True, return_counts=True)
    repeated = (count > 1) | (np.bincount(number, weights=names & np.uint64(1)) > 0)
    out = repeated[number].astype(np.uint8) * np.uint8(REPEATED)
    out[first[repeated]] = FIRST
    return out


def _compare_cores(names: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """What each entry asked: whether its core stands in another pack too, whether something is undecided there."""
    _, number, count = np.unique(names, return_inverse=True, return_counts=True)
    undecided = np.bincount(number, weights=flags & UNDECIDED) > 0
    return (((flags & ASKS_SEVERAL > 0) & (count > 1)[number]) * SEVERAL
            | ((flags & ASKS_UNDECIDED > 0) & undecided[number]) * UNDECIDED).astype(np.uint8)


def _round(packs: DataFrame, tasks: int, make, width: str, compare=_compare) -> DataFrame:
    """Deal the names of all packs by their leading bits, compare, and bring each pack its answers."""
    buckets = max(LEAST_BUCKETS, tasks * BUCKETS_PER_TASK)
    dtype = np.dtype(width)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, more = make(row)
                if len(names):
                    yield _sent(row["pack"], names, buckets, dtype, more)

    def answer(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for _, same in groupby(rows, key=lambda r: r["bucket"]):  # one bucket in memory
            group = list(same)
            names = np.concatenate([np.frombuffer(r["names"], dtype=dtype) for r in group])
            cut = np.concatenate([[0], np.cumsum([len(r["names"]) // dtype.itemsize for r in group])])
            said = compare(names, np.concatenate([np.frombuffer(r["more"] or b"", dtype=np.uint8) for r in group]))
            packs_, answers = [], []
            for k, r in enumerate(group):
                part = said[cut[k]:cut[k + 1]]
                at = np.flatnonzero(part)
                if len(at):
                    packs_.append(r["pack"])
                    answers.append(((at + r["first"]) * 4 + part[at]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packs_, type=pa.int64()), pa.array(answers, type=pa.binary())],
                                             names=REPLY.fieldNames())

    sent = packs.mapInArrow(send, SENT).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    replies = sent.mapInArrow(answer, REPLY).repartition(tasks, "pack")
    return replies.groupBy("pack").agg(F.collect_list("answer").alias("answers"))


def _indexes(answers: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(b"".join(answers or []), dtype=np.int64)
    return got >> 2, (got & 3).astype(np.uint8)


def _state(row: dict, min_bytes: int) -> Pack:
    """The pack after the rounds that the row has answers of."""
    pack = Pack(row["sizes"], row["body"], min_bytes)
    pack.cores()
    if "r1" in row:
        pack.blocks(_indexes(row["r1"])[0])
    if "r2" in row:
        pack.flags(*_indexes(row["r2"]))
    if "r2_cores" in row:
        pack.strings(*_indexes(row["r2_cores"]))
    return pack


def mark_repeats(docs: DataFrame, finish, schema: T.StructType, *, text_col: str = "text",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """Run the rounds and map ``finish(rest batch or None, bytes, bounds, removed)`` over the packs."""
    spark = docs.sparkSession
    tasks = max(shuffle_width(spark), -(-text_bytes(docs, text_col) // TASK_BYTES))
    packs = lay_packs(docs, text_col).repartition(tasks, "pack")
    with_1 = packs.join(
        _round(packs, tasks, lambda row: (_state(row, min_bytes).cores_1, None), "uint32")
        .withColumnRenamed("answers", "r1"), "pack", "left")
    with_2 = with_1.join(
        _round(with_1, tasks, lambda row: (_state(row, min_bytes).block_name, None), "uint64", _compare_blocks)
        .withColumnRenamed("answers", "r2"), "pack", "left")

    def flags(row):
        p = _state(row, min_bytes)
        return p.flag_name, p.flag

    with_flags = with_2.join(
        _round(with_2, tasks, flags, "uint32", _compare_cores).withColumnRenamed("answers", "r2_cores"), "pack", "left")
    with_3 = with_flags.join(
        _round(with_flags, tasks, lambda row: (_state(row, min_bytes).names_3, None), "uint64")
        .withColumnRenamed("answers", "r3"), "pack", "left")

    def last(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = _state(row, min_bytes)
                rest = pa.ipc.open_stream(row["rest"]).read_next_batch() if row["rest"] else None
                yield finish(rest, p.buf, p.bounds, p.removed(_indexes(row["r3"])[0]))

    return with_3.mapInArrow(last, schema)


def digest(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [
        T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])

    def finish(rest, buf, bounds, removed):
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            gone = removed[a:b]
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((int(b - a), int(gone.sum()), spans, hashlib.sha256(buf[a:b][~gone].tobytes()).hexdigest()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([rest.column(0)] + [pa.array(c, type=pa.int64()) for c in cols[:3]]
                                          + [pa.array(cols[3], type=pa.string())], names=schema.fieldNames())

    return mark_repeats(docs, finish, schema, min_bytes=min_bytes)


def cut_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, text_col: str = "text") -> DataFrame:
    """The documents with every repeated byte cut out of the text; a character of which only a part is left goes.

    Columns and their order stay; a null text stays null.
    """
    schema = nullable(docs.schema)
    columns = docs.columns
    nulls = "_text_is_null_in_the_row"
    marked = docs.withColumn(nulls, F.col(text_col).isNull())
    at = columns.index(text_col)

    def finish(rest, buf, bounds, removed):
        by_name = dict(zip(rest.schema.names, rest.columns))
        empty = by_name[str(len(columns))].to_pylist()
        texts = [None if e else buf[a:b][~removed[a:b]].tobytes().decode("utf-8", "ignore")
                 for a, b, e in zip(bounds[:-1], bounds[1:], empty)]
        return pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string()) if i == at else by_name[str(i)]
                                           for i in range(len(columns))], names=columns)

    return mark_repeats(marked, finish, schema, text_col=text_col, min_bytes=min_bytes)
