"""Cost-balanced packing of tokenized documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention inside a
piece). Pieces are taken in descending cost and put on the sequence of lowest
cost with room for them; a piece that fits nowhere is cut to the largest room
and its rest goes on. A document's full sequences are cut off first.

Every task packs the rows of its own partition, in blocks of ``BLOCK_TOKENS``
tokens: nothing is shuffled and memory is bounded by a block and the longest
document. A block fills whole sequences only and hands its remainder to the
next; the partition's last remainder (below one capacity) goes to sequences whose
lengths are powers of two, so nothing is padded at all.
``sequence_id`` is the partition's number times 2**33 plus a running number;
sequences never span partitions.

Token ids: texts of plain characters (below U+0180, no control characters, no
"<|") are cut at white space, which no token spans; the ids of each distinct run
are kept by the worker process. New runs are split by the tokenizer's own rules, and the
library's model merges each new piece, written in its byte characters. Any other text goes
through the library whole. Each document ends with id ``end_id``.

Cases: null and empty texts are that one id; ties keep the order of the rows;
repeated rows are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
KEPT_WORDS = 500_000     # runs, and pieces, that a worker keeps
KEPT_LENGTH = 64         # of at most so many characters
SLICE_CHARS = 1 << 20    # texts encoded together
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY


def _plain(kind: str) -> str:
    """Regex class of the plain characters of a Unicode category."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t\n\v\f\r \xa0"
_ODD = re.compile("[^\t\n\v\f\r -~\xa0-ſ]|<\\|")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_plain('L')}]+|[{_plain('N')}]|[^{_SPACE}{_plain('L')}{_plain('N')}]+")


def plain(text: str) -> bool:
    """Whether the text holds plain characters only."""
    if "<|" in text:
        return False
    if text.replace("\n", " ").isprintable():
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            pass
    return not _ODD.search(text)


def make_room(kept: dict) -> None:
    """Forget the older half of a full cache."""
    if len(kept) >= KEPT_WORDS:
        for old in list(kept)[:len(kept) // 2]:
            del kept[old]


def _byte_characters() -> dict[int, int]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


_BYTES = _byte_characters()


class Tokens:
    """Little-endian 32-bit ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}   # inside runs of several pieces, where they are no runs as well

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, by the merges of the library's model."""
        ids = self.runs.get(piece) or self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            merged = [t.id for t in self.merge(shown)]
            ids = struct.pack(f"<{len(merged)}I", *merged)
            if len(piece) <= KEPT_LENGTH:
                self.pieces[piece] = ids
        return ids

    def learn(self, runs: list[str]) -> list[bytes]:
        """Ids of runs not met before, which are kept; a run of letters is one piece."""
        out = []
        for r in runs:
            if r.isalpha():
                ids = self.piece(r)
                self.pieces.pop(r, None)
            else:
                ids = b"".join(map(self.piece, _PIECE.findall(r)))
            if len(r) <= KEPT_LENGTH:
                self.runs[r] = ids
            out.append(ids)
        return out

    @staticmethod
    def strings(runs: pa.LargeStringArray) -> list[str]:
        """The runs, which hold no space, as strings: cut from one, in a fraction of the time of one by one."""
        together = pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs)
        return pc.binary_join(together, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(runs) else []

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased plain texts: distinct runs are looked up once, the rest is done in arrays."""
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        codes, runs = coded.indices.to_numpy(), self.strings(coded.dictionary)
        ids = list(map(self.runs.get, runs))
        new = [i for i, kept in enumerate(ids) if kept is None]
        for i, learned in zip(new, self.learn([runs[i] for i in new])):
            ids[i] = learned
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n)]
        cuts = ends[offsets]
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        make_room(self.runs)
        make_room(self.pieces)
        easy = [plain(t) for t in texts]
        encoded = iter(self.encode_plain([t.lower() for t, e in zip(texts, easy) if e]))
        return [next(encoded) if e else self.library(t).tobytes() for t, e in zip(texts, easy)]


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """This process's encoder of a tokenizer file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def slices(batch: pa.RecordBatch):
    """(ids, texts) of consecutive rows of at most ``SLICE_CHARS`` characters (one row at least)."""
    ids, texts, size = [], [], 0
    for row, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py() or ""
        if texts and size + len(text) > SLICE_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


class Piece:
    """Ids [start, start + n) of the document in row ``row``."""

    __slots__ = ("row", "start", "n", "ids", "total")

    def __init__(self, row, start, n, ids, total):
        self.row, self.start, self.n, self.ids, self.total = row, start, n, ids, total

    def split(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.row, self.start, n, self.ids[:4 * n], self.total),
                Piece(self.row, self.start + n, self.n - n, self.ids[4 * n:], self.total))


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(pieces: list[Piece], rooms: list[int]) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill sequences of the given capacities to the last token; returns them and the pieces left over."""
    out: list[list[Piece]] = [[] for _ in rooms]
    room = np.array(rooms, dtype=np.int64)
    load = np.zeros(len(rooms))
    queue = [(-p.n, i, p) for i, p in enumerate(pieces)]
    heapq.heapify(queue)
    left, order = int(room.sum()), len(pieces)
    while left and queue:
        _, _, piece = heapq.heappop(queue)
        fits = np.where(room >= piece.n, load, np.inf)
        k = int(np.argmin(fits))
        if room[k] < piece.n:
            k = int(np.argmax(room))
            piece, rest = piece.split(int(room[k]))
            heapq.heappush(queue, (-rest.n, order, rest))
            order += 1
        out[k].append(piece)
        room[k] -= piece.n
        left -= piece.n
        load[k] += cost(piece.n)
    return out, [p for _, _, p in sorted(queue, key=lambda x: x[:2])]


def _powers(n: int) -> list[int]:
    """n as a sum of descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


OUT = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
       T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
       T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), *OUT] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])
    schema = T.StructType(fields)
    end = np.array([end_id], dtype="<u4").tobytes()
    source = docs.select(id_col, text_col)

    def run(batches):
        tokens = tokens_of(tokenizer_path)
        base, number = TaskContext.get().partitionId() << 33, 0
        id_type_arrow = None
        pool: list[Piece] = []
        pooled = 0
        done: list[list[Piece]] = []

        def rows():
            nonlocal number, done
            cols = {n: [] for n in schema.fieldNames()}
            for sequence in done:
                offset = 0
                for p in sequence:
                    cols["doc_id"].append(p.row)
                    cols["start"].append(p.start)
                    cols["length"].append(p.n)
                    cols["ids_crc32"].append(zlib.crc32(p.ids))
                    cols["doc_tokens"].append(p.total)
                    cols["sequence_id"].append(base + number)
                    cols["offset"].append(offset)
                    if keep_ids:
                        cols["ids"].append(np.frombuffer(p.ids, dtype="<i4"))
                    offset += p.n
                number += 1
            done = []
            types = {"doc_id": id_type_arrow, "ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(v, type=types.get(n, pa.int64())) for n, v in cols.items()],
                                              names=list(cols))

        for batch in batches:
            id_type_arrow = batch.schema.field(0).type
            for rows_of, texts in slices(batch):
                for row, ids in zip(rows_of, tokens(texts)):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        done.append([Piece(row, start, capacity, ids[4 * start:4 * (start + capacity)], total)])
                    if whole < total:
                        pool.append(Piece(row, whole, total - whole, ids[4 * whole:], total))
                        pooled += total - whole
                    if pooled >= block_tokens:
                        filled, pool = assign(pool, [capacity] * (pooled // capacity))
                        done += filled
                        pooled = sum(p.n for p in pool)
                    if len(done) >= 2048:
                        yield rows()
        filled, pool = assign(pool, [capacity] * (pooled // capacity))
        done += filled
        done += assign(pool, _powers(sum(p.n for p in pool)))[0]
        if done:
            yield rows()

    return source.mapInArrow(run, schema)
