"""Alignment of two tokenizers' tokens over the same texts.

Every text is tokenized whole by both tokenizers. Byte offsets where a token of each
ends are *shared ends*; they cut the two id sequences into groups. A shared end right
before a token that carries its leading space in both tokenizers is an *anchor*, taken only where the
bytes of both sequences agree up to there, so it is verified and not guessed.
Anchors cut a document into windows of (ids of A, ids of B), mostly one word each, and a
window's groups and links follow from its ids alone. Windows recur, so each is
aligned once per worker and looked up by its id tuples afterwards.

Neither tokenizer has a token across a single space between other characters (checked on the
vocabulary), so the ids of a text are those of its parts between such spaces, one after the
other. Parts recur too: the libraries encode a batch's new ones together, and a
part met again brings its ids' windows along.

``aligned`` gives the documents' groups and their links (pairs of ids that end together, with
counts inside the document). ``pair_counts`` adds the links up over the corpus. Two
tokens that end together are suffixes one of the other, so the number of
distinct pairs is bounded by the vocabularies (``most_pairs``), whatever the corpus: only a
pair table within that bound is broadcast.

Cases: null and empty texts, and texts whose tokens of A or B do not give back a space
and the text byte for byte, have no tokens (zeros, no groups); repeated rows count as
often as they occur; columns other than the id and the text are not read; an empty
table gives no rows. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from .tokencount import _byte_letters

KEPT_WINDOWS = 100_000   # aligned windows kept per worker; older ones are aligned again when met again
KEPT_PARTS = 500_000     # parts of texts whose ids are kept per worker
KEPT_LENGTH = 64         # longer parts and windows are not kept
BATCH_CHARS = 1 << 20    # texts handed to the libraries at once
_FAR = re.compile("[^\\x00-\u052f]")
_UNEVEN = re.compile(r"^\s|\s\s|[^\S ]|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"    # fixed value: the space of sentencepiece vocabularies


def _spans_space(tokens) -> bool:
    """Some token holds a single space between two other characters."""
    return any(re.search(r"\S \S", t.decode("utf-8", "replace")) for t in tokens)


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library; encodes a space and the text.

    Texts of the characters below U+0530 go through the same vocabulary in tiktoken, which takes a
    third of the time; a test holds the two libraries against each other on each of these characters.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocabulary = {i: t for t, i in spec["model"]["vocab"].items()} | added
        self.bytes_of = [b""] * (max(vocabulary) + 1)
        for i, token in vocabulary.items():
            self.bytes_of[i] = token.encode() if i in added else bytes(letters[c] for c in token)
        ranks = {t: i for i, t in enumerate(self.bytes_of) if i not in added}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuttable = not _spans_space(t for i, t in enumerate(self.bytes_of) if i not in added)

    def slow(self, text: str) -> list[int]:
        """Ids by the tokenizers library, which is loaded when first needed."""
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) if t.isascii() or not _FAR.search(t) else self.slow(t) for t in texts]


class Pieces:
    """Tokenizer B: a sentencepiece model; adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                                 else piece.replace(SPACE_MARK, " ").encode())
        self.cuttable = not _spans_space(self.bytes_of)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together at all: one's bytes are a suffix of the other's."""
    def suffixes(of: list[bytes], among: Counter) -> int:
        return sum(among[t[i:]] for t in of for i in range(1, len(t)))
    in_a, in_b = Counter(a), Counter(b)
    return sum(n * in_b[t] for t, n in in_a.items()) + suffixes(a, in_b) + suffixes(b, in_a)


def parts(text: str) -> list[str]:
    """The text cut at its single spaces between other characters; each space belongs to the part after it, which leaves it out."""
    if not _UNEVEN.search(text):
        return text.split(" ")
    return _CUT.split(text)


def align_window(a: tuple, b: tuple, length_a: list[int], length_b: list[int], text: list[str]) -> tuple[str, tuple]:
    """Groups (as text) and links (a << 32 | b) of two id tuples that cover the same bytes; ``text``: ids as text."""
    if len(a) == 1 or len(b) == 1:  # only their ends are shared
        return ",".join([text[x] for x in a]) + "|" + ",".join([text[x] for x in b]), ((a[-1] << 32) | b[-1],)
    ends = {}
    at = 0
    for k, y in enumerate(b, 1):
        at += length_b[y]
        ends[at] = k
    groups, links = [], []
    at = from_a = from_b = 0
    for i, x in enumerate(a, 1):
        at += length_a[x]
        k = ends.get(at)
        if k:
            links.append((x << 32) | b[k - 1])
            groups.append(",".join([text[x] for x in a[from_a:i]]) + "|" + ",".join([text[x] for x in b[from_b:k]]))
            from_a, from_b = i, k
    return ";".join(groups), tuple(links)


class Aligner:
    """Aligns documents; one per worker process, with the windows it has seen."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.length_a, self.length_b = ([len(t) for t in x.bytes_of] for x in (self.a, self.b))
        self.lengths = [np.array(x, dtype=np.int64) for x in (self.length_a, self.length_b)]
        self.spaced = [np.array([t.startswith(b" ") for t in x.bytes_of]) for x in (self.a, self.b)]
        self.id_text = list(map(str, range(max(map(len, self.lengths)))))
        self.cuttable = self.a.cuttable and self.b.cuttable
        self.windows: dict[tuple, tuple[str, tuple]] = {}
        self.parts: dict[str, tuple | None] = {}
        self.pairs: dict[int, int] = {}  # one object per linked pair

    def window(self, key: tuple) -> tuple[str, tuple]:
        """Groups and links of a window, aligned when first met."""
        w = self.windows.get(key)
        if w is None:
            groups, links = align_window(*key, self.length_a, self.length_b, self.id_text)
            one = self.pairs.setdefault
            w = groups, tuple([one(x, x) for x in links])
            if len(key[0]) <= KEPT_LENGTH:
                _make_room(self.windows, KEPT_WINDOWS)
                self.windows[key] = w
        return w

    def split(self, ids_a: list[int], ids_b: list[int]) -> tuple:
        """Windows between anchors. ``ids_a`` and ``ids_b`` cover the same bytes, beginning with a space."""
        begins, places = [], []
        for ids, length, spaced in zip((ids_a, ids_b), self.lengths, self.spaced):
            ids = np.array(ids)
            begin = np.cumsum(length[ids]) - length[ids]
            at = np.flatnonzero(spaced[ids])
            begins.append(begin[at])
            places.append(at)
        in_b = np.searchsorted(begins[1], begins[0][1:])  # both begin with the text's own space, which is no cut
        in_a = np.flatnonzero(begins[1].take(in_b, mode="clip") == begins[0][1:])
        cuts_a = [0, *places[0][in_a + 1].tolist(), len(ids_a)]
        cuts_b = [0, *places[1][in_b[in_a]].tolist(), len(ids_b)]
        a, b = tuple(ids_a), tuple(ids_b)
        return tuple((a[i:k], b[j:m]) for i, k, j, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:]))

    def part(self, part: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        """(n_a, n_b, groups, links) of a part's windows; None where a tokenizer does not give the part back."""
        whole = (" " + part).encode()
        of_a, of_b = self.a.bytes_of, self.b.bytes_of
        if not b"".join([of_a[x] for x in ids_a]) == whole == b"".join([of_b[x] for x in ids_b]):
            return None
        if " " not in part:  # its one space-marked token comes first: one window
            return len(ids_a), len(ids_b), *self.window((tuple(ids_a), tuple(ids_b)))
        seen = [self.window(k) for k in self.split(ids_a, ids_b)]
        return len(ids_a), len(ids_b), ";".join([w[0] for w in seen]), tuple([x for w in seen for x in w[1]])

    def __call__(self, texts: list[str]) -> list[tuple[int, int, str, Counter]]:
        """Per text: n_a, n_b, groups as text, and links (a << 32 | b) with their counts; a link a group."""
        cut = [(parts(t) if self.cuttable else [t]) if t else [] for t in texts]
        _make_room(self.parts, KEPT_PARTS)
        new = [p for p in set(chain.from_iterable(cut)) if p not in self.parts]
        for p, a, b in zip(new, self.a.encode([" " + p for p in new]), self.b.encode(new)):
            self.parts[p] = self.part(p, a, b)
        out = []
        for text in cut:
            found = list(map(self.parts.__getitem__, text))
            if None in found:
                found = []
            out.append((sum([f[0] for f in found]), sum([f[1] for f in found]), ";".join([f[2] for f in found]),
                        Counter(chain.from_iterable([f[3] for f in found]))))
        for p in new:
            if len(p) > KEPT_LENGTH:
                del self.parts[p]
        return out


def _make_room(kept: dict, most: int) -> None:
    """Forget the older half of a full cache."""
    if len(kept) >= most:
        for old in list(kept)[:most // 2]:
            del kept[old]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner of the two files."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _small_batches(batch: pa.RecordBatch):
    """Consecutive (ids, texts) of a batch holding at most ``BATCH_CHARS`` characters (one text at least)."""
    lo, size, texts = 0, 0, []
    for row, text in enumerate(batch.column(1)):
        text = text.as_py() or ""
        if texts and size + len(text) > BATCH_CHARS:
            yield batch.column(0).slice(lo, row - lo), texts
            lo, size, texts = row, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.column(0).slice(lo, len(texts)), texts


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text",
            keep_groups: bool = True) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups (if kept), groups_sha256, and its links.

    ``link_a``, ``link_b`` and ``link_n`` are arrays of equal length: the distinct
    linked id pairs and how often the document links each.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    ints, longs = T.ArrayType(T.IntegerType()), T.LongType()
    fields = [T.StructField(id_col, source.schema[id_col].dataType), T.StructField("n_a", longs), T.StructField("n_b", longs),
              T.StructField("n_groups", longs), T.StructField("n_links", longs), T.StructField("groups_sha256", T.StringType()),
              T.StructField("link_a", ints), T.StructField("link_b", ints), T.StructField("link_n", T.ArrayType(longs))]
    if keep_groups:
        fields.append(T.StructField("groups", T.StringType()))
    schema = T.StructType(fields)

    def run(batches):
        al = aligner(path_a, path_b)
        for batch in batches:
            for ids, texts in _small_batches(batch):
                cols: dict[str, list] = {f: [] for f in schema.fieldNames()[1:6]}
                every, kept = [], []
                for n_a, n_b, groups, links in al(texts):
                    n = sum(links.values())
                    for name, value in zip(cols, (n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest() if n_a else "")):
                        cols[name].append(value)
                    every.append(links)
                    if keep_groups:
                        kept.append(groups)
                offsets = pa.array(np.cumsum([0, *map(len, every)]), pa.int32())
                pairs = np.fromiter(chain.from_iterable(every), dtype=np.int64, count=offsets[-1].as_py())
                counts = np.fromiter(chain.from_iterable(c.values() for c in every), dtype=np.int64, count=len(pairs))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (
                    (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), counts)]
                values = [pa.array(v, pa.string() if name == "groups_sha256" else pa.int64()) for name, v in cols.items()]
                yield pa.RecordBatch.from_arrays([ids, *values, *lists, *([pa.array(kept, pa.string())] if keep_groups else [])],
                                                 names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(a, b, n, best): links per id pair over the corpus; best: no A id has more links with that B id."""
    pairs = documents.select(F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("p")) \
        .groupBy(F.col("p.link_a").alias("a"), F.col("p.link_b").alias("b")).agg(F.sum("p.link_n").alias("n"))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def digest(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The aligned documents are written once; the pair table is summed from them, written,
    and read by every task as a broadcast: it has at most ``most_pairs`` rows, a number of
    the two vocabularies, checked here.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "aligned")
    aligned(docs, path_a, path_b, id_col=id_col, text_col=text_col, keep_groups=False).write.parquet(path)
    documents = spark.read.parquet(path)
    table_path = fresh_path(spark, "token-pairs")
    pair_counts(documents).write.parquet(table_path)
    table = spark.read.parquet(table_path).toArrow()
    al = aligner(path_a, path_b)
    if table.num_rows > most_pairs(al.a.bytes_of, al.b.bytes_of):
        raise AssertionError("more pairs than the vocabularies allow")
    pair = table.column("a").to_numpy().astype(np.int64) << 32 | table.column("b").to_numpy()
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
    schema = T.StructType([*documents.select(id_col, "n_a", "n_b", "n_groups", "n_links").schema.fields,
                           T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        pair, count, best = shared.value
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            a, b, n = (column[c].flatten().to_numpy() for c in ("link_a", "link_b", "link_n"))
            offsets = np.concatenate([[0], np.cumsum(column["link_a"].value_lengths().to_numpy())])
            at = np.searchsorted(pair, a.astype(np.int64) << 32 | b)
            per_doc = [np.diff(np.concatenate([[0], np.cumsum(v)])[offsets]) for v in (np.where(best[at], n, 0), count[at] * n)]
            yield pa.RecordBatch.from_arrays(
                [*[column[c] for c in (id_col, "n_a", "n_b", "n_groups", "n_links")], *map(pa.array, per_doc), column["groups_sha256"]],
                names=schema.fieldNames())

    return documents.mapInArrow(run, schema)
