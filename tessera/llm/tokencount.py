"""Token counts by compiled finite-state transducers.

Two deterministic transducers in series give the counts of a byte-level BPE:

* The *splitter* runs over character classes. Its transitions are annotated with the
  tokens' starts they emit (at the character read or the one before, which is all the
  look-ahead the splitting rules need). A slice of texts is cut into chunks; each
  chunk's map of all start states to end states is computed, maps are composed by
  a parallel prefix scan, and each chunk then runs from its true start state.
* The *word machine* reads the bytes of one split word. Its state is the last token of
  every prefix within the longest token's reach (that determines all that follows); a
  transition is annotated with the number of tokens it adds (which may be
  negative). A token can follow a prefix if no merge ever crosses their border,
  which is checked by undoing merges from the latest. Words are run once and kept.

A special string inside a text counts as one token, as the library does by default.
Cases: null and empty texts have 0 bytes and 0 tokens; other columns are not read;
repeated rows repeat; an empty table gives no rows. Within a slice, words are grouped by 64-bit
hashes and each is compared with its group's first; one that differs is counted by itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import SpanHasher, same_spans, text_slices

LIMIT = 1024
SLICE_BYTES = 2 << 20
CHUNK = 1024
KEPT_WORDS = 1_000_000
KEPT_PAIRS = 1_000_000

# Character classes of the splitter.
END, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, SUFFIX, RV, EL, E = range(11)
CLASSES = 11
# Its states: what has been read last.
(BEGIN, SPACE_1, WHITE_1, SPACE_N, WHITE_N, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_RV, QUOTED_L, SHORT) = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # a token starts at this character, at the one before


def _class_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            t[c] = LETTER if kind == "L" else NUMBER
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    t[white] = WHITE
    t[ord(" ")] = SPACE
    t[ord("'")] = QUOTE
    for letters, k in (("stmd", SUFFIX), ("rv", RV), ("l", EL), ("e", E)):
        t[[ord(x) for x in letters]] = k
    return t


def _run_state(c: int) -> int:
    """State after a character of class c that starts a token."""
    if c == SPACE:
        return SPACE_1
    if c == WHITE:
        return WHITE_1
    if c == NUMBER:
        return NUMBERS
    if c == OTHER:
        return OTHERS
    if c == QUOTE:
        return QUOTED
    return LETTERS


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state, and the starts emitted."""
    if c == END:
        return BEGIN, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
    white = c in (SPACE, WHITE)
    if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
        if white:
            return (SPACE_N if c == SPACE else WHITE_N), 0
        many = BEFORE if state in (SPACE_N, WHITE_N) else 0  # a run's last white character stands apart
        if state in (SPACE_1, SPACE_N):  # a space joins what follows; a quote there begins no short form
            return (OTHERS if c == QUOTE else _run_state(c)), many
        return _run_state(c), many | HERE
    letter = c in (LETTER, SUFFIX, RV, EL, E)
    if state == QUOTED:
        if c == SUFFIX:
            return SHORT, 0
        if c == RV:
            return QUOTED_RV, 0
        if c == EL:
            return QUOTED_L, 0
        if c in (OTHER, QUOTE):
            return OTHERS, 0
        return _run_state(c), HERE
    if state in (QUOTED_RV, QUOTED_L):
        if (state, c) in ((QUOTED_RV, E), (QUOTED_L, EL)):
            return SHORT, 0
        return (LETTERS, BEFORE) if letter else (_run_state(c), BEFORE | HERE)
    if state == LETTERS and letter or state == NUMBERS and c == NUMBER or state == OTHERS and c in (OTHER, QUOTE):
        return state, 0
    return _run_state(c), HERE


class Splitter:
    """The first transducer, compiled to two tables."""

    def __init__(self):
        pairs = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
        self.next = np.array([p[0] for p in pairs], dtype=np.uint8)
        self.emit = np.array([p[1] for p in pairs], dtype=np.uint8)
        self.classes = _class_table()

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions of token starts in a string of classes (texts divided by END)."""
        n = len(symbols)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, END, dtype=np.uint8)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)  # one column of all chunks at a time
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
        for column in columns:
            maps = self.next[maps.astype(np.int16) * CLASSES + column]
        # inclusive prefix scan: after it, maps[:, i] takes the first chunk's start to chunk i's end
        shift = 1
        while shift < rows:
            maps = np.concatenate([maps[:, :shift], np.take_along_axis(maps[:, shift:], maps[:, :-shift], axis=0)], axis=1)
            shift *= 2
        state = np.concatenate([[BEGIN], maps[BEGIN, :-1]]).astype(np.uint8)
        emitted = np.empty((CHUNK, rows), dtype=np.uint8)
        for j, column in enumerate(columns):
            at = state.astype(np.int16) * CLASSES + column
            emitted[j] = self.emit[at]
            state = self.next[at]
        emitted = emitted.T.ravel()[:n]
        start = (emitted & HERE) > 0
        start[:-1] |= (emitted[1:] & BEFORE) > 0
        return np.flatnonzero(start)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordMachine:
    """The second transducer: tokens of one word."""

    def __init__(self, model: dict):
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        number = {b: i for i, b in enumerate(raw.values())}
        self.rank = [-1] * len(number)
        self.split: list[tuple[int, int] | None] = [None] * len(number)
        self.pair: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = number[raw[left]], number[raw[right]], number[raw[left] + raw[right]]
            self.pair.setdefault((a, b), r)
            if self.split[whole] is None:
                self.split[whole], self.rank[whole] = (a, b), r
        self.number = {b: t for b, t in number.items() if len(b) == 1 or self.split[t]}
        self.longest = max(map(len, self.number), default=1)
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}

    def can_follow(self, left: int, right: int) -> bool:
        """No merge crosses the border of two tokens."""
        key = (left, right)
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) >= KEPT_PAIRS:
                self.follows.clear()
            got = self.follows[key] = self._undo(left, right)
        return got

    def _undo(self, left: int, right: int) -> bool:
        limit = len(self.pair)
        while True:
            crossing = self.pair.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.split[left][1]
            elif self.rank[right] >= 0:
                limit, right = self.rank[right] + 1, self.split[right][0]  # of equal merges the left one comes first
            else:
                return True

    def transitions(self, word: bytes) -> list[int]:
        """Tokens that each byte adds."""
        last: list[int | None] = [None]
        count = [0]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.number.get(word[start:end])
                if token is not None and (start == 0 or last[start] is not None and self.can_follow(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return [b - a for a, b in zip(count, count[1:])]

    def tokens(self, word: bytes) -> int:
        n = self.known.get(word)
        if n is None:
            n = 1 if word in self.number else sum(self.transitions(word))
            if len(word) <= 64:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n


class Counter:
    """Token counts of many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.splitter, self.words = Splitter(), WordMachine(spec["model"])

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        docs = len(bounds) - 1
        counts = np.zeros(docs, dtype=np.int64)
        if not len(buf):
            return counts
        text = buf.tobytes()
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        byte_of = np.flatnonzero((buf & 0xC0) != 0x80)
        doc_of = np.searchsorted(bounds, byte_of, side="right") - 1
        at = np.arange(len(points)) + doc_of
        symbols = np.full(len(points) + docs, END, dtype=np.uint8)
        symbols[at] = self.splitter.classes[points]
        for special in self.specials:  # one token; to the splitter it is the end of a text
            found = text.find(special)
            while found >= 0:
                doc = int(np.searchsorted(bounds, found, side="right")) - 1
                if found + len(special) <= bounds[doc + 1]:
                    counts[doc] += 1
                    first = int(np.searchsorted(byte_of, found))
                    symbols[at[first:first + len(special.decode())]] = END
                    found += len(special) - 1
                found = text.find(special, found + 1)
        starts = self.splitter.starts(symbols)
        stops = np.flatnonzero(symbols == END)
        edges = np.union1d(starts, stops)
        ends = edges[np.searchsorted(edges, starts, side="right")]
        # positions of the class string to bytes; an END is at the byte that follows
        byte_at = np.empty(len(symbols) + 1, dtype=np.int64)
        byte_at[at] = byte_of
        byte_at[bounds_at(at, doc_of, docs, len(symbols))] = bounds[1:]
        lo, hi = byte_at[starts], byte_at[ends]
        _, first, which = np.unique(SpanHasher(buf)(lo, hi), return_index=True, return_inverse=True)
        tokens = self.words.tokens
        each = np.array([tokens(text[a:b]) for a, b in zip(lo[first].tolist(), hi[first].tolist())], dtype=np.int64)
        n = each[which]
        length = hi - lo
        model = first[which]
        for k in np.flatnonzero((length != length[model]) | ~same_spans(buf, lo, buf, lo[model], length)).tolist():
            n[k] = tokens(text[lo[k]:hi[k]])
        np.add.at(counts, np.searchsorted(bounds, lo, side="right") - 1, n)
        return counts


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This process's compiled transducers of a tokenizer file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def bounds_at(at: np.ndarray, doc_of: np.ndarray, docs: int, n: int) -> np.ndarray:
    """Positions of the END after each text."""
    chars = np.bincount(doc_of, minlength=docs)
    return np.cumsum(chars + 1) - 1


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    source = docs.select(F.col("doc_id"), F.col(text_col))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = counter_of(tokenizer_path)
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(1), SLICE_BYTES):
                n = counter(buf, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)),
                                                  pa.array(n), pa.array(n > limit)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
