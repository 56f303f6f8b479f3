"""Benchmark decontamination with training suffix arrays.

Every shard (a slice of documents of ``SHARD_BYTES``) gets a suffix array over
its words: the starts of all suffixes in the order of their words. Each distinct
window of the benchmark is binary-searched in it. A suffix array sorted to its
first few words is deepened only below prefixes that some window shares, group by
group: a shard position is in one group at most, so no pairs are listed. Documents
with a whole window are contaminated.

Words: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. A window is ``window`` consecutive words of an item; an item with
fewer words, but not none, is one window.

A document reports which windows it holds as list numbers: windows that occur in the same
benchmark texts share one list. Spark joins the lists to texts and these to item ids
afterwards, once for each distinct set of lists. ``matches`` lists, for each position
and text, the one longest verbatim match (the neighbour in the order of that text's
suffixes), unless it only continues that of the position before.

The distinct benchmark texts are read in blocks of at most ``BLOCK_BYTES``. One block is looked up
in the job that reads the documents; of several, each is broadcast, looked up, its hits
written and the broadcast released before the next (documents are written once then). Cases: null
or empty texts have no words (n_words 0, clean); an item without words matches nothing; items with
equal texts are all reported; items with a null id mark words but have no id to report; repeated
document rows give repeated results; empty tables give no rows (documents) or clean rows
(benchmark). Words are found by 64-bit hashes and compared byte by byte; benchmark texts and sets of them
are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import LOWER, _power_table, covered, mix, repeat_ranges, same_spans, text_slices, word_hashes, word_spans
from .frames import staged

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
PAIRS = 1 << 18  # (position, text) pairs located at once

# Added columns, named unlike any of a document.
WORDS, HIT, LISTS, ROW = (f"_{n}_of_the_row" for n in ("words", "hit", "lists", "place"))
HITS = [T.StructField(WORDS, T.LongType()), T.StructField(HIT, T.LongType()), T.StructField(LISTS, T.ArrayType(T.LongType()))]
SPANS = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")]
PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "entry", "item_word", "doc_word", "n_words")])


class TestSuffixes:
    """Words of one block of distinct benchmark texts, and the suffixes that can start a whole window, by distinct windows."""

    def __init__(self, texts: list[str], entries: list[int], window: int):
        raw = [t.encode() for t in texts]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        starts, ends, first = word_spans(buf, bounds)
        hashes = word_hashes(buf, starts, ends)
        self.entries = np.array(entries, dtype=np.int64)
        self.vocab, model, word = np.unique(hashes, return_index=True, return_inverse=True)
        # a word's number is its hash's place; words that hash like another get numbers of their own
        self.bytes, self.at_byte, self.length = LOWER[buf], starts[model], (ends - starts)[model]
        self.alike: dict[bytes, int] = {}
        for k in self._unlike(word, self.bytes, starts, ends):
            spelled = self.bytes[starts[k]:ends[k]].tobytes()
            word[k] = self.alike.setdefault(spelled, len(self.vocab) + len(self.alike))
        self.n_words = len(self.vocab) + len(self.alike)
        count = np.diff(first)
        # every item's words are followed by one 0, which equals no word
        self.item_at = first[:-1] + np.arange(len(raw))
        item_of_word = np.repeat(np.arange(len(raw)), count)
        self.words = np.zeros(len(word) + len(raw) + 1, dtype=np.int64)
        at = np.arange(len(word)) + item_of_word
        self.words[at] = word + 1
        need = np.minimum(count, window)[item_of_word]
        left = (first[1:][item_of_word] - np.arange(len(word)))
        ok = left >= need
        self.bits = max(1, self.n_words.bit_length())
        self.per_key = max(1, 63 // self.bits)
        # distinct windows: one suffix each, and the texts they occur in
        self.at, item = at[ok], item_of_word[ok]
        self.window_of = self._windows(need[ok])
        _, example = np.unique(self.window_of, return_index=True)
        self.first_at, self.need = self.at[example], need[ok][example]
        pairs = np.unique(self.window_of * max(1, len(raw)) + item)
        self.pair_window, self.pair_item = pairs // max(1, len(raw)), pairs % max(1, len(raw))
        lists = np.zeros(len(example), dtype=np.uint64)
        np.add.at(lists, self.pair_window, mix(self.entries[self.pair_item].astype(np.uint64) + np.uint64(1)))
        self.list_of = mix(lists).astype(np.int64)

    def _unlike(self, number: np.ndarray, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """Which words [start, end) differ from the word whose number their hash gave them."""
        length = ends - starts
        same = same_spans(lowered, starts, self.bytes, self.at_byte[number], length) & (length == self.length[number])
        return np.flatnonzero(~same).tolist()

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number (from 1) of each word of a buffer, 0 for words of no item."""
        hashes = word_hashes(buf, starts, ends)
        slot = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        out = np.where(self.vocab[slot] == hashes, slot + 1, 0)
        known = np.flatnonzero(out)
        lowered = LOWER[buf]
        for k in self._unlike(out[known] - 1, lowered, starts[known], ends[known]):
            spelled = lowered[starts[known[k]]:ends[known[k]]].tobytes()
            out[known[k]] = self.alike.get(spelled, -1) + 1
        return out

    def __bool__(self) -> bool:
        return len(self.at) > 0

    def _windows(self, need: np.ndarray) -> np.ndarray:
        """A number for each suffix, equal for equal windows."""
        theirs = _keys(self.words, self.bits, self.per_key)
        out, so_far = np.zeros(len(self.at), dtype=np.int64), 0
        for n in np.unique(need):
            mine = np.flatnonzero(need == n)
            group = np.zeros(len(mine), dtype=np.int64)
            for depth in range(0, int(n), self.per_key):
                spare = self.bits * max(0, depth + self.per_key - int(n))
                group = _pairs(group, _at(theirs, self.at[mine] + depth) >> spare)
            out[mine] = group + so_far
            so_far += int(group.max()) + 1
        return out

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(list, entry) of all lists, each once."""
        _, example = np.unique(self.list_of, return_index=True)
        lo = np.searchsorted(self.pair_window, example, side="left")
        hi = np.searchsorted(self.pair_window, example, side="right")
        pair, which = repeat_ranges(lo, hi)
        return self.list_of[example[which]], self.entries[self.pair_item[pair]]

    def by_suffix_order(self) -> Places:
        return Places(self)


class Places:
    """The suffixes of each (window, text), in the order of their words."""

    def __init__(self, tests: TestSuffixes):
        rank, step = tests.words, 1
        while step < len(rank):  # doubling, until what follows tells nothing new
            following = np.concatenate([rank[step:], np.zeros(step, dtype=np.int64)])
            finer = _pairs(rank, np.where(rank > 0, following, 0))
            finer[tests.words == 0] = 0
            if len(np.unique(finer)) == len(np.unique(rank)):
                break
            rank, step = finer, step * 2
        item = np.searchsorted(tests.item_at, tests.at, side="right") - 1
        order = np.lexsort((rank[tests.at], item, tests.window_of))
        self.q = tests.at[order]
        pair = tests.window_of[order] * len(tests.item_at) + item[order]
        pairs = tests.pair_window * len(tests.item_at) + tests.pair_item
        self.lo, self.hi = np.searchsorted(pair, pairs, side="left"), np.searchsorted(pair, pairs, side="right")
        n = len(tests.first_at)
        self.pair_lo = np.searchsorted(tests.pair_window, np.arange(n), side="left")
        self.pair_hi = np.searchsorted(tests.pair_window, np.arange(n), side="right")
        self.sums, self.left = _sums(tests.words), _left(tests.words)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each (a, b), in their order."""
    if not len(a):
        return a
    _, small = np.unique(b, return_inverse=True)
    _, big = np.unique(a, return_inverse=True)
    return np.unique(big.astype(np.int64) * (int(small.max()) + 1) + small, return_inverse=True)[1]


_STEP = 0x9E3779B97F4A7C15


def _sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums of spread words times powers; see ``_same``."""
    return np.concatenate([[np.uint64(0)], np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * _power_table(_STEP, len(words)))])


def _left(words: np.ndarray) -> np.ndarray:
    """Words from each position to the next 0."""
    zero = np.append(np.flatnonzero(words == 0), len(words))
    at = np.arange(len(words))
    return zero[np.searchsorted(zero, at, side="left")] - at


def _common(places: Places, q: np.ndarray, sums: np.ndarray, left: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """How many words from test position q and shard position pos on are equal."""
    low, high = np.zeros(len(q), dtype=np.int64), np.minimum(places.left[q], left[pos])
    power = _power_table(_STEP, max(len(sums), len(places.sums)))
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (places.sums[q + mid] - places.sums[q]) * power[pos] == (sums[pos + mid] - sums[pos]) * power[q]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _keys(words: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """At each position, its next ``per_key`` words as one number; positions past the end read as 0."""
    padded = np.concatenate([words, np.zeros(per_key, dtype=np.int64)])
    key = np.zeros(len(words), dtype=np.int64)
    for j in range(per_key):
        key = (key << bits) | padded[j:j + len(words)]
    return key


def _at(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.where(pos < len(keys), keys[np.minimum(pos, len(keys) - 1)], 0)


def search(tests: TestSuffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard position, window number) of all windows in one shard."""
    bits, per = tests.bits, tests.per_key
    mine, theirs = _keys(ids, bits, per), _keys(tests.words, bits, per)
    suffixes = np.flatnonzero(ids)
    suffixes = suffixes[np.argsort(mine[suffixes], kind="stable")]
    first_keys = mine[suffixes]
    found_p, found_w = [], []
    for need in np.unique(tests.need):
        number = np.flatnonzero(tests.need == need)
        spare = bits * max(0, per - int(need))
        low, group_q = np.unique(theirs[tests.first_at[number]] >> spare, return_inverse=True)
        low = low << spare
        lo = np.searchsorted(first_keys, low, side="left")
        hi = np.searchsorted(first_keys, low | ((1 << spare) - 1), side="right")
        shared, group_p = repeat_ranges(lo, hi)  # the ranges are disjoint
        pos = suffixes[shared]
        depth = per
        while depth < need and len(pos):  # deepen only below shared prefixes
            spare = bits * max(0, depth + per - int(need))
            q = tests.first_at[number]
            group = _pairs(np.concatenate([group_q, group_p]), np.concatenate([_at(theirs, q + depth), _at(mine, pos + depth)]) >> spare)
            group_q, group_p = group[:len(q)], group[len(q):]
            keep_q, keep_p = np.isin(group_q, group_p), np.isin(group_p, group_q)
            number, group_q, pos, group_p, depth = number[keep_q], group_q[keep_q], pos[keep_p], group_p[keep_p], depth + per
        if len(pos):
            window = np.zeros(int(group_q.max()) + 1, dtype=np.int64)
            window[group_q] = number  # each group holds one window by now
            found_p.append(pos)
            found_w.append(window[group_p])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_p]), np.concatenate([none, *found_w])


class Shard:
    """The words of some documents, and which windows they hold."""

    def __init__(self, tests: TestSuffixes, buf: np.ndarray, bounds: np.ndarray):
        starts, ends, first = word_spans(buf, bounds)
        self.tests, self.counts = tests, np.diff(first)
        docs = len(self.counts)
        self.begin = first[:-1] + np.arange(docs)
        self.ids = np.zeros(len(starts) + docs, dtype=np.int64)
        if tests and len(starts):
            at = np.arange(len(starts)) + np.repeat(np.arange(docs), self.counts)  # one 0 after each document
            self.ids[at] = tests.numbers(buf, starts, ends)
        self.pos, self.window = search(tests, self.ids) if self.ids.any() else (np.zeros(0, dtype=np.int64),) * 2
        self.doc = np.searchsorted(self.begin, self.pos, side="right") - 1
        self.hit = covered(self.pos, self.pos + tests.need[self.window], len(self.ids))

    def n_hit(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return total[self.begin + self.counts] - total[self.begin]

    def lists(self) -> pa.Array:
        """Distinct lists of each document, in order."""
        numbers, small = np.unique(self.tests.list_of[self.window], return_inverse=True)
        code = np.unique(self.doc * max(1, len(numbers)) + small)
        return _ragged(code // max(1, len(numbers)), numbers[code % max(1, len(numbers))], len(self.counts))

    def spans(self) -> tuple[pa.Array, pa.Array]:
        """Runs of hit words of each document."""
        edge = np.diff(np.concatenate([[False], self.hit, [False]]).astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(self.begin, lo, side="right") - 1
        return tuple(_ragged(doc, x - self.begin[doc], len(self.counts)) for x in (lo, hi))

    def places(self, places: Places) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, item word, document word, words) of the longest matches, piece by piece."""
        sums, left = _sums(self.ids), _left(self.ids)
        order = np.argsort(self.pos, kind="stable")
        pos, window = self.pos[order], self.window[order]
        size = places.pair_hi[window] - places.pair_lo[window]
        upto = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, side="right")) - 1)
            hi = int(np.searchsorted(pos, pos[hi - 1], side="right"))
            back = int(np.searchsorted(pos, pos[lo] - 1, side="left"))  # with the position before
            pair, which = repeat_ranges(places.pair_lo[window[back:hi]], places.pair_hi[window[back:hi]])
            p, item = pos[back:hi][which], self.tests.pair_item[pair]
            a, b = places.lo[pair], places.hi[pair]
            first, last = a.copy(), b - 1
            while (a < b).any():  # the first suffix of the text that is not before the document's
                mid = np.minimum((a + b) // 2, last)
                n = _common(places, places.q[mid], sums, left, p)
                before = self.tests.words[places.q[mid] + n] < self.ids[p + n]
                a, b = np.where((a < b) & before, mid + 1, a), np.where((a < b) & ~before, mid, b)
            one, two = np.maximum(a - 1, first), np.minimum(a, last)
            n_one, n_two = _common(places, places.q[one], sums, left, p), _common(places, places.q[two], sums, left, p)
            q, n = places.q[np.where(n_one > n_two, one, two)], np.maximum(n_one, n_two)
            by = np.lexsort((p, item))
            p, item, q, n = p[by], item[by], q[by], n[by]
            goes_on = np.zeros(len(p), dtype=bool)
            goes_on[1:] = (item[1:] == item[:-1]) & (p[1:] == p[:-1] + 1) & (n[1:] == n[:-1] - 1)
            keep = ~goes_on & (p >= pos[lo])
            p, item, q, n = p[keep], item[keep], q[keep], n[keep]
            doc = np.searchsorted(self.begin, p, side="right") - 1
            yield doc, item, q - self.tests.item_at[item], p - self.begin[doc], n
            lo = hi


def _ragged(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), type=pa.int32()), pa.array(values, type=pa.int64()))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("body")).where("body IS NOT NULL")


def _blocks(items: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[TestSuffixes]]:
    """How many blocks of distinct texts there are, and one after the other."""
    texts = items.select("body").distinct()
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block_bytes))

    def block(b: int) -> TestSuffixes:
        entry = F.xxhash64("body")
        rows = list(texts.select("body", entry.alias("entry")).where(F.pmod(entry, F.lit(n)) == b).toLocalIterator())
        return TestSuffixes([r["body"] for r in rows], [r["entry"] for r in rows], window)

    return n, (block(b) for b in range(n))


def _look_up(frame: DataFrame, shared, text_col: str, keep: list[str], spans: bool = False) -> DataFrame:
    """The columns ``keep`` of all rows with n_words, n_hit and lists (and the runs of hit words)."""
    names = frame.columns
    schema = T.StructType([frame.schema[c] for c in keep] + HITS + SPANS * spans)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(names.index(text_col)), SHARD_BYTES):
                shard, part = Shard(shared.value, buf, bounds), batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index(c)) for c in keep] + [pa.array(shard.counts, type=pa.int64()), pa.array(shard.n_hit(), type=pa.int64()),
                                                                    shard.lists(), *(shard.spans() if spans else ())], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def _locate(frame: DataFrame, shared, text_col: str) -> DataFrame:
    """PLACE rows of the longest matches."""
    names = frame.columns

    def run(batches):
        places = shared.value.by_suffix_order() if shared.value else None
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(names.index(text_col)), SHARD_BYTES) if places else ():
                rows = batch.slice(lo, hi - lo).column(names.index("row")).to_numpy()
                for doc, item, *at in Shard(shared.value, buf, bounds).places(places):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (rows[doc], shared.value.entries[item], *at)],
                                                     names=PLACE.fieldNames())

    return frame.mapInArrow(run, PLACE)


def _union(frame: DataFrame) -> DataFrame:
    """Rows of (row, n_words, lists, starts, ends) over all blocks: n_hit instead of the runs."""
    schema = T.StructType([frame.schema["row"]] + HITS)

    def run(batches):
        for batch in batches:
            hits = []
            for a, b in zip(batch.column(3), batch.column(4)):
                a, b = (np.asarray(x.values.to_numpy()) for x in (a, b))
                by = np.argsort(a, kind="stable")
                a, b = a[by], b[by]
                reach = np.concatenate([[0], np.maximum.accumulate(b)])
                hits.append(int(np.maximum(0, b - np.maximum(a, reach[:-1])).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, type=pa.int64()), batch.column(2)],
                                             names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def _hits(docs: DataFrame, items: DataFrame, text_col: str, keep: list[str], window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(the columns ``keep`` of all documents with n_words, n_hit and lists; list and entry of all lists)."""
    spark = docs.sparkSession
    n, blocks = _blocks(items, window, block_bytes)

    def lists(tests: TestSuffixes) -> DataFrame:
        numbers, entries = tests.lists()
        return spark.createDataFrame(pa.table({"list": pa.array(numbers, type=pa.int64()), "entry": pa.array(entries, type=pa.int64())}))

    if n == 1:
        tests = next(blocks)
        return _look_up(docs, spark.sparkContext.broadcast(tests), text_col, keep), lists(tests)
    mark = "_number_of_the_row"
    rows = staged(docs.withColumn(mark, F.monotonically_increasing_id()), "decontamination-documents")
    found, known = [], []
    for k, tests in enumerate(blocks):
        shared = spark.sparkContext.broadcast(tests)
        part = _look_up(rows, shared, text_col, [mark], spans=True)
        found.append(staged(part if k == 0 else part.where(F.col(HIT) > 0), "decontamination-hits"))
        known.append(staged(lists(tests), "decontamination-lists"))
        shared.destroy()
    each = lambda c: F.flatten(F.collect_list(c))
    summed = reduce(DataFrame.unionAll, found).groupBy(F.col(mark).alias("row")).agg(
        F.max(WORDS).alias(WORDS), F.array_sort(F.array_distinct(each(LISTS))).alias(LISTS), each("starts").alias("starts"), each("ends").alias("ends"))
    joined = rows.join(_union(summed).withColumnRenamed("row", mark), mark)
    return joined.select(*[F.col(f"`{c}`") for c in keep], WORDS, HIT, LISTS), reduce(DataFrame.unionAll, known)


def matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, out: str = "decontamination",
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit and the longest verbatim matches with locations.

    An existing column of that name is replaced. For the places, the documents are written once.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col)
    columns = [c for c in docs.columns if c != out]
    rows = staged(docs.drop(out).withColumn(ROW, F.monotonically_increasing_id()), "decontamination-rows")
    hits, _ = _hits(rows, items, text_col, [*columns, ROW], window, block_bytes)
    found, found_in = [], "_matches_of_the_row"
    for tests in _blocks(items, window, block_bytes)[1]:
        shared = spark.sparkContext.broadcast(tests)
        found.append(staged(_locate(rows.select(F.col(ROW).alias("row"), F.col(text_col)), shared, text_col), "decontamination-places"))
        shared.destroy()
    ids = items.select(F.xxhash64("body").alias("entry"), "item_id").distinct()
    listed = reduce(DataFrame.unionAll, found).join(ids, "entry").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("doc_word", "item_id", "item_word", "n_words"))).alias("m")).select(
        F.col("row").alias(ROW), F.transform("m", lambda m: F.struct(m["item_id"].alias("item_id"), m["item_word"].alias("item_word"),
                                                   m["doc_word"].alias("doc_word"), m["n_words"].alias("n_words"))).alias(found_in))
    none = F.array().cast("array<struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>>")
    return hits.join(listed, ROW, "left").select(
        *[F.col(f"`{c}`") for c in columns], F.struct(F.col(WORDS).alias("n_words"), F.col(HIT).alias("n_hit"), F.coalesce(found_in, none).alias("matches")).alias(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns they came with."""
    found, _ = _hits(docs, _items(benchmark, item_col, item_text_col), text_col, docs.columns, window, block_bytes)
    return found.where(F.col(HIT) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    items = _items(benchmark, "item_id", "text")
    found, lists = _hits(docs.select("doc_id", "text"), items, "text", ["doc_id"], window, block_bytes)
    found = staged(found.select("doc_id", F.col(WORDS).alias("n_words"), F.col(HIT).alias("n_hit"), F.col(LISTS).alias("lists")), "decontamination-digest")
    ids = items.where("item_id IS NOT NULL").select(F.xxhash64("body").alias("entry"), "item_id").distinct()
    sets = found.where("n_hit > 0").select("lists").distinct()
    named = sets.select("lists", F.explode("lists").alias("list")).join(lists.distinct(), "list").select("lists", "entry").distinct().join(
        ids, "entry").groupBy("lists").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select(
        "lists", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    nothing = [F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256")]
    hit = found.where("n_hit > 0").join(named, "lists", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", nothing[0]).alias("n_items"), F.coalesce("items_sha256", nothing[1]).alias("items_sha256"))
    return hit.unionAll(found.where("n_hit = 0").select("doc_id", "n_words", "n_hit", *nothing)).withColumn("contaminated", F.col("n_hit") > 0)
