"""Spelling variants: words one edit apart, grouped under their most frequent forms.

*Near* words differ by exactly one inserted, deleted or replaced character. They are found by
dynamic programming over sorted lists: in a sorted list the words that share a prefix are a
range between adjacent longest common prefixes (LCPs); the edit matrix's row of that prefix is
computed once, from the row of the prefix one character shorter, and serves the whole range. Only two
cells of a row are needed (a list word is as long as the word looked up, or one longer, so it
is never behind). A range whose row exceeds one edit is skipped with all its words.

One list of all words would not scale, so words meet in lists of those that share a part: of a word
of L characters and one as long or one longer, one edit apart, the first
differing place lies in the first or in the second half, and the other half is the same. Words
are dealt by (L, half, the other half's characters); a list of more than ``LIST_WORDS`` is
dealt again by halves of the half that may differ, as often as needed, so a pair meets in exactly one
list and no list grows with the vocabulary (where one place is left, the
alphabet bounds it).

A word's *form* is its near word with most occurrences, if it has at least ``ratio`` times its own;
following forms ends at its *root*. Occurrences at least double on the way, so the paths are
short; they are joined by pointer doubling.

Cases: null and empty texts have no words; null ids are written as an empty text; ties go to
the smaller word in code-point order; repeated rows count as often as they occur; other columns are
not read; an empty table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import repeat_ranges
from .frames import staged

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
SLIP = 97
LIST_WORDS = 20_000       # longer lists are dealt again
BATCH_ROWS = 30_000       # rows of lists scanned together
BATCH_CHARS = 2_000_000
EXPANDED = 2_000_000      # matrix rows computed at once
HELD_WORDS = 500_000      # distinct words a task counts before it hands its counts on
KEY = ["span", "lo", "hi", "head", "tail"]


def slipped(run: str, h: int, modulus: int = SLIP) -> str:
    """The run, or, where ``modulus`` divides h, the run without its character h % length."""
    if h % modulus:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT, modulus: int = SLIP) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) with slips, and their occurrences."""
    # a run shorter than min_chars gives no word long enough
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))

    def run(batches):
        held: dict[str, int] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                               names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():
                    word = slipped(word, zlib.crc32(word.encode(), start), modulus)
                    if len(word) >= min_chars:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_count)


def _dealt(words: DataFrame) -> DataFrame:
    """``words`` with the list key of each (span, lo, hi) row: what stands before lo and after the place that may differ."""
    longer = F.length("word") - F.col("span")  # 0 or 1
    stop = F.least(F.length("word"), F.col("hi") + longer)
    return words.select("word", "n", "span", "lo", "hi", F.expr("substring(word, 1, lo)").alias("head"),
                        F.substring("word", stop + 1, F.length("word")).alias("tail"),
                        F.substring("word", F.col("lo") + 1, F.greatest(stop - F.col("lo"), F.lit(0))).alias("middle"))


def _halves(words: DataFrame) -> DataFrame:
    """Rows of [lo, hi) as two rows, of its halves."""
    middle = F.expr("(lo + hi + 1) div 2").cast("int")
    parts = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return words.select("word", "n", "span", F.explode(parts).alias("part")).select("word", "n", "span", "part.lo", "part.hi")


def lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """Every word under the keys of its lists; lists beyond ``list_words`` are dealt by finer keys."""
    spans = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("span")
    whole = words.select("word", "n", spans).select("*", F.lit(0).alias("lo"), (F.col("span") + 1).alias("hi"))
    dealt = _dealt(_halves(whole))
    while True:
        long = staged(dealt.groupBy(*KEY).count().where((F.col("count") > list_words) & (F.col("hi") - F.col("lo") > 1))
                      .select(*KEY), "long-lists")
        if long.isEmpty():
            return dealt
        dealt = staged(dealt.join(long, KEY, "left_anti").unionByName(
            _dealt(_halves(dealt.join(long, KEY, "left_semi")))), "word-lists")


def near_pairs(middles: list[str], group: np.ndarray, query: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of pairs one edit apart in the same group, i from ``query``, j as long as i or one longer.

    Rows are sorted by (group, middle), groups numbered from 0; a group's queries are its shorter
    words. In ``closed`` groups j must not just continue i: that place belongs to another list.
    """
    length = np.array([len(m) for m in middles], dtype=np.int64)
    points = np.frombuffer(("".join(middles) + "\0").encode("utf-32-le"), dtype=np.uint32)
    at = np.cumsum(length) - length
    last = len(points) - 1
    active, node = np.arange(len(middles)), group   # words of at least d characters; the range of each one's prefix
    frontier = np.flatnonzero(query)
    ranges = group[frontier]
    behind, level = np.full(len(frontier), 2, dtype=np.int8), np.zeros(len(frontier), dtype=np.int8)
    left, right = [], []
    d = 0
    while len(frontier):
        # ranges of the prefixes one character longer: cut where the adjacent LCP is d or less
        goes_on = length[active] > d
        active, node = active[goes_on], node[goes_on]
        if not len(active):
            break
        char = points[at[active] + d]
        cut = np.concatenate([[True], (node[1:] != node[:-1]) | (char[1:] != char[:-1])])
        first, parent, letter = active[cut], node[cut], char[cut]
        node = np.cumsum(cut) - 1
        ends_here = np.where(length[first] == d + 1, first, -1)  # a range's shortest word comes first
        lo, hi = np.searchsorted(parent, ranges, "left"), np.searchsorted(parent, ranges, "right")
        size = np.cumsum(hi - lo)
        kept = []
        begin = 0
        while begin < len(frontier):
            before = int(size[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + EXPANDED, "right")))
            child, which = repeat_ranges(lo[begin:end], hi[begin:end])
            which += begin
            word = frontier[which]
            m = length[word]
            previous, current = (points[np.minimum(at[word] + k, last)] for k in (max(d - 1, 0), d))
            # the row of d + 1 characters: the word's first d of them, and its first d + 1
            new_behind = np.minimum(behind[which] + (previous != letter[child]), level[which] + 1)
            new_level = np.where(d < m, np.minimum(level[which] + (current != letter[child]), new_behind + 1), 2)
            j = ends_here[child]
            found = (j >= 0) & (((d + 1 == m) & (new_level == 1)) | (
                (d == m) & (new_behind == 1) & ~(closed[group[word]] & (level[which] == 0))))
            left.append(word[found])
            right.append(j[found])
            stay = (np.minimum(new_behind, new_level) <= 1) & (d < m)
            kept.append((word[stay], child[stay], new_behind[stay].astype(np.int8), new_level[stay].astype(np.int8)))
            begin = end
        frontier, ranges, behind, level = (np.concatenate(x) for x in zip(*kept))
        d += 1
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


class _Batch:
    """Whole lists waiting to be scanned together."""

    def __init__(self):
        self.words, self.counts, self.middles, self.group, self.query, self.closed = [], [], [], [], [], []
        self.chars = 0

    def add(self, key, rows) -> None:
        if len(rows) < 2:
            return
        span, hi = key[0], key[2]
        number = len(self.closed)
        self.closed.append(hi <= span)
        for word, n, middle in rows:
            self.words.append(word)
            self.counts.append(n)
            self.middles.append(middle)
            self.group.append(number)
            self.query.append(len(word) == span)
            self.chars += len(middle)

    def full(self) -> bool:
        return len(self.words) >= BATCH_ROWS or self.chars >= BATCH_CHARS

    def near(self) -> pa.RecordBatch:
        """Per word: how many near words, and the one of most occurrences."""
        i, j = near_pairs(self.middles, np.array(self.group, dtype=np.int64), np.array(self.query, dtype=bool),
                          np.array(self.closed, dtype=bool))
        found: dict[str, list] = {}
        words, counts = self.words, self.counts
        for a, b in zip(i.tolist(), j.tolist()):
            # words of one length find each other; a longer one is only found
            for x, y in ((a, b), (b, a)) if len(words[a]) != len(words[b]) else ((a, b),):
                have = found.get(words[x])
                best = (-counts[y], words[y])
                if have is None:
                    found[words[x]] = [1, best]
                else:
                    have[0] += 1
                    have[1] = min(have[1], best)
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([-v[1][0] for v in found.values()], pa.int64()), pa.array([v[1][1] for v in found.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words."""
    sorted_lists = lists(words, list_words).repartition(*KEY).sortWithinPartitions(*KEY, "middle") \
        .select(*KEY, "word", "n", "middle")

    def run(batches):
        waiting, key, rows = _Batch(), None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *of, word, n, middle in zip(*columns):
                if of != key:
                    if key is not None:
                        waiting.add(key, rows)
                    if waiting.full():
                        yield waiting.near()
                    key, rows = of, []
                rows.append((word, n, middle))
        if key is not None:
            waiting.add(key, rows)
        yield waiting.near()

    found = sorted_lists.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")) \
        .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles, by pointer doubling."""
    paths = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = paths.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = staged(paths.join(onward, F.col("root") == F.col("_word"), "left"), "roots")
        paths = joined.select("word", F.coalesce("_root", "root").alias("root"))
        if joined.where("_root is not null").isEmpty():
            return paths


def groups(words: DataFrame, *, ratio: int = RATIO, list_words: int = LIST_WORDS) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n."""
    words = staged(words.select("word", "n"), "vocabulary")
    near = near_words(words, list_words)
    enough = F.col("best_n") >= ratio * F.col("n")
    formed = staged(words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    return formed.join(roots(formed.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
