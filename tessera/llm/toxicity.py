"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Input of a word (letters, digits, non-ASCII characters; A-Z lower-cased): the embedding of the
word, if the training sample holds it in ``MIN_DOCS`` documents, and the mean
embedding of its hashed byte triples, so that unseen and altered spellings count
too. Two gated recurrent layers read a window of ``WINDOW`` words in both directions, attention
weighs the states, one logit comes out. Windows start every ``STRIDE`` words, so they
overlap and cover the whole text; a document's score is its highest window's.

The network is trained in numpy on the driver with Adam from a bounded sample:
at most ``SAMPLE_PER_CLASS`` rows a class of labelled documents outside the held-out fold
and of at most ``SAMPLE_TEXT_BYTES`` bytes (documented bounds of the fit). Labels hold for
documents, so each epoch takes the window that scores highest in each (in the
first epochs, the window with the highest word log-odds).

Inputs are projected once for every distinct word of a slice, so steps only gather
rows. Cases: null and empty texts, and texts without words, score 0; labels that are null
or lack a document are not used; conflicting labels count as 1; without any positive
or negative row every score is 0; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import LOWER, repeat_ranges, text_slices, word_hashes, word_spans
from .frames import crc_fold

WINDOW, STRIDE = 32, 24
SAMPLE_PER_CLASS = 1000
SAMPLE_TEXT_BYTES = 1 << 16
VOCABULARY, MIN_DOCS = 8000, 3
WORD_DIM, CHAR_DIM, HIDDEN, PAIRS = 8, 8, 8, 8192
EPOCHS, FIRST_EPOCHS, RATE, BATCH = 20, 6, 0.02, 64
SLICE_BYTES = 2 << 20
STEP_WINDOWS = 8192


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Words:
    """Distinct words of a slice of texts."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        starts, ends, self.first = word_spans(buf, bounds)
        hashes = word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
        self.hashes, at, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        lo, hi = starts[at], ends[at]
        pos, self.pair_word = repeat_ranges(lo, hi)
        low = LOWER[buf].astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
        here = low[pos]
        nxt = np.where(pos + 1 < hi[self.pair_word], low[np.minimum(pos + 1, len(low) - 1)], 0) if len(pos) else here
        prev = np.where(pos > lo[self.pair_word], low[np.maximum(pos - 1, 0)], 0) if len(pos) else here
        self.pair = ((prev * 65599 + here * 257 + nxt) * 40503 >> 7) % PAIRS  # byte triples, with the word's edges
        self.sizes = hi - lo

    def char_mean(self, table: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros((0, table.shape[1]), dtype=table.dtype)
        first = np.cumsum(self.sizes) - self.sizes
        return np.add.reduceat(table[self.pair], first, axis=0) / self.sizes[:, None].astype(table.dtype)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all windows (the number of words stands for padding), and each text's first window."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1))
        turn, doc = repeat_ranges(np.zeros(len(n), dtype=np.int64), count)
        offset = np.where(n[doc] <= WINDOW, 0, np.minimum(turn * STRIDE, n[doc] - WINDOW))
        at = offset[:, None] + np.arange(WINDOW)
        inside = at < n[doc][:, None]
        which = np.append(self.which, len(self.hashes))
        rows = np.where(inside, which[np.where(inside, at + self.first[:-1][doc][:, None], len(self.which))], len(self.hashes))
        return rows, np.concatenate([[0], np.cumsum(count)])


class Network:
    """Weights, forward pass and gradients."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocab = vocab  # sorted hashes; row 0 of the embedding is for unknown words
        self.p = {"word": rng.normal(0, 0.1, (len(vocab) + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (PAIRS, CHAR_DIM)),
                  "att": np.zeros(2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        self.p["word"][1:, 0] = odds
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 1 / np.sqrt(d), (d, 3 * h))
            self.p["u" + side] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
            self.p["c" + side] = np.zeros(3 * h)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """One row for every distinct word, and a zero row for padding."""
        x = np.concatenate([self.p["word"][self.word_rows(words.hashes)], words.char_mean(self.p["char"])], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), dtype=np.float32)])

    def _run(self, x: np.ndarray, rows: np.ndarray, side: str, keep: bool):
        """States (steps, windows, HIDDEN) in reading order, and what the gradients need."""
        h_ = HIDDEN
        projected = x @ self.p["w" + side] + self.p["c" + side]
        u = self.p["u" + side]
        h = np.zeros((len(rows), h_), dtype=np.float32)
        out = np.empty((WINDOW, len(rows), h_), dtype=np.float32)
        saved = []
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a, b = projected[rows[:, t]], h @ u
            zr = _sigmoid(a[:, :2 * h_] + b[:, :2 * h_])
            z, r = zr[:, :h_], zr[:, h_:]
            n = np.tanh(a[:, 2 * h_:] + r * b[:, 2 * h_:])
            if keep:
                saved.append((t, h, z, r, n, b[:, 2 * h_:]))
            h = n + z * (h - n)
            out[t] = h
        return out, saved

    def logits(self, x: np.ndarray, rows: np.ndarray, keep: bool = False):
        f, saved_f = self._run(x, rows, "f", keep)
        b, saved_b = self._run(x, rows, "b", keep)
        states = np.concatenate([f, b], axis=2)
        e = states @ self.p["att"]
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, weight, pooled, saved_f, saved_b)) if keep else logit

    def gradients(self, x: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean cross entropy: parameters of the layers, and the input rows."""
        logit, (states, weight, pooled, saved_f, saved_b) = self.logits(x, rows, keep=True)
        d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.tensordot(d_e, states, axes=([0, 1], [0, 1]))
        d_states = weight[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        d_x = np.zeros_like(x)
        for side, saved, part in (("f", saved_f, d_states[:, :, :HIDDEN]), ("b", saved_b, d_states[:, :, HIDDEN:])):
            w, u = self.p["w" + side], self.p["u" + side]
            g_u, g_proj = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
            d_h = np.zeros((len(rows), HIDDEN), dtype=np.float32)
            for t, h, z, r, n, b_n in reversed(saved):
                d_h = d_h + part[t]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = d_h * (h - n) * z * (1 - z)
                d_r = d_n * b_n * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n], axis=1)
                d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_u += h.T @ d_b
                np.add.at(g_proj, rows[:, t], d_a)
                d_h = d_h * z + d_b @ u.T
            g["u" + side], g["w" + side], g["c" + side] = g_u, x.T @ g_proj, g_proj.sum(axis=0)
            d_x += g_proj @ w.T
        d_x[-1] = 0  # padding
        return g, d_x

    def scores(self, words: Words) -> np.ndarray:
        """Highest window probability of every text; 0 without words."""
        rows, first = words.windows()
        out = np.zeros(len(first) - 1)
        if len(rows):
            x = self.inputs(words)
            p = np.concatenate([_sigmoid(self.logits(x, rows[a:a + STEP_WINDOWS]).astype(np.float64))
                                for a in range(0, len(rows), STEP_WINDOWS)])
            full = np.flatnonzero(np.diff(first))
            out[full] = np.maximum.reduceat(p, first[full])
        return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Network | None:
    """A network from labelled texts; None without both labels."""
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    seen = np.unique(doc * (len(words.hashes) + 1) + words.which)
    seen_doc, seen_word = seen // (len(words.hashes) + 1), seen % (len(words.hashes) + 1)
    df = np.bincount(seen_word, minlength=len(words.hashes))
    toxic = np.bincount(seen_word, weights=labels[seen_doc], minlength=len(words.hashes))
    kept = np.sort(np.argsort(-df, kind="stable")[:VOCABULARY])
    kept = kept[df[kept] >= MIN_DOCS]
    pos, neg = labels.sum(), len(labels) - labels.sum()
    odds = np.log((toxic + 0.5) / (pos + 1)) - np.log((df - toxic + 0.5) / (neg + 1))
    net = Network(words.hashes[kept], (odds[kept] / 3).clip(-1, 1.5), seed)
    rows, first = words.windows()
    full = np.flatnonzero(np.diff(first))
    known = np.zeros(len(words.hashes) + 1)
    known[kept] = odds[kept]
    early = known[rows].max(axis=1)
    word_row, rng = net.word_rows(words.hashes), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch < FIRST_EPOCHS:
            value = early
        else:
            x = net.inputs(words)
            value = np.concatenate([net.logits(x, rows[a:a + STEP_WINDOWS]) for a in range(0, len(rows), STEP_WINDOWS)])
        best = np.array([first[d] + np.argmax(value[first[d]:first[d + 1]]) for d in full])
        order = rng.permutation(len(full))
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            used, local = np.unique(rows[best[part]], return_inverse=True)
            used = used[used < len(words.hashes)]
            local = np.where(local < len(used), local, len(used)).reshape(len(part), WINDOW)
            pair, owner = repeat_ranges(np.cumsum(words.sizes)[used] - words.sizes[used], np.cumsum(words.sizes)[used])
            char = np.zeros((len(used), CHAR_DIM), dtype=np.float32)
            np.add.at(char, owner, net.p["char"][words.pair[pair]])
            size = words.sizes[used][:, None].astype(np.float32)
            x = np.concatenate([net.p["word"][word_row[used]], char / size], axis=1)
            x = np.concatenate([x, np.zeros((1, x.shape[1]), dtype=np.float32)])
            g, d_x = net.gradients(x, local, labels[full[part]])
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], word_row[used], d_x[:-1, :WORD_DIM])
            np.add.at(g["char"], words.pair[pair], (d_x[:-1, WORD_DIM:] / size)[owner])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-3
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] * g[k] - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if k not in ("bias", "att"):
                    v -= np.float32(rate * 1e-3) * v
    return net


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list:
    """(text, toxic) of a bounded, hash-drawn sample of each class outside the held-out fold."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for r in marked.where("toxic IN (0, 1)").groupBy("toxic").count().collect():
        keep = keep | ((F.col("toxic") == r["toxic"]) & (draw < int(min(1.0, 1.5 * per_class / r["count"]) * (1 << 30))))
    chosen = F.broadcast(marked.where(keep).withColumn("draw", draw))  # at most about 1.5 * per_class rows a class
    rows = (docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(chosen, "doc_id")
            .groupBy("toxic", "draw", "doc_id").agg(F.min("text").alias("text")).select("toxic", "draw", "text").collect())
    out = []
    for k in (0, 1):
        out += sorted((r for r in rows if r["toxic"] == k), key=lambda r: (r["draw"], r["text"]))[:per_class]
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network | None:
    rows = training_sample(docs, labels, per_class)
    return train([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, net: Network | None, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus the score (a column of that name is replaced)."""
    frame = docs.drop(out)
    names = frame.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    schema = T.StructType(frame.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches):
        net = shared.value
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(at), SLICE_BYTES):
                value = net.scores(Words(buf, bounds)) if net else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns] + [pa.array(value)], names=names + [out])

    return frame.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
