"""Language identification with string kernels.

Text is lower-cased and mapped to 64 symbols: the ``LETTERS`` most frequent letters
of the training sample, one symbol for all other letters, one for everything
else (runs of which count once). The blended spectrum of a text is the set of its 1-, 2- and 3-grams; the
kernel of two texts is the number of common grams, normalised by the geometric
mean of their own numbers (presence, not counts).

A bounded sample of labelled rows is drawn by a hash of the id (at most
``SAMPLE_PER_LANGUAGE`` a language, of the ``LANGUAGES`` most frequent ones; documented bounds of the fit). Some of them are Nystroem
landmarks: a text's features are its kernels with the landmarks times the
inverse root of the landmarks' kernel matrix. One-versus-rest ridge regression is
solved on the features. As presence kernels are inner products of gram vectors, the whole chain
(kernels, whitening, regression) is one matrix of grams by languages, and a batch
of texts is scored by one product of its sparse presence matrix with it.

Scores: softmax of the one-versus-rest values times ``SHARPNESS``. Cases: a null text or one without
letters is ``und`` with score 0; ties go to the first language in order; no usable label at all
makes every text ``und``; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import text_slices
from .frames import crc_fold, nullable

SYMBOLS = 64
LETTERS = 62
OTHER_LETTER, GAP = 62, 63
SAMPLE_PER_LANGUAGE = 400
LANGUAGES = 1000
LANDMARKS = 200
RIDGE = 1e-2
SHARPNESS = 6.0
SLICE_BYTES = 2 << 20
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """For each code point: its lower-case code point if it is a letter, else -1."""
    t = np.full(0x110000, -1, dtype=np.int32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_tables: dict = {}


def letters() -> np.ndarray:
    """Built once a process."""
    if "letters" not in _tables:
        _tables["letters"] = _letter_table()
    return _tables["letters"]


def code_points(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and their bounds, counted in characters."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return points, begins[bounds]


def presence(symbols: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sorted numbers of the grams of one text; ``flags`` is a cleared table of GRAMS booleans, left cleared."""
    s = symbols.astype(np.int32)
    if len(s) > 1:
        s = s[np.concatenate([[True], (s[1:] != GAP) | (s[:-1] != GAP)])]
    for lo in range(0, len(s), 1 << 20):
        part = s[lo:lo + (1 << 20) + 2]
        flags[part] = True
        two = part[:-1] * SYMBOLS + part[1:]
        flags[SYMBOLS + two] = True
        flags[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + part[2:]] = True
    grams = np.flatnonzero(flags)
    flags[grams] = False
    return grams


class Alphabet:
    """Symbols of code points."""

    def __init__(self, frequent: list[int]):
        self.frequent = frequent[:LETTERS]

    def table(self) -> np.ndarray:
        low = letters()
        number = np.full(0x110000, OTHER_LETTER, dtype=np.uint8)
        number[self.frequent] = np.arange(len(self.frequent))
        return np.where(low < 0, GAP, number[np.maximum(low, 0)]).astype(np.uint8)


def _kernel(a: list[np.ndarray], dense: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Normalised presence kernels of gram sets with the rows of a 0/1 matrix (grams by landmarks)."""
    out = np.empty((len(a), dense.shape[1]))
    for i, grams in enumerate(a):
        out[i] = dense[grams].sum(axis=0, dtype=np.float64) / (np.sqrt(max(1, len(grams))) * norm)
    return out


class Model:
    """Symbols, languages, and the matrix of grams by languages."""

    def __init__(self, frequent: list[int], languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.alphabet, self.languages, self.weights, self.bias = Alphabet(frequent), languages, weights, bias

    @classmethod
    def fit(cls, frequent: list[int], grams: list[np.ndarray], labels: list[str], seed: int = 7) -> "Model":
        languages = sorted(set(labels))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(grams))
        chosen = sorted(order[:LANDMARKS])
        dense = np.zeros((GRAMS, len(chosen)), dtype=np.uint8)
        for j, i in enumerate(chosen):
            dense[grams[i], j] = 1
        norm = np.sqrt(np.maximum(1, np.array([len(grams[i]) for i in chosen])))
        k_nm = _kernel(grams, dense, norm)
        k_mm = k_nm[chosen]
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = k_nm @ root
        y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
        xc = x - mean_x
        w = np.linalg.solve(xc.T @ xc + RIDGE * len(x) * np.eye(x.shape[1]) / 100, xc.T @ (y - mean_y))
        bias = mean_y - mean_x @ w
        weights = np.zeros((GRAMS, len(languages)), dtype=np.float32)
        per_landmark = (root @ w) / norm[:, None]
        used = np.flatnonzero(dense.any(axis=1))
        weights[used] = dense[used].astype(np.float64) @ per_landmark
        return cls(frequent, languages, weights, bias)

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest values of a batch: its sparse presence matrix times the gram matrix."""
        sizes = np.array([len(g) for g in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        out = np.zeros((len(sets), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full):
            first = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.weights[flat], first, axis=0)
        return out / np.sqrt(np.maximum(1, sizes))[:, None] + self.bias


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled rows of each language outside the held-out fold, by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, 1.3 * per_language / r["count"])
        keep = keep | ((F.col("lang") == r["lang"]) & (draw < int(share * (1 << 30))))
    return rows.where(keep).select("lang", "text", draw.alias("draw"))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learn from text and lang of rows whose crc32(doc_id) modulo 5 is not 0. Only gram sets come to the driver."""
    sample = training_sample(docs, per_language)
    pairs = sample.mapInArrow(_count_letters, "letter int, n long")
    frequent = [r["letter"] for r in pairs.groupBy("letter").agg(F.sum("n").alias("n"))
                .orderBy(F.desc("n"), "letter").limit(LETTERS).collect()]
    if not frequent:
        return None

    def sets(batches):
        table, flags = Alphabet(frequent).table(), np.zeros(GRAMS, dtype=bool)
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(1), SLICE_BYTES):
                points, cut = code_points(buf, bounds)
                symbols = table[points]
                grams = [presence(symbols[a:b], flags).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(grams, type=pa.binary()),
                                                  batch.column(2).slice(lo, hi - lo)], names=["lang", "grams", "draw"])

    got = sample.mapInArrow(sets, "lang string, grams binary, draw long").collect()
    taken: dict[str, int] = {}
    labels, grams = [], []
    for r in sorted(got, key=lambda r: (r["draw"], r["lang"], bytes(r["grams"]))):
        if taken.get(r["lang"], 0) < per_language and len(r["grams"]):
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            labels.append(r["lang"])
            grams.append(np.frombuffer(r["grams"], dtype=np.int32).astype(np.int64))
    return Model.fit(frequent, grams, labels) if labels else None


def _count_letters(batches):
    low = letters()
    for batch in batches:
        total = np.zeros(0x110000, dtype=np.int64)
        for _, _, buf, bounds in text_slices(batch.column(1), SLICE_BYTES):
            found = low[code_points(buf, bounds)[0]]
            total += np.bincount(found[found >= 0], minlength=0x110000)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, type=pa.int32()), pa.array(total[seen])], names=["letter", "n"])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its score (columns of those names are replaced)."""
    frame = docs.drop(pred, score)
    names = frame.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams by languages: bounded
    schema = T.StructType(nullable(frame.schema).fields + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        model = shared.value
        table = model.alphabet.table() if model else None
        flags = np.zeros(GRAMS, dtype=bool)
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(at), SLICE_BYTES):
                n = hi - lo
                guess, sure = [UNKNOWN] * n, np.zeros(n)
                if model:
                    points, cut = code_points(buf, bounds)
                    symbols = table[points]
                    lettered = np.concatenate([[0], np.cumsum(symbols != GAP)])
                    has = np.flatnonzero(lettered[cut[1:]] > lettered[cut[:-1]])
                    values = model.score([presence(symbols[cut[i]:cut[i + 1]], flags) for i in has])
                    odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True))) if len(has) else values
                    best = odds.argmax(axis=1) if len(has) else []
                    for k, i in enumerate(has):
                        guess[i] = model.languages[best[k]]
                        sure[i] = odds[k, best[k]] / odds[k].sum()
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, n) for c in batch.columns] + [pa.array(guess, type=pa.string()), pa.array(sure)],
                    names=names + [pred, score])

    return frame.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents whose text has a letter."""
    at = docs.columns.index(text_col)

    def run(batches):
        low = letters()
        for batch in batches:
            for lo, hi, buf, bounds in text_slices(batch.column(at), SLICE_BYTES):
                points, cut = code_points(buf, bounds)
                lettered = np.concatenate([[0], np.cumsum(low[points] >= 0)])
                yield batch.slice(lo, hi - lo).filter(pa.array(lettered[cut[1:]] > lettered[cut[:-1]]))

    return docs.mapInArrow(run, nullable(docs.schema))


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Documents whose language was identified with at least ``min_score``, with the columns they came with.

    Where no row has a usable label there is no prediction to go by: all documents with letters stay.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return with_letters(docs)
    pred, score = "_language_of_the_row", "_score_of_the_row"
    found = predict(docs, model, pred=pred, score=score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
