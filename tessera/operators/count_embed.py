"""Count embedders: bag of characters, bag of words, TF-IDF.

Fit and transform are separate Spark plans:

* fit: count terms inside each unit's row (characters) or block (words, see ``word_blocks``), document frequency per
  (job, term), dense positions by term order inside each job (:func:`ordinal_within`, skew-proof), then the fitted
  vocabulary ``(job_id, term, position, df, idf)`` and the per-job stats
  ``(job_id, n_units, width)`` are written as tables. Those tables *are* the
  saved model: reloading them gives the same transform.
* transform: characters join the vocabulary by unit (unseen ones drop out in the inner join); it is broadcast only
  when the fit counted it below ``BROADCAST_VOCAB_ROWS``. Words join it once a block of units, so that what is
  shuffled by term is each block's distinct words, not each unit's.

Vectors are sparse long rows ``(job_id, record_id, sub_key, position, value)``;
``CountModel.compact`` gathers them into one row a unit and ``CountModel.dense`` into
``array<float>`` of the job's width.
Many jobs (projects) are fitted in one plan, keyed by ``job_id``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.indexing import ordinal_within
from ..functions.text import batch_counts, term_counts
from ..functions.vectors import compact, dense_of, shaped
from ..schema import BOC, BOW, TFIDF
from ..session import BROADCAST_MAX_ROWS, broadcast_if_small, fresh_path, spread
from . import word_blocks

UNIT_KEYS = ["job_id", "record_id", "sub_key"]
BROADCAST_VOCAB_ROWS = 2_000_000

KIND_OF_MODEL = {BOC: ("chars", "count"), BOW: ("words", "count"), TFIDF: ("words", "tfidf")}


def read_model_table(spark: SparkSession, path: str) -> DataFrame:
    """A model table; its job_id may be a partition column, whose values must stay strings."""
    raw = spark.read.parquet(path)
    fields = [f for f in raw.schema.fields if f.name != "job_id"]
    return spark.read.schema(T.StructType([*fields, T.StructField("job_id", T.StringType())])).parquet(path)


@dataclass
class CountModel:
    """A fitted count embedder, stored as two tables under ``path``."""

    path: str
    kind: str          # 'chars' | 'words'
    weighting: str     # 'count' | 'tfidf'
    vocab_rows: int

    @property
    def spark(self) -> SparkSession:
        return SparkSession.getActiveSession()

    def vocab(self) -> DataFrame:
        return self._table("vocab")

    def stats(self) -> DataFrame:
        return self._table("stats")

    def _table(self, name: str) -> DataFrame:
        return read_model_table(self.spark, f"{self.path}/{name}")

    def save_meta(self) -> None:
        self.spark.createDataFrame(
            [(json.dumps({"kind": self.kind, "weighting": self.weighting,
                          "vocab_rows": self.vocab_rows}),)], "meta string"
        ).coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CountModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return CountModel(path, meta["kind"], meta["weighting"], int(meta["vocab_rows"]))

    def vocab_side(self) -> DataFrame:
        v = self.vocab().select("job_id", "term", "position", "idf")
        most = BROADCAST_VOCAB_ROWS if self.kind == "chars" else BROADCAST_MAX_ROWS
        return F.broadcast(v) if self.vocab_rows <= most else v

    def transform(self, units: DataFrame) -> DataFrame:
        """Sparse vectors (job_id, record_id, sub_key, position, value) of ``units``.

        Words are counted and written at once, in blocks; characters inside the unit's row.
        """
        if self.kind == "words":
            return self.transform_blocks(word_blocks.write(units, UNIT_KEYS))
        return self.transform_counts(term_counts(spread(units), self.kind, UNIT_KEYS))

    def transform_counts(self, tf: DataFrame) -> DataFrame:
        """Vectors from per-unit character counts (job_id, record_id, sub_key, term, n)."""
        joined = tf.join(self.vocab_side(), ["job_id", "term"])
        return joined.select(*UNIT_KEYS, "position", F.col("n").cast("double").alias("value"))

    def transform_blocks(self, blocks: DataFrame) -> DataFrame:
        """Vectors from ``word_blocks.write``."""
        return self._placed(blocks, False).select(*UNIT_KEYS, F.inline("entries"))

    def _placed(self, blocks: DataFrame, whole: bool) -> DataFrame:
        return word_blocks.place(blocks, self.vocab_side(), UNIT_KEYS, self.weighting == "tfidf", whole)

    def compact(self, units: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(job_id, record_id, sub_key, vector, positions, width) for every unit, as the store keeps them.

        ``blocks`` may pass the written word blocks of ``units`` (see :func:`blocks_of`).
        """
        widths = broadcast_if_small(self.stats().select("job_id", "width"))
        if self.kind != "words":
            return self._compact_chars(units, widths)
        blocks = blocks if blocks is not None else word_blocks.write(units, UNIT_KEYS)
        return shaped(self._placed(blocks, True), UNIT_KEYS, widths)

    def _compact_chars(self, units: DataFrame, widths: DataFrame) -> DataFrame:
        """:meth:`compact` of characters: in the unit's row where its vocabulary can be held; copies of a unit meet in a shuffle."""
        if self.vocab_rows > BROADCAST_MAX_ROWS:
            return compact(self.transform(units), units, UNIT_KEYS, widths)
        spark = units.sparkSession
        path = fresh_path(spark, "repeated-units")
        repeated_records(units).write.parquet(path)
        again = spark.read.parquet(path)
        if not again.limit(1).count():
            return self._in_rows(units)
        same = [units[c].eqNullSafe(again[f"_{c}"]) for c in ("job_id", "record_id")]
        copies, single = (units.join(broadcast_if_small(again), same, how) for how in ("left_semi", "left_anti"))
        return self._in_rows(single).unionByName(compact(self.transform(copies), copies, UNIT_KEYS, widths))

    def _in_rows(self, units: DataFrame) -> DataFrame:
        """:meth:`compact` of units that come once: their characters are counted and placed in their own row."""
        vocab: dict[str, list] = {r["job_id"]: [r["width"], [], []] for r in self.stats().select("job_id", "width").collect()}
        for r in self.vocab().select("job_id", "term", "position").collect():   # at most BROADCAST_MAX_ROWS
            vocab[r["job_id"]][1].append(ord(r["term"]))
            vocab[r["job_id"]][2].append(r["position"])
        tables = {}
        for job, (width, points, positions) in vocab.items():
            order = np.argsort(points)
            tables[job] = width, np.array(points, np.int64)[order], np.array(positions, np.int32)[order]
        told = units.sparkSession.sparkContext.broadcast(tables)
        text = F.lower(F.col("text")).cast("binary")
        schema = T.StructType([*[T.StructField(k, units.schema[k].dataType) for k in UNIT_KEYS], T.StructField("vector", T.ArrayType(T.FloatType())),
                               T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("width", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, rows, row, point, n in batch_counts(batch, len(UNIT_KEYS)):
                    yield from _placed_chars(batch.slice(at, rows), row, point, n, told.value)
        return spread(units).select(*UNIT_KEYS, text.alias("_text")).mapInArrow(run, schema)

    def dense(self, units: DataFrame) -> DataFrame:
        """Dense vectors (job_id, record_id, sub_key, vector) for every unit, zeros included."""
        return self.compact(units).select(*UNIT_KEYS, dense_of().alias("vector"))


def _placed_chars(units: pa.RecordBatch, row: np.ndarray, point: np.ndarray, n: np.ndarray, tables: dict) -> Iterator[pa.RecordBatch]:
    """Compact vectors of ``units`` from their characters, by row; units of jobs without a table are left out."""
    jobs = units.column(0).dictionary_encode()
    of = jobs.indices.fill_null(-1).to_numpy()
    for code, job in enumerate(jobs.dictionary.to_pylist()):
        if job not in tables:
            continue
        width, points, positions = tables[job]
        rows = np.flatnonzero(of == code)
        mine = of[row] == code
        at, value = np.searchsorted(rows, row[mine]), n[mine].astype(np.float32)
        found = np.minimum(np.searchsorted(points, point[mine]), len(points) - 1)
        known = points[found] == point[mine] if len(points) else np.zeros(len(at), bool)
        at, value = at[known], value[known]
        place = positions[found[known]]
        order = np.lexsort((place, at))
        at, value, place = at[order], value[order], place[order]
        lens = np.bincount(at, minlength=len(rows))
        few = lens * 3 < width
        inside = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
        starts = np.concatenate([[0], np.cumsum(np.where(few, lens, width))])
        vector = np.zeros(starts[-1], np.float32)
        vector[starts[at] + np.where(few[at], inside, place)] = value
        ends = np.concatenate([[0], np.cumsum(np.where(few, lens, 0))]).astype(np.int32)
        where = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[few[at]], pa.int32()), mask=pa.array(~few))
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [*(units.column(i).take(take) for i in range(len(UNIT_KEYS))),
             pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(vector, pa.float32())), where,
             pa.array(np.full(len(rows), width, np.int32))], names=[*UNIT_KEYS, "vector", "positions", "width"])


def repeated_records(units: DataFrame) -> DataFrame:
    """(_job_id, _record_id): the records that may have a unit twice. One row a record is shuffled, not one a unit.

    A record's sub_keys that run from the least to the largest, each once, have the number and the sum of hashes of
    that sequence; records whose sub_keys have gaps are named too.
    """
    key = F.col("sub_key").cast("long")
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 31))  # noqa: E731 - a sum of 2^31 of them fits a long
    records = units.groupBy(F.col("job_id").alias("_job_id"), F.col("record_id").alias("_record_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count(key).alias("numbered"), F.min(key).alias("least"), F.max(key).alias("most"),
        F.sum(hashed(key)).alias("hashes"))
    run = (F.col("most") - F.col("least") + 1 == F.col("n")) & (F.col("numbered") == F.col("n"))
    once = (F.col("n") == 1) | (run & (F.col("hashes") == F.aggregate(
        F.when(run, F.sequence("least", "most")), F.lit(0).cast("long"), lambda a, x: a + hashed(x))))
    return records.filter(~F.coalesce(once, F.lit(False))).select("_job_id", "_record_id")


def blocks_of(units: DataFrame, model: str) -> DataFrame | None:
    """The written word blocks of ``units``, for a fit and a transform that share them; None for characters."""
    return word_blocks.write(units, UNIT_KEYS) if KIND_OF_MODEL[model][0] == "words" else None


def fit(units: DataFrame, model: str, tf: DataFrame | None = None, blocks: DataFrame | None = None) -> CountModel:
    """Fit the vocabulary of ``model`` ('bag-of-characters' | 'bag-of-words' | 'tf-idf') per job.

    ``tf`` may pass already counted characters of ``units`` (see :func:`fit_transform`), ``blocks`` their word blocks.
    """
    kind, weighting = KIND_OF_MODEL[model]
    spark = units.sparkSession
    path = fresh_path(spark, f"model-{kind}-{weighting}")
    u = units.select(*UNIT_KEYS, "text")
    u.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_units")).write.parquet(f"{path}/units")
    n_units = broadcast_if_small(spark.read.parquet(f"{path}/units"))
    # written first: the ordering below samples its input for range bounds, which would count every text again
    if kind == "words":
        df = word_blocks.frequencies(blocks if blocks is not None else word_blocks.write(u, UNIT_KEYS), "job_id")
    else:
        tf = tf if tf is not None else term_counts(spread(u), kind, UNIT_KEYS)
        df = tf.groupBy("job_id", "term").agg(F.count(F.lit(1)).alias("df"))
    df.write.parquet(f"{path}/frequencies")
    ranked = ordinal_within(spark.read.parquet(f"{path}/frequencies"), ["job_id"], ["term"], "position")
    vocab = (ranked.join(n_units, "job_id")
             .withColumn("idf", F.log((F.lit(1.0) + F.col("n_units")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
             .select("job_id", "term", "position", "df", "idf"))
    vocab.write.parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    width = vocab.groupBy("job_id").agg(F.count(F.lit(1)).alias("width"))
    stats = n_units.join(width, "job_id", "left").fillna(0, ["width"])
    stats.write.parquet(f"{path}/stats")
    vocab_rows = spark.read.parquet(f"{path}/stats").agg(F.sum("width")).first()[0] or 0
    m = CountModel(path, kind, weighting, int(vocab_rows))
    m.save_meta()
    return m


def fit_transform(units: DataFrame, model: str) -> tuple[CountModel, DataFrame]:
    """Fit and transform the same units, exploding and counting their terms only once.

    The per-unit counts are written to the work folder; both the vocabulary and
    the vectors are computed from that table.
    """
    spark = units.sparkSession
    kind, _ = KIND_OF_MODEL[model]
    if kind == "words":
        blocks = blocks_of(units, model)
        m = fit(units, model, blocks=blocks)
        return m, m.transform_blocks(blocks)
    tf_path = fresh_path(spark, "term-counts")
    term_counts(spread(units), kind, UNIT_KEYS).write.parquet(tf_path)
    tf = spark.read.parquet(tf_path)
    m = fit(units, model, tf)
    return m, m.transform_counts(tf)
