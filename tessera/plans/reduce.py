"""Embedders wrapped in PCA: bag of words (64 components), token model (16 components)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import job_seed
from ..functions.text import word_counts
from ..functions.vectors import dense_of
from ..operators import count_embed, pca, spans, word_blocks
from ..operators.model_embed import model_embed
from ..session import broadcast_if_small, delete_path, fresh_path, release, spread
from ..schema import BOW, DOC_BATCH, DOC_COMPONENTS, TOKEN_BATCH, TOKEN_COMPONENTS

UNIT_KEYS = ["job_id", "record_id", "sub_key"]


def seeded_projection(units: DataFrame, width: int = DOC_COMPONENTS + pca.OVERSAMPLE) -> DataFrame:
    """The random-projection step of wide PCA on bag-of-words counts: (job, unit, Y = XΩ).

    The seed is adler32(job name); the job name is the job id here. Ω has a row for each term, whatever its
    position, so the counts are projected before a vocabulary is fitted.
    """
    return pca.sketch_counts(word_counts(spread(units), UNIT_KEYS), pca.adler32_expr(F.col("job_id")), width)


@dataclass
class ReducedCountModel:
    """A fitted bag of words with its PCA: the count model's tables and those of ``pca.WidePCA`` under ``path``.

    The components V = XᵀG are kept as their factors, the fitted counts X by spans of terms and G with a row a unit: a
    vocabulary has many more terms than there are units, and most of them stand in one or two.
    """

    counts: count_embed.CountModel
    path: str

    def tables(self) -> dict[str, DataFrame]:
        """``spans`` (X), ``weights`` (G) and ``means`` (job_id, mean, terms_a_span, n_units): the mean unit's coordinates, to be taken off."""
        return {t: count_embed.read_model_table(self.counts.spark, f"{self.path}/{t}") for t in ("spans", "weights", "means")}

    def dense(self, units: DataFrame) -> DataFrame:
        """(job_id, record_id, sub_key, vector): (x - mean) V of every unit; unseen words drop out.

        Units of a job without a direction (all its fitted rows alike) get ``[0.0]``.
        """
        spark = units.sparkSession
        blocks = word_blocks.write(units, UNIT_KEYS)
        tables = self.tables()
        jobs = blocks.filter(F.col("term").isNull()).select("job_id").distinct()
        model = {r["job_id"]: r for r in tables["means"].join(broadcast_if_small(jobs), "job_id", "left_semi").collect()}
        known = [j for j, r in model.items() if r["mean"]]
        where = spans.layout(blocks, terms={j: model[j]["terms_a_span"] for j in known})
        fitted = tables["spans"].filter(F.col("job_id").isin(known)).select("job_id", "span", *[
            F.col(c).alias(f"fit_{c}") for c in spans.PACKED])
        keys = fresh_path(spark, "unit-keys")
        spans.unit_keys(blocks, where).write.parquet(keys)
        x = spans.write(blocks, self.counts.vocab_side(), where, fitted, own=True)
        width = max([len(model[j]["mean"]) for j in known], default=1)
        parts = spans.product(spark, x, where, width, tables["weights"].filter(F.col("job_id").isin(known)),
                              {j: model[j]["n_units"] for j in known}, fit="fit_")
        path = spans.whole(parts, where)
        for p in (x, parts.path):
            delete_path(spark, p)
        means = spark.sparkContext.broadcast({j: np.array(model[j]["mean"]) for j in known})

        def of(job: str, y: np.ndarray) -> np.ndarray:
            mean = means.value.get(job, np.zeros(0))
            return y[:, :len(mean)] - mean
        return pca.unit_vectors(spark.read.parquet(path).select("job_id", "at", "n", "y"), spark.read.parquet(keys), of)

    compact = dense   # as the store keeps them: no entry is left out

    def transform(self, units: DataFrame) -> DataFrame:
        """The same in long form (job_id, record_id, sub_key, position, value)."""
        return self.dense(units).select(*UNIT_KEYS, F.posexplode("vector").alias("position", "value"))


def _fit_wide(model: count_embed.CountModel, blocks: DataFrame, k: int, own: bool = False) -> pca.WidePCA:
    """PCA of the jobs of ``blocks``; the seed of a job's sketch is adler32(job name), as in :func:`seeded_projection`."""
    widths = {r["job_id"]: r["width"] for r in model.stats().collect()}   # one row a job
    return pca.randomized_fit(blocks, model.vocab(), widths, k, job_seed, own=own)


def fit_reduced(units: DataFrame, k: int = DOC_COMPONENTS, blocks: DataFrame | None = None) -> tuple[ReducedCountModel, DataFrame]:
    """Bag of words reduced to ``k`` components for every job of ``units``: the model, and the units' coordinates.

    ``blocks`` may pass the written word blocks of ``units``; blocks made here are deleted.
    """
    own, blocks = blocks is None, blocks if blocks is not None else count_embed.blocks_of(units, BOW)
    model = count_embed.fit(units, BOW, blocks=blocks)
    release(units.sparkSession)
    fitted = _fit_wide(model, blocks, k, own)
    fitted.save(model.path)
    return ReducedCountModel(model, model.path), fitted.coordinates()


def model_vectors(units: DataFrame, make_fn=None, batch_size: int = DOC_BATCH) -> tuple[DataFrame, DataFrame]:
    """Model vectors written once: (vectors of the jobs without a failed unit, all embedded rows), both compact.

    The model runs once whatever reads its output later; jobs with a failed unit
    are left out as a whole, never in part.
    """
    spark = units.sparkSession
    out = model_embed(units, make_fn=make_fn, batch_size=batch_size, compact=True)
    path = fresh_path(spark, "model-vectors")
    out.write.parquet(path)
    out = spark.read.schema(out.schema).parquet(path)
    failed = broadcast_if_small(out.filter(F.col("error_class").isNotNull()).select("job_id").distinct())
    return out.join(failed, "job_id", "left_anti").select(*UNIT_KEYS, "vector", "positions", "width"), out


def model_pca_embed(units: DataFrame, records_per_job: DataFrame, make_fn=None, k: int = DOC_COMPONENTS,
                    batch_size: int = DOC_BATCH) -> DataFrame:
    """Document-level model vectors, PCA-reduced to ``k`` for jobs with at least ``k`` records; plain below."""
    vectors, out = model_vectors(units, make_fn, batch_size)
    failed = out.filter(F.col("error_class").isNotNull()).select("job_id", "error_class").limit(1).collect()
    if failed:
        raise RuntimeError(f"model failed for job {failed[0]['job_id']}: {failed[0]['error_class']}")
    path = fresh_path(units.sparkSession, "reduced-jobs")
    records_per_job.filter(F.col("n_records") >= k).select("job_id").write.parquet(path)
    # broadcast: a shuffled join on the job would bring all vectors of one job into one task
    big = broadcast_if_small(units.sparkSession.read.parquet(path))
    large = vectors.join(big, "job_id", "left_semi")
    reduced = pca.narrow_transform(large, pca.narrow_components(large, k), UNIT_KEYS)
    plain = vectors.join(big, "job_id", "left_anti").select(*UNIT_KEYS, dense_of(of="double").alias("vector"))
    return plain.unionByName(reduced)


def bow_pca_embed(units: DataFrame, records_per_job: DataFrame, k: int = DOC_COMPONENTS) -> DataFrame:
    """Bag of words, PCA-reduced to ``k`` for jobs with ≥ k records; plain counts below.

    Output is long form (job_id, record_id, sub_key, position, value).
    """
    spark = units.sparkSession
    t0 = [__import__("time").time()]
    blocks = count_embed.blocks_of(units, BOW)
    model = count_embed.fit(units, BOW, blocks=blocks)
    release(spark)
    pca._tick("bow fit", t0)
    big_jobs = [r[0] for r in records_per_job.filter(F.col("n_records") >= k).select("job_id").collect()]
    if not big_jobs:
        return model.transform_blocks(blocks)
    small = model.transform_blocks(blocks.filter(~F.col("job_id").isin(big_jobs)))
    coords = _fit_wide(model, blocks.filter(F.col("job_id").isin(big_jobs)), k).coordinates()
    reduced = coords.select(*UNIT_KEYS, F.posexplode("vector").alias("position", "value"))
    return small.unionByName(reduced.withColumn("position", F.col("position").cast("long")))


def token_contexts(tokens: DataFrame) -> DataFrame:
    """Token text with its neighbours (previous and next token of the same record)."""
    w = Window.partitionBy("job_id", "record_id").orderBy("sub_key")
    return tokens.withColumn("text", F.concat_ws(" ", F.lag("text").over(w), F.col("text"), F.lead("text").over(w)))


def token_model_embed(tokens: DataFrame, make_fn=None, k: int = TOKEN_COMPONENTS) -> DataFrame:
    """Per-token model vectors (batch 32, token with neighbours), always PCA-reduced to ``k``.

    ``tokens`` are units (job_id, record_id, sub_key = token_idx, text = token).
    """
    vec = model_embed(token_contexts(tokens), make_fn=make_fn, batch_size=TOKEN_BATCH, compact=True)
    # written once and read twice: the model runs once, and fit and transform see the same vectors
    path = fresh_path(tokens.sparkSession, "token-vectors")
    vec.write.parquet(path)
    vec = tokens.sparkSession.read.schema(vec.schema).parquet(path)
    failed = vec.filter(F.col("error_class").isNotNull()).select("job_id", "error_class").limit(1).collect()
    if failed:  # a job fails as a whole; a part of its tokens is never reduced
        raise RuntimeError(f"model failed for job {failed[0]['job_id']}: {failed[0]['error_class']}")
    vec = vec.select(*UNIT_KEYS, "vector", "positions", "width")
    fitted = pca.narrow_components(vec, k)
    return pca.narrow_transform(vec, fitted, UNIT_KEYS)
