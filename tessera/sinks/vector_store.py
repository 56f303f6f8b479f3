"""Vector store: versioned parquet slices of (job, bucket), plus exports and collections.

Layout under ``root`` (a folder in the shared storage):

  data/version=<v>/job_id=<job>/bucket=<b>/   (project_id, record_id, sub_key, vector array<float>, positions, width)
  states/<n>_<buckets>/       the live (job_id, bucket, version) slices of state n
  current/<n>_<buckets>       empty file; the highest n names the state that readers see
  exports/job_id=<job>/       bzip2 CSV, header per part file: record_id, sub_key, vector (JSON: a list; of a
                              compact vector wider than EXPORT_WIDTH an object {width, positions, values})
  collection/job_id=<job>/    L2-normalised vectors (+ optional LSH buckets) for k-NN
  models/<name>/<table>/job_id=<job>/   fitted model tables, one partition per job
  embedders/                  which of these made the vectors of each job (registry.py)

Vectors of mostly zeros are kept compact: ``vector`` holds the values at ``positions`` and ``width`` their
full length; elsewhere ``positions`` is null and ``vector`` dense. ``rows`` reads this form, ``vectors`` dense arrays.

A record's bucket is a hash of its id, so that a change rewrites only the buckets it falls
into. Every write goes to a version folder of its own; its state is written next, and the
file in ``current`` last. A reader therefore sees the state before or after a write, and a
DataFrame taken before a write goes on reading the old files until ``vacuum`` removes them.
A write that fails leaves the store as it was. There is one writer at a time; a state that
another writer has taken already raises instead of replacing it.

The slices are listed on the driver: one row for each job, bucket and live write, fewer than
the files that Spark lists there for any scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dense_of, normalize_df
from ..schema import BOC, BOW, MODEL_PCA, REDUCED_BOW, TFIDF
from ..session import (create_marker, default_parallelism, delete_path, fresh_path, list_names, list_partitions,
                       partition_path)
from . import registry

KEY_COLS = ["project_id", "job_id", "record_id", "sub_key"]
STORED_COLS = [*KEY_COLS, "vector", "positions", "width"]
EXPORT_WIDTH = 4096   # compact vectors up to this width are exported as lists of all their values
MODEL_NAMES = (BOC, BOW, TFIDF, REDUCED_BOW, MODEL_PCA)
MODEL_TABLES = ("vocab", "stats", "components", "means")
SLICE_SCHEMA = "job_id string, bucket int, version string"
STORED_SCHEMA = f"project_id string, record_id string, sub_key int, vector array<float>, positions array<int>, width int, {SLICE_SCHEMA}"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"   # Spark's folder name of a null partition value
# Hash buckets of each job in a new store; an existing store keeps the number it was made with.
# A change rewrites at least one bucket of its job, so large jobs want more: about one for every
# few gigabytes of the largest job. Small jobs pay for each bucket with a small file.
VECTOR_BUCKETS = 4

Slice = tuple[str | None, int, str]   # job_id, bucket, version


class VectorStore:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = VECTOR_BUCKETS):
        self.spark = spark
        self.root = root or fresh_path(spark, "store")
        states = self._states()
        self.buckets = states[-1][1] if states else buckets

    # --- paths -------------------------------------------------------------
    @property
    def data_path(self) -> str:
        return f"{self.root}/data"

    @property
    def exports_path(self) -> str:
        return f"{self.root}/exports"

    @property
    def collection_path(self) -> str:
        return f"{self.root}/collection"

    def model_path(self, name: str) -> str:
        return f"{self.root}/models/{name}"

    def _version_path(self, version: str) -> str:
        return f"{self.data_path}/version={version}"

    def _slice_path(self, part: Slice) -> str:
        job, bucket, version = part
        folder = partition_path(self.spark, self._version_path(version), "job_id", NULL_PARTITION if job is None else job)
        return f"{folder}/bucket={bucket}"

    # --- states ------------------------------------------------------------
    def _states(self) -> list[tuple[int, int]]:
        """(number, buckets) of the states that are kept, oldest first."""
        return sorted(tuple(int(x) for x in name.split("_")) for name in list_names(self.spark, f"{self.root}/current"))

    def _slices_of(self, state: tuple[int, int]) -> set[Slice]:
        path = f"{self.root}/states/{state[0]}_{state[1]}"
        return {tuple(r) for r in self.spark.read.schema(SLICE_SCHEMA).json(path).collect()}

    def slices(self) -> set[Slice]:
        """The live (job_id, bucket, version) slices."""
        states = self._states()
        return self._slices_of(states[-1]) if states else set()

    def _commit(self, live: set[Slice]) -> None:
        states = self._states()
        name = f"{states[-1][0] + 1 if states else 1}_{self.buckets}"
        path = f"{self.root}/states/{name}"
        # a state without its file in ``current`` was left by a write that failed
        self.spark.createDataFrame(sorted(live, key=str), SLICE_SCHEMA).coalesce(1) \
            .write.mode("overwrite").json(path)
        if not create_marker(self.spark, f"{self.root}/current/{name}"):
            raise RuntimeError(f"another writer has written state {name} of {self.root}")

    def vacuum(self, keep: int = 1) -> None:
        """Remove the files that none of the newest ``keep`` states names, and the older states."""
        states = self._states()
        old, kept = states[:-keep], states[-keep:]
        live = set().union(*(self._slices_of(s) for s in kept))
        dead = set().union(*(self._slices_of(s) for s in old)) - live
        for n, buckets in old:   # no reader may find a state whose files are going
            delete_path(self.spark, f"{self.root}/current/{n}_{buckets}")
            delete_path(self.spark, f"{self.root}/states/{n}_{buckets}")
        versions = {version for _, _, version in live}
        for version in list_partitions(self.spark, self.data_path, "version"):
            if version not in versions:
                delete_path(self.spark, self._version_path(version))
        for part in dead:
            if part[2] in versions:
                delete_path(self.spark, self._slice_path(part))

    # --- reads -------------------------------------------------------------
    def _read(self, parts: Iterable[Slice]) -> DataFrame:
        paths = [self._slice_path(part) for part in sorted(parts, key=str)]
        if not paths:
            return self.spark.createDataFrame([], STORED_SCHEMA).select(*STORED_COLS)
        return (self.spark.read.schema(STORED_SCHEMA).option("basePath", self.data_path).parquet(*paths)
                .select(*STORED_COLS))

    def vectors(self, jobs: str | Iterable[str] | None = None) -> DataFrame:
        """The stored vectors as dense arrays, of the given job or jobs only where named (other files are not opened)."""
        return self.rows(jobs).select(*KEY_COLS, dense_of().alias("vector"))

    def rows(self, jobs: str | Iterable[str] | None = None) -> DataFrame:
        """The vectors of :meth:`vectors` in the form they are kept in (vector, positions, width)."""
        if jobs is None:
            return self._read(self.slices())
        wanted = {jobs} if isinstance(jobs, str) else set(jobs)
        return self._read(part for part in self.slices() if part[0] in wanted)

    # --- writes ------------------------------------------------------------
    @staticmethod
    def _shape(df: DataFrame) -> DataFrame:
        """``df`` with the stored columns; dense vectors come without positions and width."""
        kinds = {"positions": "array<int>", "width": "int"}
        return df.select("project_id", "job_id", "record_id", F.col("sub_key").cast("int"), F.col("vector").cast("array<float>"),
                         *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("record_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, vectors: DataFrame) -> set[Slice]:
        """Write rows as a new version; its slices, not yet visible.

        Rows are brought together by slice for files of even size; adaptive execution
        splits a slice that is larger than that over several tasks.
        """
        version = uuid.uuid4().hex[:12]
        path = self._version_path(version)
        (self._shape(vectors).select("*", self._bucket()).hint("rebalance", "job_id", "bucket")
         .write.partitionBy("job_id", "bucket").parquet(path))
        written = self.spark.read.schema(STORED_SCHEMA).parquet(path).select("job_id", "bucket").distinct()
        return {(r["job_id"], r["bucket"], version) for r in written.collect()}

    def append(self, vectors: DataFrame) -> None:
        """Add rows to their jobs (``create_tensors``)."""
        new = self._write(vectors)
        self._commit(self.slices() | new)

    def replace_jobs(self, vectors: DataFrame) -> None:
        """Replace whole jobs with ``vectors`` (jobs absent from it are untouched)."""
        new = self._write(vectors)
        jobs = {job for job, _, _ in new}
        self._commit({part for part in self.slices() if part[0] not in jobs} | new)

    def _touched(self, keys: DataFrame) -> set[Slice]:
        """Live slices of the jobs and buckets that the (job_id, record_id) of ``keys`` fall into."""
        hit = {tuple(r) for r in keys.select("job_id", self._bucket()).distinct().collect()}
        return {part for part in self.slices() if part[:2] in hit}

    def _rewrite(self, touched: set[Slice], kept: DataFrame, new: set[Slice] = frozenset()) -> None:
        """Replace the ``touched`` slices by the rows ``kept`` of them and add the slices ``new``."""
        rest = self._write(kept) if touched else set()
        self._commit((self.slices() - touched) | rest | set(new))

    def delete_records(self, ids: DataFrame) -> None:
        """Delete every vector of the given (job_id, record_id) pairs."""
        staging = fresh_path(self.spark, "deletes")
        ids.select("job_id", "record_id").distinct().write.parquet(staging)
        ids = self.spark.read.parquet(staging)
        touched = self._touched(ids)
        self._rewrite(touched, self._read(touched).join(ids, ["job_id", "record_id"], "left_anti"))
        delete_path(self.spark, staging)

    def delete_subkeys(self, keys: DataFrame) -> None:
        """Delete vectors by (job_id, record_id, sub_key); a null sub_key matches a null sub_key."""
        staging = fresh_path(self.spark, "deletes")
        keys.select("job_id", "record_id", F.col("sub_key").cast("int")).distinct().write.parquet(staging)
        keys = self.spark.read.parquet(staging)
        touched = self._touched(keys)
        cur = self._read(touched)
        cond = [cur["job_id"] == keys["job_id"], cur["record_id"] == keys["record_id"],
                cur["sub_key"].eqNullSafe(keys["sub_key"])]
        self._rewrite(touched, cur.join(keys, cond, "left_anti"))
        delete_path(self.spark, staging)

    def upsert(self, new_vectors: DataFrame, changes: DataFrame | None = None) -> None:
        """Delete the old vectors of the changed units and add the new ones, as one new state.

        A change without ``sub_key`` replaces every vector of its record; with a
        ``sub_key`` only that list entry. Duplicate changes collapse to one row.
        The new rows are computed and written once; their keys are read back from there.
        ``changes`` (job_id, record_id, sub_key; written) are further units whose old vectors go, such as
        whole records that now have fewer tokens.
        """
        new = self._write(self._shape(new_vectors).dropDuplicates(["job_id", "record_id", "sub_key"]))
        keys = self._read(new).select("job_id", "record_id", "sub_key")
        if changes is not None:
            keys = keys.unionByName(changes.select("job_id", "record_id", F.col("sub_key").cast("int"))).distinct()
        touched = self._touched(keys)
        whole = keys.filter(F.col("sub_key").isNull()).select("job_id", "record_id")
        entry = keys.filter(F.col("sub_key").isNotNull())
        kept = self._read(touched).join(whole, ["job_id", "record_id"], "left_anti") \
            .join(entry, ["job_id", "record_id", "sub_key"], "left_anti")
        self._rewrite(touched, kept, new)

    # --- exports -----------------------------------------------------------
    def export(self, job_ids: list[str] | None = None, force: bool = True, compression: str = "bzip2",
               partitions: int | None = None) -> None:
        """bzip2 CSV of each job's vectors, ordered by (record_id, sub_key).

        ``force`` replaces an existing export; otherwise an existing one is kept.
        The explicit range-partition count keeps compression spread over many
        tasks (AQE would otherwise fold a small export into one).
        """
        n = partitions or max(default_parallelism(self.spark), 1)
        v = self.rows(job_ids)
        wide = F.col("positions").isNotNull() & (F.col("width") > EXPORT_WIDTH)
        text = F.when(wide, F.to_json(F.struct("width", "positions", F.col("vector").alias("values")))) \
            .otherwise(F.to_json(dense_of()))
        # range partitions keep the (record_id, sub_key) order across part files and
        # split a large job over many tasks instead of one
        keys = ["job_id", "record_id", F.col("sub_key").asc_nulls_first()]
        out = (v.select("job_id", "record_id", "sub_key", text.alias("vector"))
               .repartitionByRange(n, *keys).sortWithinPartitions(*keys))
        w = out.write.option("header", True).option("compression", compression).partitionBy("job_id")
        if force:
            w.mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(self.exports_path)
        else:
            existing = set(list_partitions(self.spark, self.exports_path, "job_id"))
            fresh = out.filter(~F.col("job_id").isin(list(existing))) if existing else out
            (fresh.write.option("header", True).option("compression", compression).partitionBy("job_id")
             .mode("append").csv(self.exports_path))

    def read_export(self) -> DataFrame:
        """The exported vectors as dense arrays."""
        text, wide = F.col("vector"), F.col("vector").startswith("{")
        return (self.spark.read.option("header", True)
                .schema("record_id string, sub_key int, vector string, job_id string")
                .csv(self.exports_path)
                .select("record_id", "sub_key", "job_id", F.from_json(F.when(~wide, text), "array<float>").alias("_all"),
                        F.from_json(F.when(wide, text), "width int, positions array<int>, values array<float>").alias("_some"))
                .select("record_id", "sub_key", "job_id", F.col("_some.positions").alias("positions"),
                        F.col("_some.width").alias("width"), F.coalesce("_all", "_some.values").alias("vector"))
                .select("record_id", "sub_key", dense_of().alias("vector"), "job_id"))

    # --- search collection ------------------------------------------------------
    def build_collection(self, job_ids: list[str] | None = None, lsh_buckets: int = 0, seed: int = 7) -> None:
        """(Re)build the collection of the given jobs: unit vectors, optional random-hyperplane buckets."""
        v = self.rows(job_ids)
        c = normalize_df(v, "vector", "unit").select(*KEY_COLS, "unit", "positions", "width")
        if lsh_buckets:
            from ..operators.knn import hyperplane_signature
            c = c.withColumn("bucket", hyperplane_signature(F.col("unit"), lsh_buckets, seed, F.col("positions")))
        (c.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id")
         .parquet(self.collection_path))

    def collection(self) -> DataFrame:
        c = self.spark.read.parquet(self.collection_path)
        if "positions" not in c.columns:   # written before vectors were kept compact
            return c
        return c.withColumn("unit", dense_of("unit", "double")).drop("positions", "width")

    def drop_collection(self, job_id: str) -> None:
        self._drop(self.collection_path, job_id)

    def delete_job(self, job_id: str, drop_vectors: bool = False) -> None:
        """Remove a job's export, collection and model; vectors stay unless asked."""
        self._drop(self.exports_path, job_id)
        self.drop_collection(job_id)
        for name in MODEL_NAMES:
            for table in MODEL_TABLES:
                self._drop(f"{self.model_path(name)}/{table}", job_id)
        registry.unregister(self.spark, self.root, job_id)
        if drop_vectors:
            self._commit({part for part in self.slices() if part[0] != job_id})

    def model_jobs(self) -> list[tuple[str, str]]:
        """(model name, job_id) of every saved model."""
        return [(name, job) for name in MODEL_NAMES
                for job in list_partitions(self.spark, f"{self.model_path(name)}/{'means' if name == MODEL_PCA else 'vocab'}", "job_id")]

    def _drop(self, path: str, job_id: str) -> None:
        delete_path(self.spark, partition_path(self.spark, path, "job_id", job_id))
