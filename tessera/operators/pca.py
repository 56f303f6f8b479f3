"""PCA per job: exact for narrow vectors, randomized (Halko et al. 2011) for wide sparse ones.

Choices: data are centred, not scaled; each component's sign is fixed so that
its largest-magnitude loading is positive; with fewer distinct rows or columns
than asked, min(k, rank) components are returned.

Narrow (dense ``array`` vectors, width ≤ ``NARROW_MAX``): every task sums
count, Σx and Σxxᵀ per job over its rows (numpy); the partial sums are added
per job and the d×d covariance is decomposed on the driver (d is bounded by
``NARROW_MAX``, the proof of the size). Transform is (x − μ)V in the workers
with the per-job (μ, V) broadcast.

Wide (sparse rows ``(job, unit, positions[], values[])``):
  1. X is written once, cut by terms into spans (:mod:`spans`); no table has a row a term;
  2. sketch ``Y = XΩ``, Ω's row for a term being ℓ ±1 signs read from the bits of ``md5(seed:term)``;
  3. per-job ``ΣY`` and ``ΣYᵀY`` (ℓ×ℓ) summed from per-task partials; centring
     is algebraic (``Yc = Y − ȳ``), the matrix is never densified;
  4. ``Q = (Y − ȳ) R`` with orthonormal columns, R from the ℓ×ℓ sums;
  5. ``POWER_ITERS`` power steps ``Y ← X·B`` with ``B = QᵀX``, each followed by 3 and 4: a task makes
     a span's rows of B and uses them at once, for its columns of Q and Y;
  6. a last product gives ``BBᵀ = Qᵀ(X XᵀQ) = ŨS²Ũᵀ`` (ℓ×ℓ), unit coordinates ``QŨS`` and the components
     ``V = BᵀŨS⁻¹ = XᵀG`` as factors X and ``G = QŨS⁻¹``.

Spans and chunks of Y are written to the shared work folder, so a lost executor recomputes one stage, not the whole chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, delete_path
from . import spans

NARROW_MAX = 4096
OVERSAMPLE = 16
POWER_ITERS = 2
BLOCK_ENTRIES = 1 << 16
UNIT_KEYS = ["job_id", "record_id", "sub_key"]


def _tick(label: str, t0: list) -> None:
    """Step timer, printed only when TESSERA_PROFILE is set."""
    import os
    import time
    if os.environ.get("TESSERA_PROFILE"):
        now = time.time()
        print(f"[pca] {label} {now - t0[0]:.1f}s", flush=True)
        t0[0] = now


def scatter_add(index: np.ndarray, weights: np.ndarray, rows: np.ndarray, take: np.ndarray, n_out: int) -> np.ndarray:
    """out[index[e], :] += weights[e] * rows[take[e], :] via one ``bincount`` per column.

    Avoids np.add.at (unbuffered) and never builds the full entries × width product.
    """
    out = np.empty((n_out, rows.shape[1]))
    for j, column in enumerate(np.ascontiguousarray(rows.T)):
        out[:, j] = np.bincount(index, weights=weights * column[take], minlength=n_out)
    return out


def _list_array(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(rows.ravel()))


def _block_product(units: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Y = X·B of one block of units, given the rows of B at the block's positions."""
    units, width = units.drop(columns="width"), int(units["width"].max()) if len(units) else 0
    y = np.zeros((len(units), width))
    lens = units["positions"].map(len).to_numpy()
    if len(b) and lens.sum():
        order = np.argsort(b["position"].to_numpy())
        known = b["position"].to_numpy()[order]
        positions = np.concatenate(units["positions"].to_list())
        at = np.minimum(np.searchsorted(known, positions), len(known) - 1)
        values = np.where(known[at] == positions, np.concatenate(units["values"].to_list()), 0.0)
        y = scatter_add(np.repeat(np.arange(len(units)), lens), values, np.vstack(b["b"].to_numpy()), order[at], len(units))
    return units.assign(y=list(y))


def with_blocks(rows: DataFrame) -> DataFrame:
    """Add ``block``: units of a job in blocks of about BLOCK_ENTRIES sparse entries, by a hash of the unit; ``rows`` are written."""
    entries = F.sum(F.size("positions").cast("long"))
    blocks = rows.groupBy("job_id").agg(F.ceil((entries + 1) / BLOCK_ENTRIES).alias("blocks"))
    return rows.join(broadcast_if_small(blocks), "job_id").withColumn(
        "block", F.pmod(F.xxhash64("record_id", "sub_key"), F.col("blocks"))).drop("blocks")


def needed_positions(rows: DataFrame) -> DataFrame:
    """The distinct (job_id, block, position) of blocked rows."""
    return rows.select("job_id", "block", F.explode(F.col("positions").cast("array<long>")).alias("position")).distinct()


def power_y(rows: DataFrame, needed: DataFrame, bcols: DataFrame) -> DataFrame:
    """``rows`` (written, with blocks) and y = X·B per unit; units without terms get a zero row.

    The join of ``needed`` with B is on (job, position): a frequent word counts once a block, not
    once a unit, and AQE splits what is still skewed. Units of jobs in which B has no direction get an empty y.
    """
    widths = bcols.groupBy("job_id").agg(F.max(F.size("b")).alias("width"))
    sized = rows.join(broadcast_if_small(widths), "job_id", "left").withColumn("width", F.coalesce("width", F.lit(0)))
    b = needed.join(bcols.select("job_id", "position", "b"), ["job_id", "position"])
    return (sized.groupBy("job_id", "block").cogroup(b.groupBy("job_id", "block"))
            .applyInPandas(_block_product, BLOCK_ROWS_SCHEMA))


# --- helpers -----------------------------------------------------------------

def fix_signs(v: np.ndarray) -> np.ndarray:
    """Columns of v flipped so the largest-|.| entry of each is positive."""
    if v.size == 0:
        return v
    idx = np.argmax(np.abs(v), axis=0)
    s = np.sign(v[idx, np.arange(v.shape[1])])
    s[s == 0] = 1.0
    return v * s


def sign_bits(hexes: np.ndarray, width: int) -> np.ndarray:
    """(n, width) matrix of ±1 from the first ``width`` bits of each 32-hex-digit md5.

    Bit j is bit (3 - j % 4) of hex digit j // 4 (big-endian), so SQL can read it too.
    Beyond 128 bits each further 128 come from the md5 of the hex digits before.
    """
    blocks, current = [], [str(h) for h in hexes]
    for _ in range(max(1, -(-width // 128))):
        blocks.append(np.frombuffer(b"".join(map(bytes.fromhex, current)), dtype=np.uint8).reshape(len(hexes), 16))
        if 128 * len(blocks) < width:
            current = [hashlib.md5(h.encode()).hexdigest() for h in current]
    bits = np.unpackbits(np.concatenate(blocks, axis=1), axis=1, bitorder="big")[:, :width]
    return 1.0 - 2.0 * bits.astype(np.float64)


def adler32_expr(name_col):
    """adler32 of a string column's UTF-8 bytes as a JVM expression (matches ``zlib.adler32``)."""
    b = F.encode(name_col, "UTF-8")
    n = F.octet_length(name_col)
    byte_at = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("long")
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    vals = F.transform(idx, lambda i: F.when(i <= n, byte_at(i)).otherwise(F.lit(0).cast("long")))
    a = F.aggregate(vals, F.lit(1).cast("long"), lambda acc, x: F.pmod(acc + x, F.lit(65521)))
    wsum = F.aggregate(F.transform(vals, lambda x, i: x * (n - i)), F.lit(0).cast("long"),
                       lambda acc, x: acc + x)
    bb = F.pmod(n + wsum, F.lit(65521))
    return (bb * 65536 + a).cast("long")


# --- narrow, exact -----------------------------------------------------------

PIECE_ROWS = 4096   # rows of a matrix that a worker makes at a time


def _job_matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(job, row numbers, matrix of their ``column``) in pieces of PIECE_ROWS; compact vectors (with a width) are filled in."""
    jobs = batch.column("job_id").dictionary_encode()
    codes = jobs.indices.fill_null(-1).to_numpy()
    lists = batch.column(column)
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    few = np.zeros(batch.num_rows, dtype=bool)
    if "width" in batch.schema.names:
        at = batch.column("positions")
        few = at.is_valid().to_numpy(zero_copy_only=False)
        at_offsets, at_flat = at.offsets.to_numpy().astype(np.int64), at.values.to_numpy(zero_copy_only=False)
        widths = batch.column("width").fill_null(0).to_numpy()
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for code, job in enumerate(jobs.dictionary.to_pylist()):
        of_job = np.flatnonzero(codes == code)
        lens = offsets[of_job + 1] - offsets[of_job]
        sizes = np.where(few[of_job], widths[of_job], lens) if few.any() else lens
        if (sizes != sizes[0]).any():
            raise ValueError(f"vectors of job {job} differ in width")
        for a in range(0, len(of_job), PIECE_ROWS):
            rows, n = of_job[a:a + PIECE_ROWS], lens[a:a + PIECE_ROWS]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            values = flat[np.repeat(offsets[rows], n) + inside]
            if not few[rows].any():
                yield job, rows, values.reshape(len(rows), int(sizes[0]))
                continue
            sparse = np.repeat(few[rows], n)
            inside[sparse] = at_flat[(np.repeat(at_offsets[rows], n) + inside)[sparse]]
            x = np.zeros((len(rows), int(sizes[0])))
            x[np.repeat(np.arange(len(rows)), n), inside] = values
            yield job, rows, x


def _moments(column: str):
    """Per task and job: sums, and the upper triangle of sums of products, one row per entry (i = -1: the sum)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, list] = {}
        for batch in batches:
            for job, _, x in _job_matrices(batch, column):
                a = acc.setdefault(job, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                a[0] += len(x)
                a[1] += x.sum(axis=0)
                a[2] += x.T @ x
        for job, (n, s, ss) in acc.items():
            d = len(s)
            i, j = np.triu_indices(d)
            where = [np.concatenate([[-2], np.full(d, -1), i]), np.concatenate([[0], np.arange(d), j])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([job] * len(where[0]), pa.string()), *(pa.array(w.astype(np.int64)) for w in where),
                 pa.array(np.concatenate([[float(n)], s, ss[i, j]]))], names=["job_id", "i", "j", "v"])
    return run


MOMENTS = "job_id string, i long, j long, v double"
FACTORS = "job_id string, position long, loadings array<double>"
MEAN = -1   # position of the factor row that holds the mean's coordinates


def moments(vectors: DataFrame, column: str) -> DataFrame:
    """(job_id, i, j, v): the sums of products of each job, i <= j; i = -1 the sums, i = -2 the number of rows."""
    return vectors.select("job_id", *_form(vectors, column)).mapInArrow(_moments(column), MOMENTS) \
        .groupBy("job_id", "i", "j").agg(F.sum("v").alias("v"))


def _form(vectors: DataFrame, column: str = "vector") -> list[str]:
    """The columns of ``column``, which may be compact."""
    return [column, *(c for c in ("positions", "width") if column == "vector" and "width" in vectors.columns)]


def _triangle(g: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of one job's rows of ``moments``."""
    i, j, v = g["i"].to_numpy(), g["j"].to_numpy(), g["v"].to_numpy()
    s = np.zeros(int((i == -1).sum()))
    s[j[i == -1]] = v[i == -1]
    ss = np.zeros((len(s), len(s)))
    part = i >= 0
    ss[i[part], j[part]] = v[part]
    ss[j[part], i[part]] = v[part]
    return int(v[i == -2][0]), s, ss


def _sum_moments(df: DataFrame) -> dict[str, tuple]:
    """job -> (n, sums, sums of products); added up by Spark, so the driver gets one triangle a job."""
    rows = df.groupBy("job_id", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    return {job: _triangle(g) for job, g in rows.groupby("job_id", sort=False)}


def _decompose(n: int, s: np.ndarray, ss: np.ndarray, k: int) -> dict:
    d = len(s)
    mean = s / max(n, 1)
    cov = (ss - n * np.outer(mean, mean)) / max(n - 1, 1)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    rank = int(np.sum(w > max(w[0], 0) * 1e-10)) if d else 0
    kk = max(0, min(k, rank, n - 1 if n > 1 else 0))
    return {"n": n, "mean": mean, "cov": cov, "components": fix_signs(v[:, :kk]), "explained": w[:kk]}


def _check_width(vectors: DataFrame) -> None:
    size = F.coalesce("width", F.size("vector")) if "width" in vectors.columns else F.size("vector")
    widest = vectors.agg(F.max(size)).first()[0] or 0
    if widest > NARROW_MAX:  # before any d x d table is built
        raise ValueError(f"width {widest} over the narrow PCA limit {NARROW_MAX}")


def narrow_fit(vectors: DataFrame, k: int) -> dict[str, dict]:
    """Per job: n, mean, covariance, components (d × min(k, rank)), explained variance.

    ``vectors(job_id, vector array)`` of width ≤ NARROW_MAX, dense or compact (with positions, width). The result per job
    is O(d²), bounded by the width limit.
    """
    _check_width(vectors)
    vectors = vectors.select("job_id", *_form(vectors))
    return {job: _decompose(n, s, ss, k)
            for job, (n, s, ss) in _sum_moments(vectors.mapInArrow(_moments("vector"), MOMENTS)).items()}


def narrow_factors(vectors: DataFrame, k: int) -> DataFrame:
    """(job_id, position, loadings): the components of :func:`narrow_fit` as a table, one row a position.

    The row of position ``MEAN`` holds the coordinates of the mean vector. Each job's d x d is
    decomposed in a task of its own; no factor passes the driver, whatever the number of jobs.
    """
    _check_width(vectors)

    def factors(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _decompose(*_triangle(pdf), k)
        rows = np.vstack([f["mean"] @ f["components"], f["components"]])
        return pd.DataFrame({"job_id": pdf["job_id"].iloc[0], "position": np.arange(MEAN, len(rows) - 1), "loadings": list(rows)})
    return moments(vectors, "vector").groupBy("job_id").applyInPandas(factors, FACTORS)


def narrow_components(vectors: DataFrame, k: int) -> dict[str, dict]:
    """Per job the mean and components of :func:`narrow_fit`, as :func:`narrow_transform` takes them.

    Each job's d x d is summed up and decomposed in a task; the driver gets d x k numbers a job.
    """
    _check_width(vectors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _decompose(*_triangle(pdf), k)
        return pd.DataFrame({"job_id": pdf["job_id"].iloc[:1], "mean": [f["mean"]], "components": [f["components"].ravel()]})
    rows = moments(vectors, "vector").groupBy("job_id").applyInPandas(
        fit, "job_id string, mean array<double>, components array<double>")
    return {r["job_id"]: {"mean": np.array(r["mean"]), "components": np.array(r["components"]).reshape(
        len(r["mean"]), -1 if r["components"] else 0)} for r in rows.toLocalIterator()}


def dense_rows(vectors: DataFrame) -> DataFrame:
    """Vectors as the sparse rows (job_id, record_id, sub_key, positions, values) that :func:`project` takes."""
    every = F.transform("vector", lambda _, i: i)
    return vectors.select(*UNIT_KEYS, (F.coalesce("positions", every) if "width" in vectors.columns else every).alias("positions"),
                          F.col("vector").cast("array<double>").alias("values"))


def project(rows: DataFrame, components: DataFrame, means: DataFrame) -> DataFrame:
    """(job_id, record_id, sub_key, vector): (x - mean) V of sparse ``rows`` (positions, values) by saved factors.

    ``components(job_id, position, loadings)`` has a row for each position, ``means(job_id, mean)`` the mean's
    coordinates. A block of units gets each row of V that it needs once. Positions without a row
    count as 0; units of a job without a direction (all its fitted rows alike) get ``[0.0]``.
    """
    spark = rows.sparkSession
    path = _fresh(spark, "rows-to-project")
    rows.select(*UNIT_KEYS, "positions", "values").write.parquet(path)
    # read twice, so that the two sides of the join have their own columns
    rows, again = (with_blocks(spark.read.parquet(path)) for _ in range(2))
    y = power_y(rows, needed_positions(again), components.withColumnRenamed("loadings", "b"))
    centred = F.zip_with("y", "mean", lambda a, m: a - m)
    return y.join(broadcast_if_small(means), "job_id", "left").select(
        *UNIT_KEYS, F.when(F.size("y") > 0, centred).otherwise(F.array(F.lit(0.0))).alias("vector"))


def narrow_transform(vectors: DataFrame, fitted: dict[str, dict], keys: list[str]) -> DataFrame:
    """(keys, vector array<double>) = (x − μ)V per row, using the job's fitted (μ, V)."""
    spark = vectors.sparkSession
    bc = spark.sparkContext.broadcast({j: (f["mean"], f["components"]) for j, f in fitted.items()})
    schema = T.StructType([vectors.schema[c] for c in keys] + [T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for batch in batches:
            for job, rows, x in _job_matrices(batch, "vector"):
                mean, comp = model[job]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), _list_array((x - mean) @ comp)],
                                                 names=[*keys, "vector"])
    return vectors.select(*keys, *_form(vectors)).mapInArrow(run, schema)


# --- wide, randomized ------------------------------------------------------------

def term_signs_hex(seed_col, term_col):
    """md5(seed:term) — the hex source of a term's sketch signs."""
    return F.md5(F.concat_ws(":", seed_col.cast("string"), term_col))


SKETCH_SCHEMA = "job_id string, record_id string, sub_key int, y array<double>"
BLOCK_ROWS_SCHEMA = ("job_id string, record_id string, sub_key int, positions array<int>, "
                     "values array<double>, y array<double>, block long")


def _slices(lens: np.ndarray) -> Iterator[slice]:
    """Runs of units with at most BLOCK_ENTRIES entries together (or a single unit)."""
    ends, a = np.cumsum(lens), 0
    while a < len(lens):
        before = ends[a] - lens[a]
        b = max(a + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")))
        yield slice(a, b)
        a = b


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lens = pdf["values"].map(len).to_numpy()
            y = np.zeros((len(pdf), width))
            for part in _slices(lens):
                n = int(lens[part].sum())
                if n:
                    y[part] = scatter_add(np.repeat(np.arange(part.stop - part.start), lens[part]),
                                          np.concatenate(pdf["values"].iloc[part].to_list()).astype(np.float64),
                                          sign_bits(np.concatenate(pdf["hexes"].iloc[part].to_list()), width),
                                          np.arange(n), part.stop - part.start)
            yield pdf[UNIT_KEYS].assign(y=list(y))
    return run


def sketch(rows: DataFrame, width: int) -> DataFrame:
    """(job_id, record_id, sub_key, y): Y = XΩ per row (not centred) of rows (job_id, record_id, sub_key, values, hexes)."""
    return rows.select(*UNIT_KEYS, "values", "hexes").mapInPandas(_sketch(width), SKETCH_SCHEMA)


def sketch_counts(counts: DataFrame, seed: Column, width: int) -> DataFrame:
    """Y = XΩ per unit from rows (job_id, record_id, sub_key, counts array of (term, n)), before any vocabulary.

    A term's row of Ω depends on the job's ``seed`` and the term alone, so a unit is projected inside its row.
    A unit that comes several times gets as many rows, each with the sum over all of them; one without terms or
    without a job gets zeros.
    """
    terms = F.when(F.col("job_id").isNull() | F.col("counts").isNull(), F.array().cast(counts.schema["counts"].dataType)) \
        .otherwise(F.col("counts"))
    rows = counts.select(*UNIT_KEYS, seed.alias("_seed"), terms.alias("_counts")).select(
        *UNIT_KEYS, F.col("_counts.n").cast("array<double>").alias("values"),
        F.transform("_counts", lambda c: term_signs_hex(F.col("_seed"), c["term"])).alias("hexes"))
    units = sketch(rows, width).groupBy(*UNIT_KEYS).agg(F.collect_list("y").alias("_all"))
    total = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(F.aggregate(
        "_all", F.array_repeat(F.lit(0.0), width), lambda a, y: F.zip_with(a, y, lambda x, v: x + v)))
    return units.select(*UNIT_KEYS, total.alias("y"), F.explode(F.array_repeat(F.lit(0), F.size("_all"))).alias("_copy")) \
        .drop("_copy")


def _orthonormaliser(n: int, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, R) with (Y - mean) R orthonormal on the directions above rounding noise."""
    mean = s / max(n, 1)
    w, v = np.linalg.eigh(ss - n * np.outer(mean, mean))
    keep = w > max(w.max(initial=0.0) * 1e-10, np.trace(ss) * 1e-12, 0.0)
    return mean, v[:, keep] / np.sqrt(w[keep])


def _chunk_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_moments` of the matrices y in chunks (job_id, n, y)."""
    acc: dict[str, list] = {}
    for job, n, y in _chunk_rows(batches, "y"):
        a = acc.setdefault(job, [0, 0.0, 0.0])
        a[0] += n
        a[1] = a[1] + y.sum(axis=0)
        a[2] = a[2] + y.T @ y
    for job, (n, s, ss) in acc.items():
        i, j = np.triu_indices(len(s))
        yield _moment_rows(job, n, s, i, j, ss[i, j])


def _chunk_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(job, n, matrix of each of ``columns``) of chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            yield (batch.column("job_id")[i].as_py(), n,
                   *(np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(n, -1) for c in columns))


def _moment_rows(job: str, n: int, s: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    d = len(s)
    where = [np.concatenate([[-2], np.full(d, -1), i]), np.concatenate([[0], np.arange(d), j])]
    return pa.RecordBatch.from_arrays(
        [pa.array([job] * len(where[0]), pa.string()), *(pa.array(w.astype(np.int64)) for w in where),
         pa.array(np.concatenate([[float(n)], s, v]))], names=["job_id", "i", "j", "v"])


@dataclass
class WidePCA:
    """A fitted wide PCA: the spans of the jobs' counts, the chunks of the Y that Q comes from, and whose their rows are.

    ``scaled`` maps a job to (mean, R, U, σ), U's columns with their signs.
    """

    spark: SparkSession
    where: spans.Layout
    spans_path: str
    chunks_path: str
    keys_path: str
    scaled: dict[str, tuple]
    means: dict[str, np.ndarray]

    def _chunks(self) -> DataFrame:
        return self.spark.read.parquet(self.chunks_path)

    def coordinates(self) -> DataFrame:
        """(job_id, record_id, sub_key, vector) of every unit; a job without any direction has one zero coordinate."""
        told = self.spark.sparkContext.broadcast(self.scaled)

        def of(job: str, y: np.ndarray) -> np.ndarray:
            mean, r, u, sv = told.value[job]
            return ((y - mean) @ r) @ u * sv
        return unit_vectors(self._chunks(), self.spark.read.parquet(self.keys_path), of)

    def save(self, path: str) -> None:
        """The tables ``spans`` (X), ``weights`` (G, a row a unit) and ``means`` of V = XᵀG; see ``plans.reduce``."""
        told = self.spark.sparkContext.broadcast(self.scaled)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for job, _, y in _chunk_rows([batch], "y"):
                    mean, r, u, sv = told.value[job]
                    out.append((((y - mean) @ r) @ (u / sv)).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("job_id", "at", "n")), pa.array(out, pa.binary())],
                                                 names=["job_id", "at", "n", "y"])
        with spans.few_rows(self.spark):
            self._chunks().mapInArrow(weigh, spans.CHUNK).write.options(**spans.LARGE_ROWS).parquet(f"{path}/weights")
        self.spark.read.parquet(self.spans_path).select("job_id", "span", *spans.PACKED).write.options(**spans.LARGE_ROWS).parquet(f"{path}/spans")
        rows = [(j, [float(x) for x in self.means[j]], self.where.terms[j], self.where.units[j]) for j in self.scaled]
        self.spark.createDataFrame(rows, "job_id string, mean array<double>, terms_a_span long, n_units long") \
            .coalesce(1).write.parquet(f"{path}/means")
        delete_path(self.spark, self.spans_path)


def unit_vectors(chunks: DataFrame, keys: DataFrame, of: Callable[[str, np.ndarray], np.ndarray]) -> DataFrame:
    """(job_id, record_id, sub_key, vector) of the chunks (job_id, at, n, y); ``of`` (job, y) gives the rows' vectors, ``keys`` whose they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                job, n, y = next(_chunk_rows([one], "y"))
                v = of(job, y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([job] * n, pa.string()), one.column("record_ids").flatten(), one.column("sub_keys").flatten(),
                     _list_array(v if v.shape[1] else np.zeros((n, 1)))], names=[*UNIT_KEYS, "vector"])
    return chunks.join(keys, ["job_id", "at"]).select("job_id", "at", "n", "y", "record_ids", "sub_keys").mapInArrow(
        run, "job_id string, record_id string, sub_key int, vector array<double>")


def randomized_fit(blocks: DataFrame, vocab: DataFrame, widths: dict[str, int], k: int, seed: Callable[[str], int],
                   power_iters: int = POWER_ITERS, own: bool = False) -> WidePCA:
    """Wide PCA per job of the word counts in ``blocks`` (``word_blocks.write``), units without words included.

    ``vocab(job_id, term, position)``, ``widths`` the number of terms of each job, ``seed`` of its sketch.
    ``own`` blocks are deleted when they have been read.
    """
    import time
    t0 = [time.time()]
    spark, width = blocks.sparkSession, k + OVERSAMPLE
    where = spans.layout(blocks, widths)
    keys = _fresh(spark, "unit-keys")
    spans.unit_keys(blocks, where).write.parquet(keys)
    x = spans.write(blocks, vocab, where, spans.signs(vocab, where, width, seed), own)
    _tick("spans", t0)

    def factorize(path: str) -> dict:
        sums = _sum_moments(spark.read.parquet(path).select("job_id", "n", "y").mapInArrow(_chunk_moments, MOMENTS))
        return {job: _orthonormaliser(n, s, ss) for job, (n, s, ss) in sums.items()}

    def multiplied(path: str, f: dict, keep: bool) -> str:
        """Y ← X·B with B = QᵀX (Xc·B up to the mean, removed again by the factorisation)."""
        y = spark.read.parquet(path)
        parts = spans.product(spark, x, where, width, y, where.units, f)
        out = spans.whole(parts, where, y if keep else None)
        delete_path(spark, path)
        delete_path(spark, parts.path)
        return out

    parts = spans.product(spark, x, where, width)
    y_path = spans.whole(parts, where)
    delete_path(spark, parts.path)
    _tick("sketch", t0)
    for _ in range(power_iters):
        y_path = multiplied(y_path, factorize(y_path), False)
        _tick("power step", t0)
    f = factorize(y_path)
    y_path = multiplied(y_path, f, True)
    _tick("last product", t0)

    told = spark.sparkContext.broadcast(f)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """BBᵀ = Qᵀ X XᵀQ and the sums of X XᵀQ, as rows of :func:`_moments`."""
        acc: dict[str, list] = {}
        for job, n, y, before in _chunk_rows(batches, "y", "x"):
            mean, r = told.value[job]
            y = y[:, :r.shape[1]]
            a = acc.setdefault(job, [0, 0.0, 0.0])
            a[0] += n
            a[1] = a[1] + y.sum(axis=0)
            a[2] = a[2] + ((before - mean) @ r).T @ y
        for job, (n, s, g) in acc.items():
            g = (g + g.T) / 2
            i, j = np.triu_indices(len(s))
            yield _moment_rows(job, n, s, i, j, g[i, j])
    chunks = spark.read.parquet(y_path)
    scaled, means, loads = {}, {}, {}
    for job, (n, s, g) in _sum_moments(chunks.select("job_id", "n", "y", "x").mapInArrow(grams, MOMENTS)).items():
        w, u = np.linalg.eigh(g)
        order = np.argsort(w)[::-1]
        w, u = w[order], u[:, order]
        kk = min(k, int(np.sum(w > max(w[0] if len(w) else 0, 0) * 1e-10)))
        u, sv = u[:, :kk], np.sqrt(w[:kk])
        mean, r = f[job]
        scaled[job], means[job] = (mean, r, u, sv), s / max(n, 1) @ (u / sv)
        loads[job] = (mean, r @ (u / sv))
    # sign fix: flip each component so its largest-|loading| entry is positive
    before = chunks.select("job_id", "at", "n", F.col("x").alias("y"))
    parts = spans.product(spark, x, where, k, before, where.units, loads, peaks=True)
    peaks: dict[str, np.ndarray] = {j: np.ones(k) for j in scaled}
    for r in parts.toLocalIterator():  # #jobs × k values
        v = np.frombuffer(r["y"], np.float64)
        peaks[r["job_id"]][r["part"]:r["part"] + len(v)] = v
    delete_path(spark, parts.path)
    for job, (mean, r, u, sv) in scaled.items():
        flip = np.where(peaks[job][:len(sv)] < 0, -1.0, 1.0)
        scaled[job], means[job] = (mean, r, u * flip, sv), means[job] * flip
    _tick("signs", t0)
    # X XᵀQ has served; the coordinates need Y alone
    kept = _fresh(spark, "chunks")
    with spans.few_rows(spark):
        before.write.options(**spans.LARGE_ROWS).parquet(kept)
    delete_path(spark, y_path)
    return WidePCA(spark, where, x, kept, keys, scaled, means)


def _fresh(spark: SparkSession, tag: str) -> str:
    from ..session import fresh_path
    return fresh_path(spark, tag)
