"""Vector column expressions and long/dense conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROUND_PLACES


def r6(c: Column) -> Column:
    """Round to the comparison precision and remove negative zero."""
    return F.round(c, ROUND_PLACES) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long numeric arrays (JVM higher-order functions)."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize_df(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out`` = L2-normalised ``col`` (the norm is computed once per row); zero stays zero."""
    tmp = f"_{out}_norm"
    df = df.withColumn(tmp, norm(F.col(col)))
    return df.withColumn(out, F.transform(F.col(col).cast("array<double>"),
                                          lambda x: F.when(F.col(tmp) > 0, x / F.col(tmp)).otherwise(F.lit(0.0)))
                         ).drop(tmp)


def to_long(df: DataFrame, keys: list[str], vec_col: str = "vector") -> DataFrame:
    """(keys, position, value) from an array column."""
    return df.select(*keys, F.posexplode(F.col(vec_col).cast("array<double>")).alias("position", "value"))


def densify(values: Column, positions: Column, width: Column, of: str = "float") -> Column:
    """Dense array of ``width`` from the ``values`` at ascending, distinct ``positions``; zeros elsewhere.

    Both arrays must be columns of the input, as the lambda reads them once an entry.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast(of), n)
    before = lambda i: F.coalesce(F.get(positions, i - 1), F.lit(-1))
    runs = F.transform(positions, lambda p, i: F.concat(zeros(p - before(i) - 1), F.array(F.get(values, i))))
    return F.concat(F.flatten(runs), zeros(width - 1 - before(F.size(positions))))


def dense_of(col: str = "vector", of: str = "float") -> Column:
    """``col`` of a compact row (``col``, positions, width) as a dense array: as it is where positions are null."""
    return F.when(F.col("positions").isNull(), F.col(col)).otherwise(
        densify(F.col(col), F.col("positions"), F.col("width"), of))


def compact(long_df: DataFrame, units: DataFrame, keys: list[str], widths: DataFrame) -> DataFrame:
    """(keys, vector array<float>, positions array<int>, width) of every unit from sparse (keys, position, value) rows.

    The first of ``keys`` names the job, of which ``widths(job, width)`` gives the vectors' width. Where that is
    shorter, ``vector`` holds only the values at ``positions``; otherwise it is dense and ``positions`` null.
    Memory is bounded by the unit's own terms, whatever the width: a vocabulary of 100,000 words costs a text
    of 300 words 300 entries. A unit that comes n times gets n rows.
    """
    entry = F.struct(F.col("position").cast("int").alias("position"), F.col("value").cast("float").alias("value"))
    marks = units.select(*keys, F.lit(None).cast("struct<position:int,value:float>").alias("_e"))
    both = long_df.select(*keys, entry.alias("_e")).unionByName(marks)
    g = both.groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias("_all"),
                                F.count(F.when(F.col("_e").isNull(), 1)).cast("int").alias("_n"))
    last = lambda e, i: ~F.get(F.col("_all.position"), i + 1).eqNullSafe(e["position"])
    # only a unit that comes several times can have a position twice
    g = g.select(*keys, F.when(F.col("_n") == 1, F.col("_all")).otherwise(F.filter("_all", last)).alias("entries"),
                 F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy"))
    return shaped(g, keys, widths)


def shaped(rows: DataFrame, keys: list[str], widths: DataFrame) -> DataFrame:
    """The rows of :func:`compact` from (keys, entries), arrays of (position, value) by ascending, distinct positions."""
    g = rows.select(*keys, F.col("entries.position").cast("array<int>").alias("_p"),
                    F.col("entries.value").cast("array<float>").alias("_v")).join(widths, keys[0])
    sparse = F.size("_p") * 3 < F.col("width")
    width = F.col("width").cast("int")
    return g.select(*keys, F.when(sparse, F.col("_v")).otherwise(densify(F.col("_v"), F.col("_p"), width)).alias("vector"),
                    F.when(sparse, F.col("_p")).alias("positions"), width.alias("width"))
