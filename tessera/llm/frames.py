"""Reading, staging and typing helpers of the llm operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nullable(schema: T.StructType) -> T.StructType:
    """The same fields, all nullable (what a Parquet round trip returns)."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (nulls count nothing)."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def crc_fold(col) -> "F.Column":
    """crc32 of the id written as text, modulo 5; null ids are treated as an empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def large_text(column: pa.Array) -> pa.LargeStringArray:
    """A text column without nulls (null reads as empty) and with 64-bit offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())
