"""Dense 0-based ordinals inside groups, without putting a group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` moves each group to a single
task, so one hot group (a third of all rows) becomes one straggler. Here rows
are range-partitioned on (g, o) instead, so a hot group spans many tasks:

1. range-partition + sort, tag each row with (task, position in task);
2. write that staging table (this fixes the tags against recomputation and
   cuts lineage; it lives in the shared checkpoint folder);
3. per (task, group): row count and first position -- at most
   (#tasks + #groups) rows;
4. running sum of those counts per group in task order gives each task's
   offset inside the group;
5. ordinal = offset + position - first position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, fresh_path

_LOW_BITS = (1 << 33) - 1


def ordinal_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   out_col: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col``: 0-based position of each row inside its group.

    ``group_cols + order_cols`` must order the rows totally (ties would get an
    arbitrary but distinct ordinal).
    """
    spark = df.sparkSession
    keys = list(group_cols) + list(order_cols)
    n = num_partitions or default_parallelism(spark)
    staged_path = fresh_path(spark, "ordinal")
    (df.repartitionByRange(n, *keys)
       .sortWithinPartitions(*keys)
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.parquet(staged_path))
    staged = (spark.read.parquet(staged_path)
              .withColumn("_task", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    spans = (staged.groupBy("_task", *group_cols)
             .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first")))
    before = Window.partitionBy(*group_cols).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    spans = spans.select(F.col("_task").alias("_span_task"), *[F.col(c).alias(f"_span_{c}") for c in group_cols], "_off", "_first")
    same = [F.col("_task") == F.col("_span_task"), *[staged[c].eqNullSafe(F.col(f"_span_{c}")) for c in group_cols]]
    out = (staged.join(spans, same)
           .withColumn(out_col, F.col("_off") + F.col("_pos") - F.col("_first"))
           .drop("_mid", "_task", "_pos", "_off", "_first", "_span_task", *[f"_span_{c}" for c in group_cols]))
    return out
