"""Characters are placed in the unit's own row; only records that may have a unit twice are shuffled."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.vectors import compact
from tessera.operators import count_embed
from tessera.operators.hashed import hashed_model
from tessera.functions.hashing import py_bucket_sign
from tessera.schema import BOC
from tessera.session import broadcast_if_small

SCHEMA = "job_id string, record_id string, sub_key int, text string"


def frame(spark):
    rows = [("a", str(i), j, f"{chr(97 + i % 26)}Bé{j}") for i in range(30) for j in range(3)]
    rows += [("a", "empty", 0, ""), ("a", "null", None, None), ("b", "x", None, "aab"), ("a", None, 0, "zz")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(
        [("a", "twice", 0, "aa"), ("a", "twice", 0, "ab"), ("a", "twice", 1, "c"), ("a", "gap", 0, "d"), ("a", "gap", 5, "e"),
         ("b", "both", None, "a"), ("b", "both", 0, "b"), ("a", None, 4, "q"), ("a", "odd", 0, "x"), ("a", "odd", 0, "y"), ("a", "odd", 2, "z")], SCHEMA)


def collected(df):
    return sorted(map(repr, df.collect()))


def test_single_units_are_not_shuffled(spark):
    units, _ = frame(spark)
    model = count_embed.fit(units, BOC)
    plan = model.compact(units)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_rows_are_those_of_the_grouped_form(spark):
    one, more = frame(spark)
    units = one.unionByName(more)
    model = count_embed.fit(one.unionByName(more.filter("text <> 'q'")), BOC)    # a character that the model lacks
    again = {(r[0], r[1]) for r in count_embed.repeated_records(units).collect()}
    assert again == {("a", "twice"), ("a", "gap"), ("b", "both"), ("a", None), ("a", "odd")}
    widths = broadcast_if_small(model.stats().select("job_id", "width"))
    old = compact(model.transform(units), units, count_embed.UNIT_KEYS, widths)
    assert collected(model.compact(units)) == collected(old)


def test_hashed_model_sums_words_of_a_batch():
    got = hashed_model(8)(["a b a", "", "B", "..", "c c"])
    for text, v in zip(["a b a", "", "b", "", "c c"], got):
        x = np.zeros(8)
        for w in text.split():
            bucket, sign = py_bucket_sign(w, 8)
            x[bucket] += sign
        assert np.array_equal(v, x / (np.sqrt(x @ x) or 1))
