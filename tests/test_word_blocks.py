"""Words are looked up once a block of units; the vectors are those of a count by hand, wherever blocks end."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import count_embed, word_blocks

KEYS = ["job_id", "record_id", "sub_key"]
UNITS = "job_id string, record_id string, sub_key int, text string"


def _rows():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(30)] + ["été", "ß", "x" * 40]
    rows = [(f"j{i % 3}", f"r{i}", i % 2 or None, " ".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(60)]
    rows += [("j0", "empty", None, ""), ("j0", "null", None, None), ("j1", None, None, "w1 w2 w2"), (None, "lost", None, "w1")]
    return rows + [("j2", "twice", 4, "w3 W3 w4"), ("j2", "twice", 4, "w4 w5 w5 w5"), ("j2", "twice", 4, None)]


def _by_hand(rows, tfidf):
    """Vocabulary positions, and for each row its {position: value}."""
    df, n_units = defaultdict(Counter), Counter(r[0] for r in rows)
    for job, _, _, text in rows:
        df[job].update({w for w in (text or "").lower().split()})
    at = {job: {w: i for i, w in enumerate(sorted(words))} for job, words in df.items()}
    out, squares = [], Counter()
    for row in rows:
        job = row[0]
        weight = lambda w, n: n * (math.log((1 + n_units[job]) / (1 + df[job][w])) + 1) if tfidf else float(n)  # noqa: E731, B023
        out.append({at[job][w]: weight(w, n) for w, n in Counter((row[3] or "").lower().split()).items()})
        squares[row[:3]] += sum(v * v for v in out[-1].values())
    return [{p: v / math.sqrt(squares[row[:3]]) for p, v in o.items()} if tfidf else o for row, o in zip(rows, out)]


@pytest.mark.parametrize("model", ["bag-of-words", "tf-idf"])
@pytest.mark.parametrize("most", [1, 40, 1 << 19])
def test_vectors_are_those_of_a_count_by_hand(spark, monkeypatch, model, most):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", most)
    monkeypatch.setattr(count_embed, "BROADCAST_MAX_ROWS", 0)
    rows = _rows()
    units = spark.createDataFrame(rows, UNITS).repartition(5)
    by_hand = _by_hand(rows, model == "tf-idf")
    m, long = count_embed.fit_transform(units, model)
    got = sorted((str(r[:3]), r["position"], round(r["value"], 9)) for r in long.collect())
    assert got == sorted((str(row[:3]), p, round(v, 9)) for row, o in zip(rows, by_hand) if row[0] for p, v in o.items())
    assert sorted(m.transform(units).collect(), key=str) == sorted(long.collect(), key=str)

    merged = defaultdict(dict)   # copies of a unit share the words of all
    for row, o in zip(rows, by_hand):
        for p, v in o.items():
            merged[row[:3]][p] = max(v, merged[row[:3]].get(p, 0))
    widths = {r["job_id"]: r["width"] for r in m.stats().collect()}
    want = sorted((str(row[:3]), [round(merged[row[:3]].get(p, 0), 5) for p in range(widths[row[0]])]) for row in rows if row[0])
    assert sorted((str(tuple(r[:3])), [round(x, 5) for x in r["vector"]]) for r in m.dense(units).collect()) == want


def test_only_a_blocks_distinct_words_meet_the_vocabulary(spark):
    units = spark.range(400).select(F.lit("j").alias("job_id"), F.col("id").cast("string").alias("record_id"),
                                    F.lit(None).cast("int").alias("sub_key"), F.lit("a b c d a").alias("text"))
    blocks = word_blocks.write(units, KEYS)
    n_blocks = blocks.select("block").distinct().count()
    assert n_blocks <= spark.sparkContext.defaultParallelism
    assert blocks.filter("term is not null").count() == 4 * n_blocks    # not 4 a unit
    assert {tuple(r) for r in word_blocks.frequencies(blocks, "job_id").collect()} == {("j", t, 400) for t in "abcd"}


def test_unseen_words_drop_out_and_no_unit_is_lost(spark):
    m = count_embed.fit(spark.createDataFrame([("j", "1", None, "a b"), ("k", "1", None, "c")], UNITS), "bag-of-words")
    new = spark.createDataFrame([("j", "9", None, "b zzz b c"), ("j", "8", None, "zzz"), ("k", "9", None, None)], UNITS)
    assert [tuple(r) for r in m.transform(new).collect()] == [("j", "9", None, 1, 2.0)]
    assert {(r["job_id"], r["record_id"]): list(r["vector"]) for r in m.dense(new).collect()} == {
        ("j", "9"): [0.0, 2.0], ("j", "8"): [0.0, 0.0], ("k", "9"): [0.0]}
    assert m.transform(new.limit(0)).count() == 0 and m.compact(new.limit(0)).count() == 0


def test_blocks_keep_order_and_copies_and_stay_small():
    rows = [(f"{i // 7:03d}", ["w"] * (i % 5)) for i in range(210)] + [("999", None)]
    table = pa.table({"k": pa.array([r[0] for r in rows]), "words": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    for step in (1, 10, 1000):
        blocks = list(word_blocks._cut(iter(table.to_batches(max_chunksize=step)), 1, 50))
        assert [tuple(r.values()) for b in blocks for r in b.to_pylist()] == rows
        held = [set(b.column(0).to_pylist()) for b in blocks]
        assert sum(map(len, held)) == len(set.union(*held))             # no unit lies in two blocks
        assert all(sum(1 + len(r["words"] or []) for r in b.to_pylist()) <= 50 for b in blocks)
        assert len(blocks) < 25
