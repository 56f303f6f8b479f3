import math
import random

import numpy as np
import pytest

from tessera.llm import topk as K
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in sorted(ok, reverse=True)}.items()):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_exact_top_k"](spark, SMALL).collect())) == brute(rows)


def test_edges_ties_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), -0.5, 0.01 * i]) for i in range(90)] + [
        (100, None), (120, [1.0, None, 2.0]), (140, [nan, 1.0, 1.0]), (160, [1.0, inf, 0.0]), (180, [1.0]), (None, [1.0, 1.0, 1.0]),
        (200, []), (0, [0.0, -0.5, 0.0]), (7, [1.0, -0.5, 0.07]), (220, [-1.0, 1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    want = brute(rows)
    assert sorted(map(tuple, K.top_k(frame).collect())) == want
    assert sorted(map(tuple, K.top_k(frame, query_block=2).collect())) == want
    assert len(K.top_k(frame.limit(1)).collect()) == 0 and K.top_k(frame.limit(0)).count() == 0


def test_pruning_visits_fewer_blocks():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16)) * 40
    v = np.floor(np.repeat(centre, K.BLOCK, axis=0) + rng.normal(size=(40 * K.BLOCK, 16)))
    q, ids = v[::K.BLOCK], np.arange(len(v))
    best = K.Best(len(q), 20)
    visits = K.search_range(best, q, ids[::K.BLOCK], v, ids)
    assert visits < len(q) * 40 / 4
    scores = (q @ v.T).astype(np.int64)
    scores[np.arange(len(q)), ids[::K.BLOCK]] = K.NONE
    assert (best.score == np.sort(scores, axis=1)[:, ::-1][:, :20]).all()


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(64)]) for i in range(300)]
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect()
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_scores_beyond_a_long_are_refused(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e200, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a long does not hold"):
        K.top_k(rows).collect()
