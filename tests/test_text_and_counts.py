import math

from pyspark.sql import functions as F

from tessera.functions.text import split_parts, words
from tessera.operators import count_embed

EDGE = [
    ("p", "r_null", None), ("p", "r_empty", ""), ("p", "r_one", "a"), ("p", "r_upper", "HELLO World"),
    ("p", "r_accent", "Élan café naïve"), ("p", "r_digits", "abc 123 x9"),
    ("p", "r_dup1", "same text here"), ("p", "r_dup2", "same text here"),
    ("p", "r_long", "word " * 3000),
]


def edge_units(spark):
    df = spark.createDataFrame(EDGE, "project_id string, record_id string, text string")
    return df.select(F.col("project_id").alias("job_id"), "record_id", F.lit(None).cast("int").alias("sub_key"),
                     "text")


def test_words_lowercase_letters_digits(spark):
    df = spark.createDataFrame([("HELLO, Wörld! x9 123",)], "text string")
    assert df.select(words(F.col("text"))).first()[0] == ["hello", "wörld", "x9", "123"]


def test_split_parts_cover_whole_text(spark):
    u = edge_units(spark)
    parts = split_parts(u, ["job_id", "record_id"], 200)
    got = {r["record_id"]: r["n"] for r in parts.groupBy("record_id").agg(F.sum("part_len").alias("n")).collect()}
    want = {r[1]: len(r[2]) for r in EDGE if r[2]}
    assert got == want
    assert parts.filter(F.col("record_id").isin("r_null", "r_empty")).count() == 0


def test_boc_zero_vector_for_empty_and_duplicates_equal(spark):
    u = edge_units(spark)
    m = count_embed.fit(u, "bag-of-characters")
    dense = {r["record_id"]: list(r["vector"]) for r in m.dense(u).collect()}
    width = m.stats().first()["width"]
    assert all(len(v) == width for v in dense.values())
    assert sum(dense["r_null"]) == 0 and sum(dense["r_empty"]) == 0
    assert dense["r_dup1"] == dense["r_dup2"]
    assert sum(dense["r_one"]) == 1
    assert sum(dense["r_long"]) == len("word " * 3000)


def test_tfidf_rows_unit_norm_and_unseen_terms_dropped(spark):
    u = edge_units(spark)
    m = count_embed.fit(u, "tf-idf")
    norms = m.transform(u).groupBy("record_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0, rel_tol=1e-9) for r in norms)
    new = u.sparkSession.createDataFrame([("p", "n1", None, "zzz unseen hello")],
                                         "job_id string, record_id string, sub_key int, text string")
    out = m.transform(new).collect()
    assert len(out) == 1 and math.isclose(out[0]["value"], 1.0)   # only 'hello' is known


def test_model_reload_gives_same_vectors(spark):
    u = edge_units(spark)
    m = count_embed.fit(u, "bag-of-words")
    again = count_embed.CountModel.load(spark, m.path)
    a = sorted(map(tuple, m.transform(u).collect()), key=repr)
    b = sorted(map(tuple, again.transform(u).collect()), key=repr)
    assert a == b


def test_repartitioning_changes_nothing(spark):
    u = edge_units(spark)
    m = count_embed.fit(u, "tf-idf")
    a = sorted(map(tuple, m.transform(u).collect()), key=repr)
    b = sorted(map(tuple, m.transform(u.repartition(5)).collect()), key=repr)
    assert a == b


def test_character_counts_of_any_text(spark, monkeypatch):
    from collections import Counter

    from tessera.functions import text
    monkeypatch.setattr(text, "COUNT_PIECE_BYTES", 5)      # pieces end inside characters
    texts = [None, "", "a", "Aa b\n\n", "\u00c4\u00e4\u20ac\U0001f600\U0001f600", "x\x00y" * 7, "\u20ac" * 1000 + "ab", "\u03a3\u0130"]
    rows = [(t and t.lower(), Counter(t.lower() if t else "")) for t in texts]
    for t, counts in rows:
        points, n = text._code_points((t or "").encode())
        assert dict(zip(map(chr, points), n.tolist())) == counts
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string")
    got = {}
    for r in text.term_counts(df, "chars", ["record_id"]).collect():
        got.setdefault(r["record_id"], {})[r["term"]] = r["n"]
    assert got == {i: dict(c) for i, (_, c) in enumerate(rows) if c}
    assert text.term_counts(df.limit(0), "chars", ["record_id"]).count() == 0


def test_counts_of_a_batch_equal_counts_of_its_texts():
    import numpy as np

    from tessera.functions import text
    texts = ["", "añb\U0001f600a", "x" * 50, "zz"] * 30
    for some in ([t.encode() for t in texts], [b"ok", b"\xe2\x82", b"\xac a", b""], [b"", b""], [b"aab"]):
        ends = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        got = zip(*text._count_piece(np.frombuffer(b"".join(some), dtype=np.uint8), ends))
        assert [tuple(map(int, g)) for g in got] == [
            (i, int(p), int(n)) for i, t in enumerate(some) for p, n in zip(*text._code_points(t))]
    assert list(text._pieces(np.array([0, 3, 3, 3 + text.COUNT_PIECE_BYTES * 2, 4 + text.COUNT_PIECE_BYTES * 2]))) == \
        [slice(0, 2), slice(2, 3), slice(3, 4)]


def test_counting_characters_takes_memory_by_the_piece():
    """12 MB of texts, and one text of 12 MB, are counted within 30 MB (170 before)."""
    import tracemalloc

    import numpy as np

    from tessera.functions import text
    word = "a few words in one text, né 1798; ".encode()
    for copies in (1, 350_000):
        one = word * copies
        n = 12_000_000 // len(one) or 1
        data, ends = np.frombuffer(one * n, dtype=np.uint8), np.arange(n + 1, dtype=np.int64) * len(one)
        tracemalloc.start()
        total = sum(int(text._count_piece(data, ends[p.start:p.stop + 1])[2].sum()) for p in text._pieces(ends))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == n * len(one.decode()) and peak < 30e6
