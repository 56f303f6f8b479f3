import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                got = known.get(tuple(w[i:i + n]))
                if got is not None:
                    found |= got
                    hit.update(range(i, i + n))
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op3_benchmark_decontamination"](spark, SMALL).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    assert any(r[-1] for r in want)


def test_edges_blocks_and_short_items(spark, doc_rows):
    items = [(1, "quick brown fox"), (2, "fox JUMPS over the lazy dog and then it runs away into the deep"), (3, None),
             (4, "..."), (5, "quick brown fox"), (None, "wörds äre"), (7, "one"), (8, "word " * 40), (9, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [tuple(r) for r in doc_rows.select("doc_id", "text").collect()]
    want = brute(docs, [i for i in items if i[1] is not None])
    assert sorted((tuple(r) for r in D.digest(doc_rows, bench).collect()), key=str) == want
    # several blocks give the same rows
    blocks = D.matches(doc_rows, bench, block_bytes=40).select("doc_id", F.col("decontamination.n_hit")).collect()
    assert sorted(map(tuple, blocks), key=str) == sorted(((r[0], r[2]) for r in want), key=str)
    kept = D.decontaminate(doc_rows, bench)
    assert kept.columns == doc_rows.columns
    assert kept.count() == sum(not r[-1] for r in want)


def test_equal_texts_and_templates(spark):
    """A third of the items are one text, a third share a template; a third of the documents hold either."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen "
    items = ([(f"e{i}", "this very text stands in a third of all of the items") for i in range(300)]
             + [(f"t{i}", base + f"tail{i} and more of it") for i in range(300)] + [(f"x{i}", f"w{i} " * 12 + "end") for i in range(300)])
    docs = [(i, ["so this very text stands in a third of all of the items here", "x " + base + "tail7 and", f"w{i} " * 11 + base, "clean " * 20][i % 4]) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, items)
    for block_bytes in (D.BLOCK_BYTES, 4000):
        assert sorted((tuple(r) for r in D.digest(frame, bench, block_bytes=block_bytes).collect()), key=str) == want
        kept = D.decontaminate(frame.withColumn("n_hit", F.lit(7)), bench, block_bytes=block_bytes)
        assert sorted(tuple(r) for r in kept.collect()) == sorted((d, t, 7) for d, t in docs if d % 4 == 3)


def test_a_run_of_one_word_lists_no_pairs(spark, doc_rows):
    """40000 x 30000 pairs of equal words."""
    bench = spark.createDataFrame([(1, "word " * 40000), (2, "word " * 12 + "end")], "item_id long, text string")
    ids = hashlib.sha256(b"1,2").hexdigest()
    assert [tuple(r) for r in D.digest(doc_rows, bench).where("contaminated").collect()] == [(9, 30000, 30000, 2, ids, True)]
    m = D.matches(doc_rows, bench).where("doc_id = 9").first()["decontamination"]["matches"]
    assert [x["n_words"] for x in m if x["item_id"] == "1"] == [30000]
    assert {x["n_words"] for x in m if x["item_id"] == "2"} == {12}


def test_longest_matches_equal_brute_force(spark):
    import random
    rnd = random.Random(3)
    items = [(str(i), " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30)))) for i in range(20)]
    docs = [(i, " ".join(rnd.choice("abcd") for _ in range(60))) for i in range(20)]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=3)
    for row in got.collect():
        d, want = row["text"].split(), set()
        for item, text in items:
            t, last = text.split(), 0
            need = min(3, len(t))
            for p in range(len(d)):
                best = 0
                for q in range(len(t) - need + 1):
                    n = 0
                    while p + n < len(d) and q + n < len(t) and d[p + n] == t[q + n]:
                        n += 1
                    best = max(best, n if n >= need else 0)
                if best and best != last - 1:
                    want.add((item, p, best))
                last = best
        found = [(m["item_id"], m["doc_word"], m["n_words"]) for m in row["decontamination"]["matches"]]
        assert len(found) == len(set(found)) and set(found) == want
        for m in row["decontamination"]["matches"]:
            t = dict(items)[m["item_id"]].split()
            assert t[m["item_word"]:m["item_word"] + m["n_words"]] == d[m["doc_word"]:m["doc_word"] + m["n_words"]]


def test_longest_match_and_location(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y b c d z", "old")], "doc_id long, text string, decontamination string")
    bench = spark.createDataFrame([("q", "a b c d e f"), ("r", "b c d")], "item_id string, text string")
    m = D.matches(docs, bench, window=3).first()["decontamination"]["matches"]
    got = {(x["item_id"], x["item_word"], x["doc_word"], x["n_words"]) for x in m}
    assert got == {("q", 0, 1, 5), ("q", 1, 7, 3), ("r", 0, 2, 3), ("r", 0, 7, 3)}


def test_empty_tables(spark, doc_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(doc_rows, bench).count() == doc_rows.count()
    assert D.digest(doc_rows.limit(0), bench).count() == 0


def test_words_that_hash_alike_are_no_hits(spark):
    one, two = ("".join("ba"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"x {two.upper()} y {one}")], "doc_id long, text string")
    for items, want in (([("p", one)], {1: 1, 2: 0, 3: 1}), ([("q", two)], {1: 0, 2: 1, 3: 1}), ([("p", one), ("q", two)], {1: 1, 2: 1, 3: 2})):
        bench = spark.createDataFrame(items, "item_id string, text string")
        assert {r["doc_id"]: r["n_hit"] for r in D.digest(docs, bench).collect()} == want
