import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_bucket, hash_sign, py_bucket_sign
from tessera.functions.indexing import ordinal_within
from tessera.operators.pca import adler32_expr, sign_bits, term_signs_hex


def test_ordinal_within_matches_row_number_on_skewed_groups(spark):
    # one hot group holds a third of all rows
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 200}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = ordinal_within(df, ["g"], ["o"], "ord", num_partitions=8)
    want = df.withColumn("ord", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(map(tuple, got.select("g", "o", "ord").collect())) == \
        sorted(map(tuple, want.select("g", "o", "ord").collect()))
    # the hot group is spread over several tasks
    assert got.filter(F.col("g") == "hot").count() == 3000


def test_adler32_expression_matches_zlib(spark):
    names = ["src0", "a", "project-with-a-longer-name", "ümlaut"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(adler32_expr(F.col("n"))).collect()]
    assert got == [zlib.adler32(n.encode()) for n in names]


def test_hash_bucket_and_sign_match_python(spark):
    terms = ["hello", "wörld", "x9", "123", "a"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    got = [(r[0], r[1]) for r in df.select(hash_bucket(F.col("t")), hash_sign(F.col("t"))).collect()]
    assert got == [py_bucket_sign(t) for t in terms]


def test_sign_bits_follow_md5_bits(spark):
    df = spark.createDataFrame([(7, "term")], "seed long, t string")
    hx = df.select(term_signs_hex(F.col("seed"), F.col("t"))).first()[0]
    s = sign_bits([hx], 8)[0]
    first = int(hx[:2], 16)
    assert [1.0 - 2.0 * ((first >> (7 - j)) & 1) for j in range(8)] == s.tolist()
