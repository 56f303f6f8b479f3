"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of
``shingle`` words (repeats count; a shorter text is one shingle), XXH64 with
seed 42 of each; a bit is 1 if more than half of the hashes set it. A text
without words has fingerprint 0 and is linked like any other.

Links: two fingerprints within ``radius`` bits. Covering hashing: bit i is given
a non-zero vector phi(i) of radius + 1 binary digits, and table v (every
non-zero vector) keeps the bits with <phi(i), v> = 1. The up to ``radius``
differing bits of a pair span less than the whole space, so some v is
orthogonal to all of them and that table keeps none of them: every pair within
the radius collides in some table. Only fingerprints that collide with another
go on, and only the bits that their colliding tables ignore can differ.

Inside colliding buckets no pairs are listed: every fingerprint is filed under
all values it turns into by flipping up to radius / 2 of those bits (rounded
up; the other half may flip on the other side). Two fingerprints meet under a
value only if they are within the radius for an even radius, and each such pair
meets. A value holds at most its ball of fingerprints (65 for radius 2),
however many documents there are. Components come from alternating star rounds
over distinct fingerprints, each round written to the checkpoint folder.

Cases: null texts read as empty; repeated rows are one fingerprint; a row with
a null doc_id takes part but never names a component (component_id is null only
where no member has an id); empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import staged

SHINGLE = 3
RADIUS = 2
BITS = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text, as an unsigned integer."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[j:] for j in range(shingle))))
    hashes = np.array([_hash(g, 42) for g in grams], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


_hash = xxhash.xxh64_intdigest


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE,
                     keep_text: bool = True) -> DataFrame:
    """``docs`` plus the fingerprint as a signed long in column ``out`` (replacing one of that name)."""
    frame = docs.drop(out)
    names = [c for c in frame.columns if keep_text or c != text_col]
    schema = T.StructType([f for f in frame.schema.fields if f.name in names] + [T.StructField(out, T.LongType())])
    columns = frame.columns

    def mark(batches):
        for batch in batches:
            texts = batch.column(columns.index(text_col))
            # one text at a time: a list of a whole batch of long texts would be held twice
            prints = np.array([fingerprint(t.as_py() or "", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in names] + [pa.array(prints)],
                                             names=names + [out])

    return frame.mapInArrow(mark, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((i % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a > b, that connect exactly the distinct fingerprints in column fp linked within the radius.

    Every edge is a true link for an even radius; pairs in one ball are represented by a star.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).cast("long").alias("mask")) for t, m in enumerate(masks)])
    filed = prints.select("fp", F.explode(tables).alias("m")).select(
        "fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bucket"),
        F.bitwise_not(F.col("m.mask")).alias("free"))
    shared = filed.groupBy("t", "bucket").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("t", "bucket")
    colliding = filed.join(shared, ["t", "bucket"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    ball = colliding.select("fp", "free", F.col("fp").alias("point"), F.lit(-1).alias("last"))
    reach = ball
    for _ in range(radius // 2):
        bits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(1 << i)).cast("long").alias("bit")) for i in range(BITS)])
        reach = reach.select("fp", "free", "point", "last", F.explode(bits).alias("flip")).where(
            (F.col("flip.i") > F.col("last")) & (F.col("free").bitwiseAND(F.col("flip.bit")) != 0)).select(
            "fp", "free", F.col("point").bitwiseXOR(F.col("flip.bit")).alias("point"), F.col("flip.i").alias("last"))
        ball = ball.unionByName(reach)
    met = ball.groupBy("point").agg(F.collect_set("fp").alias("group")).where(F.size("group") > 1)
    return (met.select(F.array_min("group").alias("b"), F.explode("group").alias("a"))
            .where("a <> b").select("a", "b").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    Large-star and small-star rounds until nothing changes.
    """
    current = staged(edges.select("a", "b"), "links")
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        current = staged(small, "stars")
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
    raise RuntimeError("components did not settle")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; ``prints`` holds doc_id and fp, root is a fingerprint."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "fingerprints")
    rooted = distinct.join(components(links(distinct, radius)), distinct["fp"] == F.col("node"), "left").select(
        "fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits) and component_id."""
    marked = staged(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle, keep_text=False), "prints")
    found = groups(marked, radius)
    return marked.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays (its smallest doc_id), with the columns it came with.

    Rows that agree in doc_id and fingerprint count as the same document. Where no
    member has an id, one row of each fingerprint that has none stays.
    """
    mark = "_fingerprint_of_the_row"
    marked = staged(with_fingerprint(docs, out=mark, shingle=shingle), "prints")
    prints = marked.select("doc_id", F.col(mark).alias("fp"))
    chosen = groups(prints, radius).join(prints, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # one row of the component: its smallest fingerprint, if several rows share that id; other components may have the same id
    chosen = chosen.where("component_id IS NOT NULL").groupBy("root", "component_id").agg(F.min("fp").alias("fp")).select("component_id", "fp").unionByName(
        chosen.where("component_id IS NULL").select("component_id", "fp").distinct())
    kept = marked.join(chosen.select(F.col("component_id").alias("_kept_id"), F.col("fp").alias("_kept_fp")),
                       marked["doc_id"].eqNullSafe(F.col("_kept_id")) & (marked[mark] == F.col("_kept_fp")), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
