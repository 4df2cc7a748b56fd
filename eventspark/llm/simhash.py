"""Near-duplicate detection with SimHash and a segment-popcount embedding.

A fingerprint's sixteen 4-bit segments are mapped to their bit counts. Flipping one bit moves one count
by one, so the Manhattan distance of two such vectors is a lower bound of the Hamming distance. The range
join for distance 2 runs on the grid of these vectors: every fingerprint is dealt to the cell of its own
vector and to the cells one step away, and two vectors within distance 2 share a cell, the one halfway.
Cells with a single fingerprint are dropped. What is left is verified exactly: fingerprints differ in two
bits or fewer if and only if one pattern lies within one bit of both, so the candidates of a live cell
are grouped by the patterns of that cell. All members of such a group are linked, through its smallest
member; pairs inside a group are never spelt out, so a group of thousands costs as many rows.

Connected components come from alternating star steps with a checkpoint each.

Edge cases: null texts and texts without words have the fingerprint zero and link like any other; fewer
than three words are one shingle; repeated rows get the same result each; null ids count as larger than
all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, dropped, lower_words, sliced, table, written

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash over the XXH64 of all word shingles, repeats included; zero without words."""
    items = lower_words(text)
    if not items:
        return 0
    if len(items) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(items), seed)
    joined = b" ".join(items)
    ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)) + 1)
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    on = counts * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """key, fp (the 64 bits as a long) and th (a hash of the exact text) of every row."""

    def run(batches):
        for batch in sliced(batches):
            texts = column_bytes(batch, text)
            made = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made), batch.column("th")], names=[key, "fp", "th"])

    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long, th long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the sixteen segments, packed four bits each."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), fp.bitwiseAND(ones))


def links(fps: DataFrame, parts: int = 1) -> DataFrame:
    """a, b: each fingerprint of a linked group with the group's smallest. fps: distinct, column fp.

    With parts, a divisor of 64, the grid is made for each of so many parts of the fingerprints, and what links is one
    part that differs in two bits or fewer: any two fingerprints that differ in 3 * parts - 1 bits or fewer have one.
    """
    # one row becomes 65, so few rows are dealt to all tasks first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    # bit 64 stands for the pattern itself, and those after it for the patterns of further parts
    flipped = F.when(F.col("bit") < 64, F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).otherwise(F.col("fp"))
    if parts > 1:
        width = 64 // parts
        part = F.when(F.col("bit") < 64, F.floor(F.col("bit") / width)).otherwise(F.col("bit") - 64).cast("int")
        own = F.call_function("shiftrightunsigned", flipped, part * width).bitwiseAND(F.lit((1 << width) - 1))
        flipped = own.bitwiseOR(F.call_function("shiftleft", part.cast("long"), F.lit(width)))
    near = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63 + parts))).alias("bit")).select("fp", flipped.alias("pattern"))
    near = near.withColumn("cell", segment_counts(F.col("pattern")))
    live = near.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    met = near.join(live, "cell").select("fp", "pattern")
    groups = met.groupBy("pattern").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b <> hi").select("pattern", "b")
    return met.join(groups, "pattern").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of each node with an edge; edges: a, b of one ordered type."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # large star: every larger neighbour goes to the smallest
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        same = _same(now, after)
        dropped(now)
        if same:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def _same(x: DataFrame, y: DataFrame) -> bool:
    def digest(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    return digest(x) == digest(y)


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """key, fp, th, root (a fingerprint that names the group) and component_id (the group's smallest key) of every row."""
    prints = written(with_fingerprints(docs, text, key, shingle), "simhash")
    firsts = prints.groupBy("fp").agg(F.min(key).alias("first"))
    edges = written(links(firsts.select("fp")), "links")
    if edges.isEmpty():
        named = firsts.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    else:
        roots = components(edges).withColumnRenamed("root", "__root")
        rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("__root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select(key, "fp", "th", "root", "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", groups=grouped) -> DataFrame:
    """docs with one row of each group of near copies, the columns of docs.

    groups finds the groups: grouped(), or that of shingles. The row with the smallest key stays; of several texts under that key the one with the smallest hash,
    and of rows that repeat both, one.
    """
    found = written(groups(docs, key=key), "groups")
    smallest = found.where(F.col(key).eqNullSafe(F.col("component_id")))
    stay = smallest.groupBy("root").agg(F.min("th").alias("th"), F.first("component_id").alias("k")).select(F.col("k").alias("__k"), F.col("th").alias("__first"))
    hashed = docs.withColumn("__th", F.xxhash64("text"))
    kept = hashed.join(stay, hashed[key].eqNullSafe(stay["__k"]) & (F.col("__th") == F.col("__first")), "left_semi")
    if smallest.groupBy("root", "th").count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    return kept.dropDuplicates([key, "__th"]).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
