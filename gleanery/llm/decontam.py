"""Benchmark decontamination by fingerprints of item-sized windows.

Items and documents are sequences of words (runs of letters and digits, lower case); their shingles are five words, or
all words of an item that has fewer. A window of a document has as many words as an item. Its similarity to the item is that of
their bags of shingles: the sum of the smaller counts over the sum of the larger ones. A document leaks an item if a
window reaches `similarity`.

1. A window that shares no shingle with any item has similarity 0, and moving a window's start past a shingle that no item has
   takes nothing from it; so windows start at documents' shingles that items have, and have the sizes of those items.
2. Windows and items get 64-bit SimHash fingerprints. Their eight blocks of eight bits are a multi-index: if two
   fingerprints differ in `radius` bits at most, some block differs in radius // 8 at most, so each item is posted under
   every block value that near, and a join on (size, block, value) meets every pair within the radius. At a similarity of
   0.75 fingerprints differ in 11 bits on average, with a deviation of 3; the default radius is four deviations further.
3. Pairs within the radius are verified by exact similarity.

Everything is DataFrame expressions. Scale: one pass over the documents with no shuffle of text; the items' shingles and
blocks (some 20 kB an item) are broadcast up to `broadcast_items` items and shuffled beyond; then a document's shingles are shuffled with their
places, and what's left of those meets the document's array again, once. What is shuffled besides is windows at shared shingles; pairs meet by equality on (size, block, value) and are tried in the first block that fits only.

Defined cases: null and empty texts and items without words leak nothing and aren't leaked; repeated items are items of their
own, repeated rows and rows of one doc_id are one document, rows with a null doc_id one more; documents shorter than an item
are one window of what they have; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BLOCKS, BITS = 8, 8


def once(value: Column, f) -> Column:
    """f of a value that is evaluated once a row: it travels through a lambda's variable, so that no rewriting of
    projections can put the whole expression in the place of each use."""
    return F.get(F.transform(F.array(value), f), 0)


def words(text: Column) -> Column:
    """Hashes of a text's words."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    none = F.array().cast("array<long>")
    return once(hashes, lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(none))


def simhash(bag: Column) -> Column:
    """Each bit is what most of the bag's hashes have there. Counts of four bits share a long, in lanes of 16."""
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def lanes(own: Column) -> Column:
        count = lambda j: F.aggregate(own, F.lit(0).cast("long"), lambda a, h: a + shift(h, j).bitwiseAND(F.lit(0x0001000100010001)))
        return F.struct(F.size(own).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(15)), count).alias("counts"))

    def bits(s: Column) -> Column:
        most = lambda b: shift(F.get(s["counts"], b % 16), (F.floor(b / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF)) * 2 > s["n"]
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(most(b), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))

    return once(once(bag, lanes), bits)


def block(fingerprint: Column, j: Column | int) -> Column:
    j = F.lit(j) if isinstance(j, int) else j
    return F.call_function("shiftrightunsigned", fingerprint, j * BITS).bitwiseAND(F.lit(255)).cast("int")


def similarity_of(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of two bags."""
    count = lambda bag, h: F.size(F.filter(bag, lambda x: x == h))
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, radius: int = 23, broadcast_items: int = 4000) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, window_start (word), similarity, of the best window."""
    source = common.documents(docs)
    known = words(F.col("text").cast("string"))
    items = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), known.alias("hashes"))
    items = items.withColumn("width", F.least(F.lit(SHINGLE), F.size("hashes"))).where("width > 0")
    bag = F.when(F.col("width") == SHINGLE, shingles(F.col("hashes"), SHINGLE))
    for width in range(1, SHINGLE):
        bag = bag.when(F.col("width") == width, shingles(F.col("hashes"), width))
    items = common.written(items.select("number", "item_id", "width", bag.alias("bag")).withColumn("size", F.size("bag")).withColumn("fingerprint", simhash(F.col("bag"))))

    # The items' widths are at most five values; their number and longest size are one row.
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    counted = items.agg(F.count("*").alias("n"), F.max("size").alias("longest")).first()
    sent = counted.n <= broadcast_items
    small = (lambda df: F.broadcast(df)) if sent else (lambda df: df)
    posted = items.select("width", "size", F.explode(F.array_distinct("bag")).alias("shingle")).groupBy("width", "shingle").agg(F.sort_array(F.collect_set("size")).alias("sizes"))

    found = None
    base = source.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words(F.col("text")).alias("hashes"))
    for width in widths:
        own = base.select("doc_id", "key", shingles(F.col("hashes"), width).alias("all"))
        at = own.select("doc_id", "key", "all", F.posexplode_outer("all").alias("start", "shingle"))
        # (The outer form, as the other one computes its array twice, once for a filter; the join drops its empty rows.)
        known = posted.where(F.col("width") == width).drop("width")
        if sent:
            at = at.join(F.broadcast(known), "shingle")
        else:
            # Places alone travel, and meet their document's shingles again: two of one key would only try more windows.
            hits = at.select("key", "start", "shingle").join(known, "shingle").groupBy("key").agg(F.collect_set(F.struct("start", "sizes")).alias("hits"))
            at = own.join(hits, "key").select("doc_id", "all", F.explode("hits").alias("hit")).select("doc_id", "all", "hit.start", "hit.sizes")
        at = at.select("doc_id", F.lit(width).alias("width"), "start", F.slice("all", F.col("start") + 1, F.lit(counted.longest)).alias("here"), F.explode("sizes").alias("size"))
        found = at if found is None else found.unionByName(at)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, window_start int, similarity double")
    windows = found.select("doc_id", "width", "size", "start", F.slice("here", F.lit(1), F.col("size")).alias("bag"))
    # A window too short for the similarity, at a document's end, can't reach it.
    windows = windows.where(F.size("bag") >= similarity * F.col("size")).withColumn("fingerprint", simhash(F.col("bag")))
    windows = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", block(F.col("fingerprint"), F.col("block")))

    near = radius // BLOCKS
    flips = [sum(1 << b for b in some) for k in range(near + 1) for some in combinations(range(BITS), k)]
    index = items.select("number", "width", "size", F.col("fingerprint").alias("item_fingerprint"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    index = index.withColumn("flip", F.explode(F.array(*map(F.lit, flips)))).withColumn("value", block(F.col("item_fingerprint"), F.col("block")).bitwiseXOR(F.col("flip"))).drop("flip")
    pairs = windows.join(small(index), ["width", "size", "block", "value"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    first = F.lit(True)
    for j in range(BLOCKS):
        first &= (F.col("block") <= j) | (F.bit_count(block(apart, j)) > near)
    pairs = pairs.where((F.bit_count(apart) <= radius) & first).drop("block", "value", "fingerprint", "item_fingerprint")
    pairs = pairs.join(small(items.select("number", "item_id", F.col("bag").alias("item_bag"))), "number")
    pairs = pairs.withColumn("similarity", similarity_of(F.col("bag"), F.col("item_bag"))).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    out = pairs.groupBy("doc_id", "number", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", F.col("best.start").alias("window_start"), F.col("best.similarity").alias("similarity"))


def op1_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
