"""Benchmark decontamination, with DataFrame functions only.

A benchmark item of n word shingles is compared with item-sized windows (n consecutive shingles) of
the documents.  A window is placed to end at every shingle that an item of its size has.  The earliest
best window is among them: while its last shingle is none of the item's, the window one place earlier
shares as much, up to the start of the document.  So parts of an item may stand in any order.  Each window gets
a 64-bit SimHash of its shingles with their multiplicities.  A multi-index cuts fingerprints into
radius + 1 blocks: two fingerprints within the radius have an equal block (pigeonhole), so the index
returns all of them.  Candidates within the radius are then held to the exact weighted Jaccard
similarity.  A radius that holds nearly every pair at 0.8 is wide: blocks are two or three bits, so a
window meets most items of its size in the index, and it is the radius, not the index, that leaves
about 1 % of random pairs.  What keeps the work small is that windows are made about shared shingles only.

Cost at scale: one scan of the documents; hashing, the join with the items' shingles, the cut of the
windows, the index and the check are one stage without a shuffle while the benchmark is small enough to
broadcast (shingles, index rows and items are all bounded by the number of shingles, which is checked).
Beyond that the shingles of documents are joined by shuffle, without the texts' arrays, and windows are
cut by a join back on the documents that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most item shingles that are broadcast (about 60 bytes each, the index's rows included); more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Shingles that an item's rows in the index (24 bytes for each block) count for.
_INDEX_SHINGLES = 16
#: Shingles of a document that are held beside one of them at least.
PIECE = 2048


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order.  The words must be a column of their own: inside the
    function for each shingle, an expression would be computed again each time."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array of hashes: each bit by the majority of the array's elements."""
    ones = f"aggregate({hashes}, 0L, (n, h) -> n + (shiftright(h, b) & 1L))"
    return F.expr(f"coalesce(aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L)), 0L)")


def _blocks(blocks: int) -> list[tuple[int, int, str]]:
    """Number, first bit and mask of each block of 64 bits."""
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(i, sum(width[:i]), f"{(1 << w) - 1}L") for i, w in enumerate(width)]


def block_keys(fingerprint: str, size: str, blocks: int) -> Column:
    """(number, key) of each block of the fingerprint; the key holds the window size as well."""
    return F.array(*[F.expr(f"struct({i} as nth, xxhash64({size}, {i}, shiftrightunsigned({fingerprint}, {b}) & {m}) as key)") for i, b, m in _blocks(blocks)])


def first_equal_block(a: str, b: str, blocks: int) -> Column:
    """Number of the first block that two fingerprints have in common, so that a pair is taken once."""
    return F.expr("coalesce(" + ", ".join(f"if(shiftrightunsigned({a} ^ {b}, {at}) & {m} = 0L, {i}, null)" for i, at, m in _blocks(blocks)) + ")")


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of the smaller over sum of the larger multiplicities."""
    counted = f"aggregate(array_distinct({a}), 0L, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    both = f"if({plain}, cast(size(array_intersect({a}, {b})) as bigint), {counted})"
    return F.expr(f"{both} / (size({a}) + size({b}) - {both})")


def contaminations(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 23,
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """Returns document id, item id, similarity and start_word of the best window of each pair at `similarity` or more.

    Ties go to the earliest window.  At similarity 0.8 two SimHashes differ in about 10 of 64 bits
    (standard deviation 3), so the default radius holds all but about one window in a million.

    Defined cases: null or empty texts, and texts or items of fewer words than a shingle, match
    nothing; a document shorter than the item is one window; rows with one id are reported under it
    once; a null id is reported as null.
    """
    item = benchmark.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{item_text_col}`")).alias("w"))
    item = item.select("item", shingles(F.col("w"), shingle_words).alias("ih")).withColumn("n", F.size("ih"))
    # posexplode_outer: the plain form makes Spark filter on the array's size first, and compute it twice
    seed = item.select("n", F.posexplode_outer("ih").alias("q", "h")).where("h is not null").select("h", "n").distinct()
    item = item.withColumn("own", F.xxhash64("ih"))  # items of one id are told apart
    held = item.agg(F.count("*").alias("items"), F.sum("n").alias("shingles"), F.max("n").alias("longest")).first()
    many = (held["shingles"] or 0) + _INDEX_SHINGLES * held["items"] > broadcast_shingles
    small = (lambda d: d) if many else F.broadcast

    doc = documents.select(F.col(f"`{id_col}`").alias("doc"), words(F.col(f"`{text_col}`")).alias("w")).select("doc", shingles(F.col("w"), shingle_words).alias("hs"))
    # One window for each place and size; those that would begin before the document are its first.
    start = F.expr("greatest(0, p - n + 1)").alias("start")
    if many:  # rows without the arrays go through the shuffle; equal texts are told by a digest
        doc = doc.withColumn("digest", F.xxhash64("hs"))
        placed = doc.select("doc", "digest", F.posexplode_outer("hs").alias("p", "h"))
        met = placed.join(seed, "h").select("doc", "digest", "n", start).distinct()
        whole = doc.select(F.col("doc").alias("id"), F.col("digest").alias("of"), "hs").dropDuplicates(["id", "of"])
        window = met.join(whole, F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("doc", "n", "start", F.expr("slice(hs, start + 1, n)").alias("wh"))
    else:  # long texts in pieces, so that a shingle's row holds no more than a piece
        piece, longest = max(PIECE, held["longest"] or 0), held["longest"] or 0
        doc = doc.select("doc", "hs", F.explode_outer(F.expr(f"sequence(0, greatest(size(hs) - 1, 0), {piece})")).alias("at"))
        doc = doc.select("doc", "at", F.expr(f"greatest(0, at - {longest})").alias("begin"), "hs").select("doc", "at", "begin", F.expr(f"slice(hs, begin + 1, at + {piece} - begin)").alias("hs"))
        placed = doc.select("doc", "at", "begin", "hs", F.posexplode_outer("hs").alias("q", "h")).where("begin + q >= at").withColumn("p", F.expr("begin + q"))
        window = placed.join(small(seed), "h").select("doc", "n", start, "begin", "hs").select("doc", "n", "start", F.expr("slice(hs, start - begin + 1, n)").alias("wh"))
    window = window.withColumn("wf", simhash("wh"))

    blocks = radius + 1
    index = item.withColumn("f", simhash("ih")).select("item", "own", "f", F.explode_outer(block_keys("f", "n", blocks)).alias("k")).select("item", "own", "f", "k.key")
    keyed = window.select("doc", "start", "wh", "wf", F.explode_outer(block_keys("wf", "n", blocks)).alias("k")).select("doc", "start", "wh", "wf", "k.nth", "k.key")
    near = keyed.join(small(index), "key").where(f"bit_count(wf ^ f) <= {radius}").where(F.col("nth") == first_equal_block("wf", "f", blocks))
    texts = item.select(F.col("item").alias("id"), F.col("own").alias("of"), "ih").distinct()
    near = near.select("doc", "item", "own", "start", "wh").join(small(texts), F.col("item").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of")))
    alike = near.select("doc", "item", "start", weighted_jaccard("wh", "ih").alias("similarity")).where(F.col("similarity") >= similarity)
    best = alike.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start_word"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that hold a benchmark item; a null id is kept."""
    free = "_hit"
    while free.lower() in {c.lower() for c in documents.columns}:
        free += "_"
    hit = contaminations(documents, benchmark, id_col, **options).select(F.col(id_col).alias(free)).distinct()
    return documents.join(hit, F.col(f"`{id_col}`") == F.col(free), "left_anti")
