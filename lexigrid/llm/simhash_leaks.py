"""Benchmark decontamination with SimHash windows (DataFrame and SQL functions only).

1. A window can only be similar to an item if it shares word shingles with it. So
   every document's shingles are looked up among the items' shingles. Each hit names
   all item-sized windows around it, wherever the shingle stands in the item. A
   window goes on if its hits are as many as the similarity needs at least: what they
   have in common is never more than that, so no similar window is lost.
2. Windows and items get 64-bit SimHash fingerprints of their words. The bits are
   cut into RADIUS + 1 blocks; two fingerprints at most RADIUS bits apart agree in
   at least one, so an equi-join on (item, block, value) finds all such pairs, each
   at the first block in which it agrees.
3. Weighted shingle similarity (weights: how often a shingle occurs; the sum of
   minima over the sum of maxima) verifies candidates exactly.

Shingles have SHINGLE words. A text with fewer is one shingle, so a shorter item
matches only a document that consists of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, join_small, table

SHINGLE = 5
PERCENT = 80
#: Bits in which fingerprints of a pair may differ. At a similarity of 0.8 a tenth of the words differ: about 10 bits.
RADIUS = 19
BITS = 64
#: First bit and width of each block.
BLOCKS = tuple((k * BITS // (RADIUS + 1), (k + 1) * BITS // (RADIUS + 1) - k * BITS // (RADIUS + 1)) for k in range(RADIUS + 1))


def words_of(text: Column) -> Column:
    """Lower-cased words, split at space and U+0009 to U+000D; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(hashes: Column) -> Column:
    """Hashes of all shingles in order, repeats included, from the hashes of the words."""
    n = F.size(hashes)
    whole = F.array(F.xxhash64(n, hashes))
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(hashes, i + k - 1) for k in range(SHINGLE)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, whole).otherwise(each)


def counted_off(shingles: Column) -> Column:
    """The n-th occurrence of a shingle as an element of its own: the sum of minima of two texts is what their sets share."""
    in_order = lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x)))
    return F.transform(F.array(F.array_sort(shingles)), in_order)[0]


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the words' hashes have it."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    votes = lambda b: F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(one) == one))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), none, lambda acc, b: acc.bitwiseOR(F.when(2 * votes(b) > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(none)))


def _block(print_: Column, k: int) -> Column:
    at, width = BLOCKS[k]
    return F.shiftright(print_, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _blocks(print_: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), _block(print_, k).alias("value")) for k in range(len(BLOCKS))])


def _first_block(differing: Column) -> Column:
    """The first block in which two fingerprints agree, from their XOR."""
    return F.coalesce(*[F.when(_block(differing, k) == 0, F.lit(k)) for k in range(len(BLOCKS))])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, window_start, window_words, hamming, similarity): each pair with its most similar window.

    Null and empty texts match nothing; rows that repeat an id give one pair; a row
    without an id is a document of its own text, and its pairs have a null id; items
    without an id are left out; extra columns are ignored; empty tables give an empty result.
    """
    found = _leaks(_named(docs), benchmark, percent)
    return found.select(F.when(F.col("anon") == 0, F.col("doc")).alias("doc_id"), "item_id", "window_start", "window_words", "hamming", "similarity")


def _named(docs: DataFrame) -> DataFrame:
    """(doc, anon, text): the id, and for rows without one a number made from their text."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("anon"), "text")


def _leaks(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    key = ["doc", "anon"]
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", hashes_of(words_of(F.col("text"))).alias("hashes")).filter(F.size("hashes") > 0)
    items = cut(items.select("item_id", F.size("hashes").alias("n_words"), simhash(F.col("hashes")).alias("item_print"), shingles_of(F.col("hashes")).alias("item_shingles")), "items")
    spots = items.select("item_id", "n_words", F.size("item_shingles").alias("item_size"), F.explode(F.array_distinct("item_shingles")).alias("shingle"))

    hashed = docs.select(*key, hashes_of(words_of(F.col("text"))).alias("hashes")).select(*key, F.size("hashes").alias("length"), F.posexplode(shingles_of(F.col("hashes"))).alias("at", "shingle"))
    sized = join_small(hashed, spots, ["shingle"]).withColumn("size", F.greatest(F.lit(1), F.least("n_words", "length") - SHINGLE + 1))
    # a pair at the threshold shares n: 100 * n >= percent * (size + item_size - n)
    hits = cut(sized.withColumn("needs", percent * (F.col("size") + F.col("item_size"))), "hits")
    enough = F.col("n") * (100 + percent) >= F.col("needs")
    many = hits.groupBy(*key, "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs")).filter(enough).select(*key, "item_id")
    around = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.greatest(F.lit(0), F.least(F.col("at"), F.col("length") - F.col("n_words"))))
    spans = join_small(hits, many, [*key, "item_id"], "left_semi").select(*key, "item_id", "n_words", "needs", F.explode(around).alias("start"))
    counted = spans.groupBy(*key, "item_id", "n_words", "needs", "start").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut(counted.filter(enough).select(*key, "item_id", "n_words", "start").distinct(), "windows")

    windows = wanted.select(*key, "n_words", "start").distinct()
    ids = windows.select(*key).distinct()
    texts = join_small(docs, ids, key, "left_semi").select(*key, hashes_of(words_of(F.col("text"))).alias("hashes"))
    sliced = windows.join(texts, key).select(*key, "n_words", "start", F.slice("hashes", F.col("start") + 1, F.col("n_words")).alias("hashes"))
    prints = cut(sliced.select(*key, "n_words", "start", simhash(F.col("hashes")).alias("print"), counted_off(shingles_of(F.col("hashes"))).alias("shingles")), "prints")

    place = [*key, "n_words", "start"]
    window_blocks = wanted.join(prints.select(*place, "print"), place).select(*place, "item_id", "print", F.inline(_blocks(F.col("print"))))
    item_blocks = items.select("item_id", "item_print", F.inline(_blocks(F.col("item_print"))))
    differing = F.col("print").bitwiseXOR(F.col("item_print"))
    near = join_small(window_blocks, item_blocks, ["item_id", "block", "value"]).filter(F.col("block") == _first_block(differing))
    candidates = near.select(*place, "item_id", "print", F.bit_count(differing).alias("hamming")).filter(F.col("hamming") <= RADIUS)

    known = items.select("item_id", counted_off(F.col("item_shingles")).alias("item_shingles"))
    verified = join_small(candidates.join(prints, [*place, "print"]), known, ["item_id"])
    scored = verified.withColumn("both", F.size(F.array_intersect("shingles", "item_shingles")))
    scored = scored.withColumn("either", F.size("shingles") + F.size("item_shingles") - F.col("both")).filter(F.col("both") * 100 >= percent * F.col("either"))
    best = scored.groupBy(*key, "item_id").agg(F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("back"), "n_words", "hamming")).alias("b"))
    return best.select(*key, "item_id", (-F.col("b.back")).alias("window_start"), F.col("b.n_words").alias("window_words"), F.col("b.hamming").cast("int").alias("hamming"), "b.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with the columns they came with.

    Rows that repeat an id go together if one of them holds a passage; a row without an
    id goes if its own text holds one.
    """
    ids = cut(_leaks(_named(docs), benchmark, PERCENT).select(F.col("doc").alias("_lx_doc"), F.col("anon").alias("_lx_anon")).distinct(), "leaking")
    named = docs.withColumn("_lx_doc", F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")).withColumn("_lx_anon", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    return join_small(named, ids, ["_lx_doc", "_lx_anon"], "left_anti").select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
