"""Benchmark passages in documents: places of shared shingles, windows that hold enough of them, exact weighted shingles.

Only DataFrame functions are used.

1. Places of documents whose shingle no item has are passed over; the others are gathered by document and item.
2. Every item-sized window that holds as many of an item's places as the similarity takes is looked at,
   wherever in the item its shingles come from.
3. Shingles with their multiplicities decide, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import cut, fresh, table

#: Words of a shingle, and similarity from which a window counts.
SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint, bits of a block, and bits that a block may differ in; the radius is (NEAR + 1) * BLOCKS - 1.
BLOCKS, BITS, NEAR = 4, 16, 3
#: Rows of a few longs that are broadcast at most; beyond it, shingles are dealt by hash and so many salts.
BROADCAST, SALTS = 1_000_000, 16
#: Words of a document whose windows are looked at together, or those of the item if it has more.
SEGMENT = 8192


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; other characters but white space are left out."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of `width` words from a place on, counted from 0."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def _shingles(words: Column, width: Column) -> Column:
    """Hashes of all shingles of a window; width is that of the item, or the number of its words if that is less."""


    def wide(w: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - w, F.lit(0))), lambda i: _shingle(words, i, w))

    found = F.array().cast("array<bigint>")
    for w in range(1, SHINGLE + 1):
        found = F.when(width == w, wide(w)).otherwise(found)
    return found


def _block(fp: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, (b * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))


def hamming_candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(w, item_id) for all windows (w, size, fp) and items (item_id, size, fp) of one size within the radius.

    find() does without: of pairs of similarity 0.8, some have SimHashes that differ in more bits.
    """
    spark = windows.sparkSession
    masks = spark.range(1 << BITS).where(F.bit_count("id") <= NEAR).select(F.col("id").alias("mask"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    filed = items.select("item_id", "size", "fp", blocks.alias("b")).select("item_id", "size", F.col("fp").alias("ifp"), "b", _block(F.col("fp"), F.col("b")).alias("own"))
    masks = masks.agg(F.collect_list("mask").alias("masks"))  # 697 numbers
    filed = filed.join(F.broadcast(masks)).select("item_id", "size", "ifp", "b", F.explode(F.transform("masks", lambda m: m.bitwiseXOR(F.col("own")))).alias("key"))
    asked = windows.select("w", "size", "fp", blocks.alias("b")).select("w", "size", "fp", "b", _block(F.col("fp"), F.col("b")).alias("key"))
    met = asked.join(filed, ["size", "b", "key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) < (NEAR + 1) * BLOCKS)
    return met.select("w", "item_id").distinct()


def _common(window: Column) -> Column:
    """Shingles that a window shares with the item, with their multiplicities; window holds (at, s, times)."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("seen"), F.lit(0).alias("n"))

    def seen(a: Column, x: Column) -> Column:
        return F.when((a["seen"] > 0) & (a["s"] == x["s"]), a["seen"] + 1).otherwise(F.lit(1))

    same = F.array_sort(F.transform(window, lambda x: F.struct(x["s"].alias("s"), x["times"].alias("times"))))
    return F.aggregate(same, zero, lambda a, x: F.struct(x["s"].alias("s"), seen(a, x).alias("seen"), (a["n"] + (seen(a, x) <= x["times"]).cast("int")).alias("n")), lambda a: a["n"])


def _windows() -> Column:
    """(similarity, back) of every window that holds `need` of the hits; back is its start, negated.

    Windows that start after one hit and up to the next, i, hold i and those after it: with the one `need`
    places on, they hold enough.
    """
    at = lambda i: F.get("hits", i)["at"]

    def starts(i: Column) -> Column:
        low = F.greatest(at(i + F.col("need") - 1) - F.col("own") + 1, F.coalesce(at(i - 1) + 1, F.lit(0)), F.col("segment") * F.col("long"))
        high = F.least(at(i), F.col("n") - F.col("width") + 1 - F.col("own"), (F.col("segment") + 1) * F.col("long") - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def judged(i: Column, start: Column) -> Column:
        common = F.array(_common(F.filter(F.slice("hits", i + 1, F.col("own")), lambda x: x["at"] < start + F.col("own"))))
        return F.element_at(F.transform(common, lambda c: F.struct((c / (F.col("all") - c)).alias("similarity"), (-start).alias("back"))), 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: F.transform(starts(i), lambda start: judged(i, start))))


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, item_id, start, similarity) for each document and item of which a window is similar.

    start is the first word of the best window (the first of several), similarity its weighted Jaccard
    similarity. row is a hash of the text, by which rows of one doc_id, or without one, are told apart.
    Null and blank texts and items hold no words and match nothing; items of fewer than five words have one
    shingle, of all their words. A repeated item_id counts by each of its texts. Very long texts are looked at whole, in
    segments whose windows are judged apart. Columns beside doc_id, item_id and text are not read. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    items = cut(items.select("item_id", F.xxhash64("words").alias("t"), "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("width")).distinct())
    known = items.select("t", "words", "width").dropDuplicates(["t"]).select("t", F.size("words").alias("size"), "width", F.explode(_shingles(F.col("words"), F.col("width"))).alias("s"))
    known = cut(known.groupBy("t", "size", "width", "s").agg(F.count("*").cast("int").alias("times")))
    widths = [x.width for x in items.select("width").distinct().collect()]  # five at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, start int, similarity double")
    small = known.count() <= BROADCAST  # beyond it, places are dealt by the hash of their shingle

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), words_of(F.col("text").cast("string")).alias("words"))
    hits = None
    for width in widths:
        placed = own.where(F.size("words") >= width).select("doc_id", "row", F.size("words").alias("n"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
        placed = placed.select("doc_id", "row", "n", "at", _shingle(F.col("words"), F.col("at"), width).alias("s"))
        wanted = known.where(F.col("width") == width)
        if small:
            met = placed.join(F.broadcast(wanted), "s")
        else:
            salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            met = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "at"), F.lit(SALTS)).cast("int")).join(wanted.withColumn("salt", salts), ["s", "salt"])
        met = met.select("doc_id", "row", "t", "size", "width", "n", "at", "s", "times")
        hits = met if hits is None else hits.union(met)
    # shingles of a window and of the item, and how many a window must share
    hits = hits.withColumn("own", F.least("n", "size") - F.col("width") + 1).withColumn("all", F.col("own") + F.col("size") - F.col("width") + 1)
    hits = hits.withColumn("need", F.greatest(F.ceil(F.col("all") * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)).cast("int"), F.lit(1)))
    # a window belongs to the segment that it begins in; it ends there or in the next, which is no shorter than it
    hits = hits.withColumn("long", F.greatest(F.lit(SEGMENT), "own")).withColumn("segment", F.expr("at div long").cast("int"))
    before = F.when((F.expr("at % long") < F.col("own") - 1) & (F.col("segment") > 0), F.array(F.col("segment"), F.col("segment") - 1)).otherwise(F.array("segment"))
    hits = hits.withColumn("segment", F.explode(before))
    keys = ["doc_id", "row", "t", "segment", "n", "width", "own", "all", "need", "long"]
    hits = hits.groupBy(*keys).agg(F.collect_set(F.struct("at", "s", "times")).alias("hits"))
    hits = hits.where(F.size("hits") >= F.col("need")).withColumn("hits", F.array_sort("hits"))
    found = cut(hits.select("doc_id", "row", "t", F.array_max(_windows()).alias("x")).where(F.col("x.similarity") >= similarity))
    found = found.join(items.select("t", "item_id"), "t")
    best = found.groupBy("doc_id", "row", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "row", "item_id", (-F.col("x.back")).alias("start"), "x.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which find() finds no item, with all their columns."""
    key, row = fresh("key"), fresh("row")
    found = find(docs, benchmark, similarity).select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[row]), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, by item; corners are as in find()."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))
