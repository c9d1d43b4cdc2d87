"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, connected components.

Only DataFrame functions are used. Two 64-bit words x and y are made of each shingle, once; the k-th MinHash is the
least of x ^ (y << 3k), so that a signature costs a shift, an exclusive or and a minimum each. The three rows of a
band are 18 bits apart. Characters are units of UTF-16: those beyond U+FFFF count as two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut, fresh, partitions, release, table
from stowage.llm.components import connected_components

#: Characters of a shingle, bands and rows of a band: at similarity 0.8, 98.6 % of pairs share a band; at 0.9, 99.96 %.
SHINGLE, BANDS, ROWS, SIMILARITY = 8, 6, 3, 0.8
#: Shingles that are hashed for one row of the signature aggregation, two at least.
STEP = 16
#: Lines of a bucket that are compared in one piece; larger buckets go in pairs of blocks.
BLOCK = 1024
#: Words of 64 bits in which two lines' shingles are compared before the shingles are.
WORDS = 32
#: Rows of two longs that are broadcast at most.
BROADCAST = 1_000_000
#: Stands for the id of a document that has none: larger than any other.
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    """Lines of a text, in order, each different line once; none that is blank."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id is the greatest where it is missing; row tells rows of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h) for each line that is not blank, as often as it occurs."""
    found = _rows(docs).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return found.where(F.trim("line") != "").withColumn("h", F.xxhash64("line"))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_lines, hs, copy) per row: lines that are not blank, and the hashes of the different ones.

    copy numbers rows that are equal in doc_id and text, from 1.
    """
    found = _rows(docs).select("doc_id", "row", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("lines"))
    found = found.select("doc_id", "row", F.size("lines").alias("n_lines"), F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))).alias("hs"))
    return cut(found.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("n_lines"))))


def _units(line: str) -> Column:
    return F.encode(line, "UTF-16BE")


def _places(units: Column, shingle: int, step: int = 1) -> Column:
    """Bytes, from 1, at which every step-th shingle begins; a line that is shorter is a shingle itself."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(units) - (2 * shingle - 1), F.lit(1)), F.lit(2 * step))


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h, first, n, keys): for each different line its hash, least doc_id, how often it occurs, and band keys."""
    each, apart = range(bands * rows), 54 // (bands * rows)  # shift k * apart; rows of a band are bands * apart bits apart
    units = _lines(docs).select("doc_id", "h", _units("line").alias("p")).withColumn("last", F.greatest(F.octet_length("p") - (2 * shingle - 1), F.lit(1)))
    found = units.select("doc_id", "h", "p", "last", F.explode(_places(F.col("p"), shingle, STEP)).alias("i"))
    at = lambda j: F.least(F.col("i") + 2 * j, F.col("last")) if j else F.col("i")
    found = found.select("doc_id", "h", "i", *[F.xxhash64(F.substring("p", at(j), F.lit(2 * shingle))).alias(f"x{j}") for j in range(STEP)])
    found = found.select("*", *[F.xxhash64(f"x{j}").alias(f"y{j}") for j in range(STEP)])
    # within min(), each signature compiles to a method of its own; columns for all would make one method too large to compile well
    least = lambda k: F.least(*[F.col(f"x{j}").bitwiseXOR(F.shiftleft(f"y{j}", k * apart)) for j in range(STEP)])
    found = found.groupBy("h").agg(F.min("doc_id").alias("first"), F.sum(F.when(F.col("i") == 1, 1).otherwise(0)).alias("n"), *[F.min(least(k)).alias(f"s{k}") for k in each])
    keys = [F.xxhash64(F.lit(b), *[F.col(f"s{b + r * bands}") for r in range(rows)]) for b in range(bands)]
    return found.select("h", "first", "n", F.array(*keys).alias("keys"))


def _texts(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(h, line, size): one line of each hash in needed (h, doc_id), and how many different shingles it has."""
    if needed.count() <= BROADCAST:  # beyond it, both sides are dealt by hash
        needed = F.broadcast(needed)
    text = _lines(docs).join(needed, ["h", "doc_id"]).repartition("h").dropDuplicates(["h"])  # dealt first: few lines are twice in a document
    return text.select("h", "line", F.size(F.array_distinct(_shingles("line", shingle))).alias("size"))


def _shingles(line: str, shingle: int) -> Column:
    """Hashes of a line's shingles, in order. A bound value is read in place; a column would be copied for every shingle."""
    found = F.transform(F.array(_units(line)), lambda p: F.transform(_places(p, shingle), lambda i: F.xxhash64(F.substring(p, i, F.lit(2 * shingle)))))
    return F.element_at(found, 1)


def parities(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(h, size, bits): of each line 2048 bits, as a structure of longs; a bit is the parity of the number of different shingles that fall to it.

    Each bit in which two lines differ stands for at least one shingle that only one of them has, so the
    number of such bits is never over the size of the sets' symmetric difference.
    """
    each = texts.repartition(partitions(texts.sparkSession), "h").select("h", "size", F.explode(F.array_distinct(_shingles("line", shingle))).alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    # lines are dealt by h, so that neither sum is another shuffle
    words = each.groupBy("h", "size", F.shiftright("s", 6).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("w")).agg(F.bit_xor(bit).alias("x"))
    words = words.groupBy("h", "size").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("words"))
    return words.select("h", "size", F.struct(*[F.coalesce(F.element_at("words", F.lit(w)), F.lit(0).cast("long")).alias(f"k{w}") for w in range(WORDS)]).alias("bits"))


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines' shingle sets have at least the Jaccard similarity.

    a may be the same in many pairs: its line is joined last, where Spark can split the pairs of one a.
    """
    both = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("size").alias("sb")), "b")
    both = both.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("size").alias("sa")), "a")
    both = both.where(F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb"))
    common = F.size(F.array_intersect(_shingles("la", shingle), _shingles("lb", shingle)))
    # J >= s if the sets have s / (1 + s) of the sum of their sizes in common
    return both.where(common * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("sa") + F.col("sb")) - F.lit(1e-6)).select("a", "b")


def candidates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, h, n, first, center): lines by bucket, of the buckets with several, and, with a null key, lines with n over 1.

    center is the bucket's most frequent line.
    """
    known = signatures(docs, shingle, bands, rows)
    # lines with n over 1 get a bucket of their own, the last, so that all comes from one pass over the signatures
    own = F.concat("keys", F.array(F.xxhash64(F.lit(-1), "h")))
    member = known.select(F.posexplode(F.when(F.col("n") > 1, own).otherwise(F.col("keys"))).alias("at", "key"), "h", "n", "first")
    member = member.select("key", (F.col("at") == bands).alias("alone"), "h", "n", "first").repartition(partitions(docs.sparkSession), "key")
    bucket = member.groupBy("key").agg(F.count("*").alias("members"), F.max_by("h", "n").alias("center"), F.max("alone").alias("some"), F.min("first").alias("least"))
    # `least` is asked for so that both sides of the join read the same columns and share one exchange
    bucket = bucket.where((F.col("members") > 1) | F.col("some")).where(F.col("least") >= F.lit(-(1 << 63))).select("key", "center")
    met = member.join(bucket.hint("shuffle_hash"), "key")  # a row for each bucket of several
    return met.select(F.when(~F.col("alone"), F.col("key")).alias("key"), "h", "n", "first", "center")


def components(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """(h, root, first, keeper) for each line hash that occurs more than once or is linked to another.

    Lines link if their shingle sets' similarity is at least `similarity` and a band of their signatures agrees.
    In each bucket all members are compared with its most frequent line, then the others that are still in
    different components with each other. The second comparison looks at 2048 bits first, which bound the
    similarity from above: no pair of the similarity asked for is passed over.
    root: the component; first: least doc_id of the line; keeper: whether it is the component's one line.
    """
    found = cut(candidates(docs, shingle, bands, rows))
    release(docs.sparkSession)  # of the signatures
    member = found.where("key is not null")
    star = member.where("h <> center").select(F.col("center").alias("a"), F.col("h").alias("b")).distinct()
    texts = cut(_texts(docs, cut(member.groupBy("h").agg(F.min("first").alias("doc_id"))), shingle))
    roots = cut(connected_components(cut(_similar(star, texts, shingle, similarity))))

    # what the center is similar to is known
    label = member.where("h <> center").join(roots, F.col("h") == roots["node"], "left").select("key", "h", F.coalesce("root", "h").alias("label"))
    mixed = label.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    label = cut(label.join(mixed, "key"))
    some = texts.join(label.select("h").distinct(), "h")
    rest = _pairs(label.join(cut(parities(some, shingle)), "h"), similarity)
    more = cut(_similar(rest, texts, shingle, similarity))
    if not more.isEmpty():
        roots = _joined(roots, more)

    known = found.groupBy("h").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    shared = known.join(roots, known["h"] == roots["node"], "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"), "first")
    least = shared.groupBy("root").agg(F.min("first").alias("least"))
    keeper = shared.join(least, "root").where("first = least").groupBy("root").agg(F.min("h").alias("kept"))
    return shared.join(keeper, "root").select("h", "root", "first", (F.col("h") == F.col("kept")).alias("keeper"))


def _pairs(label: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for members (key, h, label, n, size, bits) of a bucket of n whose labels differ and that may be as similar.

    A bucket is cut into blocks of about BLOCK, and each pair of blocks is dealt apart.
    """
    label = label.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    label = label.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    label = label.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "h", "label", "size", "bits")
    keys = ["key", "low", "high"]
    other = label.select(*keys, F.col("own").alias("ob"), F.col("h").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("bits").alias("other"))
    differ = sum((F.bit_count(F.col("bits")[f"k{w}"].bitwiseXOR(F.col("other")[f"k{w}"])) for w in range(1, WORDS)), F.bit_count(F.col("bits")["k0"].bitwiseXOR(F.col("other")["k0"])))
    # of sets of a and b elements with J >= s, at most (a + b)(1 - s) / (1 + s) are in only one; the rest is for rounding
    close = differ * F.lit(1 + similarity) <= (F.col("size") + F.col("sb")) * F.lit(1 - similarity) + F.lit(1e-6)
    mine = label.withColumnsRenamed({"h": "a", "label": "la"})
    sizes = F.least("size", "sb") >= F.lit(similarity) * F.greatest("size", "sb")
    here = (F.least("own", "ob") == mine["low"]) & (F.greatest("own", "ob") == mine["high"])
    same = (mine["key"] == other["key"]) & (mine["low"] == other["low"]) & (mine["high"] == other["high"])
    return mine.join(other, same & (F.col("la") < F.col("lb")) & here & sizes & close).select("a", "b").distinct()


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) after the links more, which only components need to be linked by."""
    x = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    x = cut(x.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")))
    of = cut(connected_components(x, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("new")))
    new = x.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.node", "x.root")
    return cut(roots.union(new).distinct().join(of, "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def removals(docs: DataFrame, rows: DataFrame | None = None, **parameters) -> DataFrame:
    """(doc_id, row, removed): hashes of the lines that each document loses; documents that lose none are not listed.

    Of each component of lines one stays: that of the least doc_id, there the least hash; of several rows of that
    doc_id, or without one, in the row whose text has the least hash. A line that a document repeats stays at most
    once in it. Blank lines are no lines: they always stay. rows: hashed(docs), if it is there already.
    """
    found = components(docs, **parameters)
    at = (hashed(docs) if rows is None else rows).select("doc_id", "row", F.explode("hs").alias("h"))
    at = at.join(found.hint("shuffle_hash"), "h").select("doc_id", "row", "h", (F.col("keeper") & (F.col("doc_id") == F.col("first"))).alias("stays"))
    at = cut(at)
    del found
    release(docs.sparkSession)  # of the comparisons
    # rows of one doc_id, or without any, can all seem to keep a line
    several = at.where("stays").groupBy("h").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    more = at.where("stays").join(several, "h").where("row > least").select("doc_id", "row", "h")
    return at.where("not stays").select("doc_id", "row", "h").union(more).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("h")).alias("removed"))


def kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines of the hashes in removed, and without repetitions of its own lines."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    kept = F.filter(F.array_distinct(numbered), lambda x: F.startswith(x, F.lit("\n")) | ~F.array_contains(F.coalesce(removed, F.array().cast("array<bigint>")), F.xxhash64(x)))
    return F.array_join(F.transform(kept, lambda x: F.when(F.startswith(x, F.lit("\n")), F.regexp_replace(x, r"^\n\d+\n", "")).otherwise(x)), "\n")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the columns it has, its texts without the lines that removals() lists.

    A null text stays null, an empty one empty. Of rows that are equal in doc_id and text one keeps what the document
    keeps, the others lose all their lines. Very long texts are treated whole; columns beside doc_id and text are
    passed on. No documents give no rows.
    """
    key, row, removed, copy = fresh("key"), fresh("row"), fresh("removed"), fresh("copy")
    rows = hashed(docs)
    lost = removals(docs, rows, **parameters).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("removed").alias(removed))
    own = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(row, F.xxhash64("text"))
    number = F.lit(1) if rows.where("copy > 1").isEmpty() else F.row_number().over(Window.partitionBy(key, row).orderBy(key))
    joined = own.withColumn(copy, number).join(lost, [key, row], "left")
    gone = F.when(F.col(copy) > 1, F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(x))).otherwise(F.col(removed))
    new = F.when(F.col("text").isNotNull(), kept_text(F.col("text"), gone))
    return joined.withColumn("text", new).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, different ones, those removed by hash, and that number; corners are as in deduplicate()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = hashed(docs)
    out = rows.join(removals(docs, rows), ["doc_id", "row"], "left")
    removed = F.when(F.col("copy") > 1, F.array_sort("hs")).otherwise(F.coalesce("removed", F.array().cast("array<bigint>")))
    out = out.select("doc_id", "n_lines", F.size("hs").alias("n_distinct"), removed.alias("removed"))
    return out.select(F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_lines", "n_distinct", F.size("removed").alias("n_removed"), "removed")
