"""Digests of contents, and audits of grains, regions and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions.digest import block_digest, blocks_blake2s, digest_of_digests
from stowage.plans.registry import query
from stowage.sources import inventory as inv

BLOCK = 4096


def blocks(objects: DataFrame, size: int = BLOCK) -> DataFrame:
    """(oid, blk, data) of objects (oid, content): the last block has its own length, empty content has none."""
    n = F.expr(f"(octet_length(content) + {size - 1}) div {size}")
    rows = objects.withColumn("n", n).where("n > 0").select("oid", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("blk"))
    return rows.select("oid", "blk", F.substring("content", (F.col("blk") * size + 1).cast("int"), F.lit(size)).alias("data"))


def checksums(objects: DataFrame, size: int = BLOCK, profile: str = "blake2s") -> DataFrame:
    """(oid, csum): the digest of the ordered digests of each object's blocks, made in the object's own row."""
    if profile == "blake2s":
        return objects.select("oid", blocks_blake2s(F.col("content"), size).alias("csum"))

    def digests(content: Column) -> Column:
        n = F.ceil(F.octet_length(content) / size).cast("int")
        places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
        return F.transform(places, lambda i: block_digest(F.substring(content, i * size + 1, F.lit(size)), profile))

    # a value bound by transform is read in place; a column would be copied for every block
    each = F.transform(F.array(F.coalesce("content", F.lit("").cast("binary"))), lambda c: digest_of_digests(digests(c), profile))
    return objects.select("oid", F.element_at(each, 1).alias("csum"))


_BLOCKS = f"b AS (SELECT oid, n.blk, sha256(CAST(encode(text) AS BLOB)[(n.blk * {BLOCK} + 1):((n.blk + 1) * {BLOCK})]) AS dig FROM objects, LATERAL (SELECT unnest(range(0, (len + {BLOCK - 1}) // {BLOCK})) AS blk) n)"


@query("a1_block_count", f"SELECT oid, (len + {BLOCK - 1}) // {BLOCK} AS n FROM objects")
def a1_block_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.objects(spark, sf_dir).selectExpr("oid", f"(octet_length(content) + {BLOCK - 1}) div {BLOCK} as n")


@query("a2_block_digests_sha", f"WITH {_BLOCKS} SELECT oid, blk, dig FROM b")
def a2_block_digests_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(inv.objects(spark, sf_dir)).select("oid", "blk", block_digest(F.col("data"), "sha256").alias("dig"))


@query("a3_object_csum_sha", f"WITH {_BLOCKS} SELECT o.oid, sha256(CAST(unhex(coalesce((SELECT string_agg(dig, '' ORDER BY blk) FROM b WHERE b.oid = o.oid), '')) AS BLOB)) AS csum FROM objects o")
def a3_object_csum_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(inv.objects(spark, sf_dir), profile="sha256")


@query("a4_object_csum_blake2s")
def a4_object_csum_blake2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(inv.objects(spark, sf_dir))


@query("a5_hole_digests_sha", "SELECT n, sha256(CAST(unhex(repeat('00', CAST(n AS INTEGER))) AS BLOB)) AS dig FROM (VALUES (1), (100), (4096)) t(n)")
def a5_hole_digests_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of blocks that were never written."""
    sizes = spark.sql("select explode(array(1, 100, 4096)) as n")
    return sizes.select("n", block_digest(F.unhex(F.repeat(F.lit("00"), F.col("n"))), "sha256").alias("dig"))


@query("a6_verify_sha", f"WITH {_BLOCKS}, s AS (SELECT oid, blk, CASE WHEN blk = 1 THEN sha256(dig) ELSE dig END AS stored, dig FROM b) SELECT oid, count(*) AS n, count(*) FILTER (stored <> dig) AS bad FROM s GROUP BY oid")
def a6_verify_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose content isn't what its stored digest says; block 1 of every object is planted as damaged."""
    hashed = blocks(inv.objects(spark, sf_dir)).select("oid", "blk", block_digest(F.col("data"), "sha256").alias("dig"))
    stored = hashed.withColumn("stored", F.when(F.col("blk") == 1, F.sha2("dig", 256)).otherwise(F.col("dig")))
    return stored.groupBy("oid").agg(F.count("*").alias("n"), F.count_if(F.col("stored") != F.col("dig")).alias("bad"))


@query("a7_scrub_transitions_sha", f"WITH {_BLOCKS}, s AS (SELECT oid, bool_or(blk = 1) AS bad FROM b GROUP BY oid), f AS (SELECT oid, bad, CAST(substr(oid, 5) AS BIGINT) % 3 = 0 AS corrupt FROM s) SELECT oid, bad AS set_corrupt FROM f WHERE bad <> corrupt")
def a7_scrub_transitions_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose flag changes: set where a block is bad, cleared where none is; ids divisible by 3 are flagged before."""
    found = a6_verify_sha(spark, sf_dir).select("oid", (F.col("bad") > 0).alias("bad"))
    flagged = (F.substring_index("oid", ".", -1).cast("long") % 3 == 0).alias("corrupt")
    return found.select("oid", "bad", flagged).where("bad <> corrupt").select("oid", F.col("bad").alias("set_corrupt"))


@query("a19_verify_summary_sha", f"WITH {_BLOCKS}, s AS (SELECT oid, bool_or(blk = 1) AS bad, CAST(substr(oid, 5) AS BIGINT) % 3 = 0 AS corrupt FROM b GROUP BY oid) SELECT count(*) FILTER (NOT bad AND NOT corrupt) AS verified, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad AND corrupt) AS clean_but_flagged FROM s")
def a19_verify_summary_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = a6_verify_sha(spark, sf_dir).select((F.col("bad") > 0).alias("bad"), (F.substring_index("oid", ".", -1).cast("long") % 3 == 0).alias("corrupt"))
    return s.agg(F.count_if(~F.col("bad") & ~F.col("corrupt")).alias("verified"), F.count_if("bad").alias("failed"), F.count_if(~F.col("bad") & F.col("corrupt")).alias("clean_but_flagged"))


def read_range(objects: DataFrame, offset: int, length: int) -> DataFrame:
    """(oid, data): `length` bytes from `offset` of each object that is longer than the offset, cut at its end."""
    long = objects.where(F.octet_length("content") > offset)
    return long.select("oid", F.substring("content", offset + 1, length).alias("data"))


@query("s6_read_range", "SELECT oid, sha256(CAST(encode(text) AS BLOB)[4001:5000]) AS digest, greatest(0, least(len, 5000) - 4000) AS n FROM objects WHERE len > 4000")
def s6_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 bytes from offset 4000."""
    return read_range(inv.objects(spark, sf_dir), 4000, 1000).select("oid", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("n"))


def grain_audit(extents: DataFrame, bitmap: DataFrame) -> DataFrame:
    """(rule, grain): phantom (referred to, not marked), leaked (marked, not referred to), zero (grain 0 not marked)."""
    refs = extents.select("grain").distinct().withColumn("ref", F.lit(True))
    both = refs.join(bitmap.withColumn("marked", F.lit(True)), "grain", "full_outer")
    rule = F.when(F.col("marked").isNull(), "phantom").when(F.col("ref").isNull() & (F.col("grain") != 0), "leaked")
    found = both.select(rule.alias("rule"), "grain").where("rule is not null")
    zero = bitmap.where("grain = 0").agg(F.count("*").alias("n")).where("n = 0").select(F.lit("zero"), F.lit(0).cast("long"))
    return found.union(zero)


@query(
    "t1_grain_audit",
    """WITH r AS (SELECT DISTINCT grain FROM extents)
     SELECT 'phantom' AS rule, grain FROM r WHERE grain NOT IN (SELECT grain FROM bitmap)
     UNION ALL SELECT 'leaked', grain FROM bitmap WHERE grain <> 0 AND grain NOT IN (SELECT grain FROM r)""",
)
def t1_grain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grain_audit(inv.extents(spark, sf_dir), inv.bitmap(spark, sf_dir))


@query("w8_duplicate_grains", "SELECT grain, count(*) AS n, min(oid) AS a, max(oid) AS b FROM extents GROUP BY grain HAVING count(*) > 1")
def w8_duplicate_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.extents(spark, sf_dir).groupBy("grain").agg(F.count("*").alias("n"), F.min("oid").alias("a"), F.max("oid").alias("b")).where("n > 1")


@query("a14_page_free", "SELECT grain // 4096 AS page, 4096 - count(*) AS free FROM bitmap GROUP BY 1")
def a14_page_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.bitmap(spark, sf_dir).groupBy(F.expr("grain div 4096").alias("page")).agg((F.lit(4096) - F.count("*")).alias("free"))


@query("a15_rebuilt_bitmap", "SELECT DISTINCT grain FROM extents UNION SELECT 0")
def a15_rebuilt_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.extents(spark, sf_dir).select("grain").union(spark.range(1).select("id")).distinct()


@query(
    "a16_changed_pages",
    """WITH n AS (SELECT DISTINCT grain FROM extents UNION SELECT 0), x AS (SELECT grain FROM (SELECT grain FROM n EXCEPT SELECT grain FROM bitmap) UNION ALL SELECT grain FROM (SELECT grain FROM bitmap EXCEPT SELECT grain FROM n))
     SELECT grain // 4096 AS page, count(*) AS changed FROM x GROUP BY 1""",
)
def a16_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rebuild has to write, and bits that change there."""
    new, old = a15_rebuilt_bitmap(spark, sf_dir).withColumn("new", F.lit(1)), inv.bitmap(spark, sf_dir).withColumn("old", F.lit(1))
    changed = new.join(old, "grain", "full_outer").where("new is null or old is null")
    return changed.groupBy(F.expr("grain div 4096").alias("page")).agg(F.count("*").alias("changed"))


@query("t2_rebuild_coverage", "SELECT DISTINCT c.oid FROM copies c WHERE c.state = 'live' AND c.oid NOT IN (SELECT oid FROM extents WHERE k % 5 <> 0)")
def t2_rebuild_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live objects that a pass over the extents of four keys in five has not folded in."""
    live = inv.copies(spark, sf_dir).where("state = 'live'").select("oid").distinct()
    return live.join(inv.extents(spark, sf_dir).where("k % 5 <> 0"), "oid", "left_anti")


@query("j5_extent_sizes", "SELECT c.oid, count(e.grain) AS grains FROM (SELECT DISTINCT oid FROM copies WHERE state = 'live') c JOIN extents e USING (oid) GROUP BY c.oid")
def j5_extent_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = inv.copies(spark, sf_dir).where("state = 'live'").select("oid").distinct()
    return inv.extents(spark, sf_dir).join(live, "oid", "left_semi").groupBy("oid").agg(F.count("grain").alias("grains"))


_REGIONS = [("super", 0, 2), ("index", 2, 128), ("bitmap", 130, 8), ("log", 136, 64), ("data", 200, 4096)]


@query("w7_region_overlap", f"WITH r AS (SELECT * FROM (VALUES {', '.join(map(str, _REGIONS))}) t(region, off, n)), l AS (SELECT *, lag(off + n) OVER (ORDER BY off) AS before FROM r) SELECT region, off, before FROM l WHERE before > off")
def w7_region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a store that begin before the one in front ends; the log is planted so."""
    rows = spark.createDataFrame(_REGIONS, "region string, off long, n long")
    return rows.withColumn("before", F.lag(F.col("off") + F.col("n")).over(Window.orderBy("off"))).where("before > off").select("region", "off", "before")


@query("a20_geometry", "SELECT p AS part, greatest(1, least(1048576, 4 * ((p + 16777215) // 16777216))) AS nslots, p // 16384 AS grains FROM (VALUES (1048576), (1073741824), (1099511627776), (70368744177664)) t(p)")
def a20_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and grains of partitions of four sizes, at the default object and block size."""
    rows = spark.sql("select explode(array(1048576L, 1073741824L, 1099511627776L, 70368744177664L)) as part")
    return rows.selectExpr("part", "greatest(1L, least(1048576L, 4 * ((part + 16777215) div 16777216))) as nslots", "part div 16384 as grains")


def store_check(copies: DataFrame, extents: DataFrame, bitmap: DataFrame, dirty: DataFrame) -> DataFrame:
    """(rule, n): what a check of whole stores counts, and the problems that it finds; rules that find nothing count 0.

    Records: live, tomb, corrupt, and bad ones. Grains: referred to, marked, phantom (referred to, not marked), leaked
    (marked, not referred to), doubled (referred to more than once), zero (grain 0 not marked). Across: live objects
    without an extent, extents of no live object, dirty records, and dirty records of no object.
    Each table is read and shuffled by its key once; what is summed up is one row for each.
    """
    bad = (F.col("ver") < 1) | (F.col("wepoch") < 0) | ((F.col("state") == "tomb") & (F.col("len") != 0)) | (F.length("csum") != 64)
    refs = extents.groupBy("grain").agg(F.count("*").alias("refs"))
    grains = refs.join(bitmap.select("grain", F.lit(True).alias("marked")), "grain", "full_outer")
    grains = grains.agg(
        F.count("refs").alias("referred"),
        F.count("marked").alias("marked"),
        F.count_if(F.col("marked").isNull()).alias("phantom"),
        F.count_if(F.col("refs").isNull() & (F.col("grain") != 0)).alias("leaked"),
        F.count_if(F.col("refs") > 1).alias("doubled"),
        (1 - F.count_if((F.col("grain") == 0) & F.col("marked"))).alias("zero"),
    )
    live = F.col("state") == "live"
    records = copies.groupBy("oid").agg(F.count_if(live).alias("live"), F.count_if(F.col("state") == "tomb").alias("tomb"), F.count_if("corrupt").alias("corrupt"), F.count_if(bad).alias("bad"))
    across = records.join(extents.groupBy("oid").agg(F.count("*").alias("extents")), "oid", "full_outer").join(dirty.groupBy("oid").agg(F.count("*").alias("dirty")), "oid", "full_outer")
    across = across.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("live", "tomb", "corrupt", "bad")],
        F.count_if((F.col("live") > 0) & F.col("extents").isNull()).alias("no_extent"),
        F.count_if(F.col("extents").isNotNull() & (F.coalesce("live", F.lit(0)) == 0)).alias("no_live"),
        F.coalesce(F.sum("dirty"), F.lit(0)).alias("dirty"),
        F.coalesce(F.sum(F.when(F.col("live").isNull(), F.col("dirty"))), F.lit(0)).alias("dirty_of_none"),
    )
    names = [*grains.columns, *across.columns]
    both = grains.join(F.broadcast(across))  # a row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("x.rule", "x.n")


@query(
    "t8_store_check",
    """WITH r AS (SELECT grain, count(*) AS refs FROM extents GROUP BY grain), g AS (SELECT grain, refs, b.grain IS NOT NULL AS marked FROM r FULL JOIN bitmap b USING (grain)),
      o AS (SELECT oid, count(*) FILTER (state = 'live') AS live FROM copies GROUP BY oid)
    SELECT 'referred' AS rule, count(refs) AS n FROM g UNION ALL SELECT 'marked', count(*) FILTER (marked) FROM g UNION ALL SELECT 'phantom', count(*) FILTER (NOT marked) FROM g
    UNION ALL SELECT 'leaked', count(*) FILTER (refs IS NULL AND grain <> 0) FROM g UNION ALL SELECT 'doubled', count(*) FILTER (refs > 1) FROM g UNION ALL SELECT 'zero', 1 - count(*) FILTER (grain = 0) FROM bitmap
    UNION ALL SELECT state, count(*) FROM copies WHERE state IN ('live', 'tomb') GROUP BY state UNION ALL SELECT 'corrupt', count(*) FILTER (corrupt) FROM copies
    UNION ALL SELECT 'bad', count(*) FILTER (ver < 1 OR wepoch < 0 OR (state = 'tomb' AND len <> 0) OR length(csum) <> 64) FROM copies
    UNION ALL SELECT 'no_extent', count(*) FROM o WHERE live > 0 AND oid NOT IN (SELECT oid FROM extents)
    UNION ALL SELECT 'no_live', count(*) FROM (SELECT DISTINCT oid FROM extents WHERE oid NOT IN (SELECT oid FROM o WHERE live > 0))
    UNION ALL SELECT 'dirty', count(*) FROM dirty UNION ALL SELECT 'dirty_of_none', count(*) FROM dirty WHERE oid NOT IN (SELECT oid FROM o)""",
)
def t8_store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_check(inv.copies(spark, sf_dir), inv.extents(spark, sf_dir), inv.bitmap(spark, sf_dir), inv.dirty(spark, sf_dir))
