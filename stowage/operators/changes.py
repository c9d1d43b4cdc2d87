"""Change logs folded into state, rings and copies of headers, stages, commits and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.plans.registry import query
from stowage.sources import inventory as inv


def replay(log: DataFrame) -> DataFrame:
    """(oid, seq, op, off): the last change of each object; objects whose last change is a delete are gone.

    A maximum over whole rows by sequence number, so it combines before the shuffle and needs no sort.
    """
    last = log.where("op <> 'verify'").groupBy("oid").agg(F.max(F.struct("seq", "op", "off")).alias("x"))
    return last.where("x.op <> 'delete'").select("oid", "x.seq", "x.op", "x.off")


_VALID = "v AS (SELECT *, seq % 9973 <> 4999 AS valid FROM oplog)"
_PREFIX = f"{_VALID}, cut AS (SELECT coalesce(min(seq), 9223372036854775807) AS cutoff FROM v WHERE NOT valid), p AS (SELECT v.* FROM v, cut WHERE seq < cutoff)"


def valid_prefix(log: DataFrame) -> DataFrame:
    """The rows of a log before its first record that isn't valid: one number is broadcast, nothing is sorted."""
    cut = log.where("not valid").agg(F.coalesce(F.min("seq"), F.lit((1 << 63) - 1)).alias("at"))
    return log.join(F.broadcast(cut), F.col("seq") < F.col("at")).drop("at")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.oplog(spark, sf_dir).withColumn("valid", F.col("seq") % 9973 != 4999)


@query("w6_contiguous_prefix", f"WITH {_PREFIX} SELECT count(*) AS n, max(seq) AS last FROM p")
def w6_contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_prefix(_flagged(spark, sf_dir)).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("w6_gaps", "WITH s AS (SELECT seq, lag(seq) OVER (PARTITION BY oid ORDER BY seq) AS before, oid FROM oplog) SELECT oid, count(*) AS n, max(seq - before) AS widest FROM s WHERE seq - before > 1 GROUP BY oid")
def w6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the sequence numbers of each object's changes."""
    steps = inv.oplog(spark, sf_dir).withColumn("before", F.lag("seq").over(Window.partitionBy("oid").orderBy("seq")))
    return steps.where("seq - before > 1").groupBy("oid").agg(F.count("*").alias("n"), F.max(F.col("seq") - F.col("before")).alias("widest"))


@query("x1_replay", f"WITH {_PREFIX}, r AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY seq DESC) AS rn FROM p WHERE op <> 'verify') SELECT oid, seq, op, off FROM r WHERE rn = 1 AND op <> 'delete'")
def x1_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(valid_prefix(_flagged(spark, sf_dir)))


_LIFE = "d AS (SELECT oid, max(seq) FILTER (op = 'delete') AS gone FROM oplog GROUP BY oid), a AS (SELECT o.* FROM oplog o JOIN d USING (oid) WHERE gone IS NULL OR seq > gone)"


@query("x2_block_map", f"WITH {_LIFE}, w AS (SELECT oid, off // 1024 AS blk, max(seq) AS seq FROM a WHERE op = 'write' GROUP BY 1, 2), t AS (SELECT oid, max(seq) AS cut FROM a WHERE op = 'trunc' GROUP BY oid) SELECT w.oid, w.blk, w.seq FROM w LEFT JOIN t USING (oid) WHERE cut IS NULL OR w.seq > cut")
def x2_block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change that each block of each object comes from: the last write after the last delete and truncation to nothing."""
    rows = inv.oplog(spark, sf_dir)
    cut = rows.where("op in ('delete', 'trunc')").groupBy("oid").agg(F.max("seq").alias("cut"))
    last = rows.where("op = 'write'").groupBy("oid", F.expr("off div 1024").alias("blk")).agg(F.max("seq").alias("seq"))
    return last.join(cut, "oid", "left").where("cut is null or seq > cut").select("oid", "blk", "seq")


@query("x3_slot_markers", "SELECT oid, max(seq) AS seq FROM oplog WHERE op = 'delete' GROUP BY oid")
def x3_slot_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.oplog(spark, sf_dir).where("op = 'delete'").groupBy("oid").agg(F.max("seq").alias("seq"))


@query(
    "x4_fold",
    """WITH d AS (SELECT oid, max(seq) FILTER (op = 'delete') AS gone FROM oplog GROUP BY oid), a AS (SELECT o.oid, o.seq, o.op, o.off + o.n AS reach FROM oplog o JOIN d USING (oid) WHERE (gone IS NULL OR seq > gone) AND op IN ('create', 'write', 'trunc'))
     , t AS (SELECT oid, max(seq) AS cut FROM a WHERE op = 'trunc' GROUP BY oid)
     SELECT a.oid, count(*) AS ver, coalesce(max(CASE WHEN op = 'write' AND (cut IS NULL OR seq > cut) THEN reach END), 0) AS len FROM a LEFT JOIN t USING (oid) GROUP BY a.oid""",
)
def x4_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and length of each object after its changes: a truncation is to nothing, a write reaches to its end."""
    rows = inv.oplog(spark, sf_dir).where("op in ('create', 'write', 'trunc', 'delete')")
    ends = rows.groupBy("oid").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"), F.max(F.when(F.col("op") == "trunc", F.col("seq"))).alias("cut"))
    rows = rows.where("op <> 'delete'").join(ends, "oid").where("gone is null or seq > gone")
    reach = F.max(F.when((F.col("op") == "write") & (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))), F.col("off") + F.col("n")))
    return rows.groupBy("oid").agg(F.count("*").alias("ver"), F.coalesce(reach, F.lit(0)).alias("len"))


_ALIVE = "d AS (SELECT oid, max(seq) FILTER (op = 'delete') AS gone FROM oplog GROUP BY oid), a AS (SELECT o.oid, o.seq, o.op, o.off, o.n FROM oplog o JOIN d USING (oid) WHERE (gone IS NULL OR seq > gone) AND op IN ('create', 'write', 'trunc'))"


def alive(log: DataFrame) -> DataFrame:
    """The creations, writes and truncations of each object after its last delete."""
    gone = log.where("op = 'delete'").groupBy("oid").agg(F.max("seq").alias("gone"))
    return log.where("op in ('create', 'write', 'trunc')").join(gone, "oid", "left").where("gone is null or seq > gone").drop("gone")


@query(
    "x4_partial_fold",
    f"""WITH {_ALIVE}, t AS (SELECT oid, max(seq) AS cut, max_by(off, seq) AS size FROM a WHERE op = 'trunc' GROUP BY oid)
     SELECT a.oid, count(*) AS ver, greatest(coalesce(max(size), 0), coalesce(max(CASE WHEN op = 'write' AND (cut IS NULL OR seq > cut) THEN off + n END), 0)) AS len FROM a LEFT JOIN t USING (oid) GROUP BY a.oid""",
)
def x4_partial_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and length of each object where a truncation is to its offset: the last one, and the writes after it, decide."""
    rows = alive(inv.oplog(spark, sf_dir))
    last = rows.where("op = 'trunc'").groupBy("oid").agg(F.max("seq").alias("cut"), F.max_by("off", "seq").alias("size"))
    reach = F.max(F.when((F.col("op") == "write") & (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))), F.col("off") + F.col("n")))
    return rows.join(last, "oid", "left").groupBy("oid").agg(F.count("*").alias("ver"), F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(reach, F.lit(0))).alias("len"))


@query(
    "x2_partial_map",
    f"""WITH {_ALIVE}, w AS (SELECT oid, off // 1024 AS blk, max(seq) AS seq FROM a WHERE op = 'write' GROUP BY 1, 2)
     SELECT oid, blk, seq FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.op = 'trunc' AND a.oid = w.oid AND a.seq > w.seq AND a.off <= w.blk * 1024)""",
)
def x2_partial_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change that each block comes from where a truncation frees the blocks from its offset on.

    Writes and truncations are summed up by offset first, so that what is ordered of an object is a row for each
    offset, not its changes: a block stays if no truncation at or before it is later.
    """
    rows = alive(inv.oplog(spark, sf_dir)).where("op <> 'create'")
    write = F.col("op") == "write"
    by = rows.groupBy("oid", "off").agg(F.max(F.when(write, F.col("seq"))).alias("seq"), F.max(F.when(~write, F.col("seq"))).alias("cut"))
    cut = F.max("cut").over(Window.partitionBy("oid").orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    kept = by.select("oid", F.expr("off div 1024").alias("blk"), "seq", cut.alias("cut")).where("seq is not null and (cut is null or seq > cut)")
    return kept.select("oid", "blk", "seq")


@query("a18_dirty_fold", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY oid, op ORDER BY seq DESC) AS rn FROM (SELECT oid, seq, CASE WHEN op IN ('write', 'trunc') THEN 'n1.0' ELSE 'n2.0' END AS op, op <> 'delete' AS adds FROM oplog)) SELECT oid, op AS peer, seq AS epoch FROM r WHERE rn = 1 AND adds")
def a18_dirty_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty records after a log of additions and removals: the last of each (object, peer), unless it removes."""
    peer = F.when(F.col("op").isin("write", "trunc"), "n1.0").otherwise("n2.0")
    rows = inv.oplog(spark, sf_dir).select("oid", peer.alias("peer"), "seq", (F.col("op") != "delete").alias("adds"))
    last = rows.groupBy("oid", "peer").agg(F.max(F.struct("seq", "adds")).alias("x"))
    return last.where("x.adds").select("oid", "peer", F.col("x.seq").alias("epoch"))


@query("x6_stages", "SELECT oid, off, count(*) AS chunks, min(seq) AS first, max(seq) AS last FROM oplog WHERE op = 'write' GROUP BY oid, off HAVING count(*) FILTER (n = 1024) = count(*)")
def x6_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that arrived for each stage, which a stage is complete with if none is short."""
    rows = inv.oplog(spark, sf_dir).where("op = 'write'").groupBy("oid", "off")
    return rows.agg(F.count("*").alias("chunks"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.bool_and(F.col("n") == 1024).alias("whole")).where("whole").drop("whole")


@query("p29_stage_expiry", "SELECT oid, max(ts) AS last, epoch(TIMESTAMP '2024-06-01' - max(ts)) > 86400 AS expired FROM oplog GROUP BY oid")
def p29_stage_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages silent for more than a day at a given time, strictly."""
    last = inv.oplog(spark, sf_dir).groupBy("oid").agg(F.max("ts").alias("last"))
    silent = F.unix_micros(F.lit("2024-06-01").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.select("oid", "last", (silent > 86400 * 1000000).alias("expired"))


@query("x9_commit_cut", "WITH f AS (SELECT min(seq) AS cutoff FROM oplog WHERE op = 'delete' AND seq % 7 = 3) SELECT op, count(*) FILTER (seq < cutoff) AS released, count(*) FILTER (seq >= cutoff) AS condemned FROM oplog, f GROUP BY op")
def x9_commit_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes released below, and condemned from, the first that fails."""
    rows = inv.oplog(spark, sf_dir)
    cut = rows.where("op = 'delete' and seq % 7 = 3").agg(F.min("seq").alias("at"))
    return rows.join(F.broadcast(cut)).groupBy("op").agg(F.count_if(F.col("seq") < F.col("at")).alias("released"), F.count_if(F.col("seq") >= F.col("at")).alias("condemned"))


@query("x10_backoff", "SELECT n, least(5000, 100 * CAST(pow(2, n) AS BIGINT)) AS wait_ms FROM (SELECT unnest(range(0, 12)) AS n)")
def x10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(12).selectExpr("id as n", "least(5000L, 100L * cast(pow(2, id) as bigint)) as wait_ms")


@query("s32_counters", "SELECT iid, max(ver) AS high, (max(ver) // 1024 + 1) * 1024 AS reserved, max(wepoch) AS epoch FROM copies GROUP BY iid")
def s32_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water marks, reserved in batches of 1024."""
    return inv.copies(spark, sf_dir).groupBy("iid").agg(F.max("ver").alias("high"), F.expr("(max(ver) div 1024 + 1) * 1024").alias("reserved"), F.max("wepoch").alias("epoch"))


_RING = [(1, 40, True, False, 3), (2, 41, True, False, 2), (3, 42, False, False, 1), (4, 43, True, True, 0), (5, 42, True, False, 4)]
_RING_SQL = f"r AS (SELECT * FROM (VALUES {', '.join(map(str, _RING)).replace('True', 'true').replace('False', 'false')}) t(seq, epoch, valid, phantom, slot))"


def _ring(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RING, "seq long, epoch long, valid boolean, phantom boolean, slot long")


@query("w4_ring_rank", f"WITH {_RING_SQL} SELECT seq, epoch, row_number() OVER (ORDER BY seq DESC) - 1 AS rank FROM r WHERE valid AND NOT phantom")
def w4_ring_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of the ring, newest first."""
    rank = F.row_number().over(Window.orderBy(F.desc("seq"))).cast("long") - 1  # a ring has a few dozen
    return _ring(spark).where("valid and not phantom").select("seq", "epoch", rank.alias("rank"))


@query("w5_ring_victim", f"WITH {_RING_SQL} SELECT slot FROM r ORDER BY phantom DESC, valid, seq, slot LIMIT 1")
def w5_ring_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ring(spark).orderBy(F.desc("phantom"), "valid", "seq", "slot").limit(1).select("slot")


@query("s25_lookup", f"WITH {_RING_SQL} SELECT epoch, max(seq) AS seq FROM r WHERE valid AND NOT phantom GROUP BY epoch")
def s25_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map that each epoch stands for: the latest of several."""
    return _ring(spark).where("valid and not phantom").groupBy("epoch").agg(F.max("seq").alias("seq"))


@query("s28_retained", f"WITH {_RING_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS rn FROM r WHERE valid) SELECT seq, epoch FROM k WHERE rn <= 2")
def s28_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ring(spark).where("valid").orderBy(F.desc("seq")).limit(2).select("seq", "epoch")


_SUPERS = [(1, 0, True, 7), (1, 1, True, 9), (2, 0, True, 5), (2, 1, False, 6), (3, 0, False, 1), (3, 1, False, 2), (4, 0, True, 4), (4, 1, True, 4)]
_SUPERS_SQL = f"s AS (SELECT * FROM (VALUES {', '.join(map(str, _SUPERS)).replace('True', 'true').replace('False', 'false')}) t(store, copy, valid, gen))"


@query("s26_super_choice", f"WITH {_SUPERS_SQL} SELECT store, coalesce(max(gen) FILTER (valid), 0) AS gen, count(*) FILTER (valid) AS valid, CASE count(*) FILTER (valid) WHEN 0 THEN 'none' WHEN 1 THEN 'other' ELSE 'older' END AS victim FROM s GROUP BY store")
def s26_super_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two copies the valid one with the greater generation; the next write goes over the other. Generation 0: none."""
    rows = spark.createDataFrame(_SUPERS, "store long, copy long, valid boolean, gen long").groupBy("store")
    n = F.count_if("valid")
    return rows.agg(F.coalesce(F.max(F.when(F.col("valid"), F.col("gen"))), F.lit(0)).alias("gen"), n.alias("valid"), F.when(n == 0, "none").when(n == 1, "other").otherwise("older").alias("victim"))


@query("s27_header_choice", f"WITH {_SUPERS_SQL} SELECT store, count(DISTINCT gen) FILTER (valid) <= 1 AND count(*) FILTER (valid) > 0 AS ok FROM s GROUP BY store")
def s27_header_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either valid copy does, but two that differ are refused."""
    rows = spark.createDataFrame(_SUPERS, "store long, copy long, valid boolean, gen long").groupBy("store")
    return rows.agg(((F.count_distinct(F.when(F.col("valid"), F.col("gen"))) <= 1) & (F.count_if("valid") > 0)).alias("ok"))
