"""Inventory tables derived from the order and event tables, by integer arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The members for which known placements are given.
IIDS = ["n1.0", "n1.1", "n2.0", "n3.0", "n3.2"]
INST_SCHEMA = "iid string, node string, idx long, status string, up string, fenced boolean, since long"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iid_of(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, IIDS)), (F.col(key) % 5 + 1).cast("int"))


def copies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned copies; content follows from (oid, wepoch, ver) but for suppliers mod 50 = 7, which diverge."""
    k = F.col("l_orderkey") + F.col("l_linenumber") % 3 + F.col("l_partkey") % 4
    rows = base(spark, sf_dir, "lineitem").select(
        iid_of("l_suppkey").alias("iid"),
        F.concat(F.lit("ord."), F.col("l_orderkey")).alias("oid"),
        F.when(k % 4 == 0, "tomb").otherwise("live").alias("state"),
        k.alias("k"),
        (1 + F.col("l_partkey") % 4).alias("ver"),
        (1 + F.col("l_linenumber") % 3).cast("long").alias("wepoch"),
        F.when(F.col("l_suppkey") % 50 == 7, "x").otherwise("").alias("inj"),
        (F.col("l_suppkey") % 17 == 0).alias("corrupt"),
    )
    tomb = F.col("state") == "tomb"
    return rows.select(
        "iid",
        "oid",
        "state",
        F.when(tomb, F.lit(0).cast("long")).otherwise(1024 * (1 + F.col("k") % 16)).alias("len"),
        "ver",
        "wepoch",
        F.sha2(F.when(tomb, "").otherwise(F.concat_ws(":", "oid", "wepoch", "ver", "inj")), 256).alias("csum"),
        "corrupt",
        (1717000000 + 86400 * (F.col("k") % 11)).alias("mtime"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each instance and object: a whole-row maximum, which combines before the shuffle."""
    order = ["wepoch", "ver", "csum", "state", "len", "corrupt", "mtime"]
    best = copies_raw(spark, sf_dir).groupBy("iid", "oid").agg(F.max(F.struct(*order)).alias("x"))
    return best.select("iid", "oid", "x.state", "x.len", "x.ver", "x.wepoch", "x.csum", "x.corrupt", "x.mtime")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return rows.select(F.concat(F.lit("ord."), F.col("o_orderkey")).alias("oid"), iid_of("o_custkey").alias("peer"), (1 + F.col("o_custkey") % 7).alias("epoch"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for pair in (("signup", "create"), ("click", "write"), ("purchase", "trunc"), ("error", "delete")) for x in pair])
    rows = base(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.concat(F.lit("usr."), F.col("user_id")).alias("oid"), F.coalesce(F.element_at(op, F.col("event_type")), F.lit("verify")).alias("op"), ((F.col("event_id") % 8) * 1024).alias("off"), F.lit(1024).cast("long").alias("n"), "ts")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir, "events")
    return rows.select(iid_of("user_id").alias("iid"), "ts", F.when(F.col("event_type").isin("view", "click"), "instance").otherwise("reader").alias("role"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("bytes_read"))


def inst(spark: SparkSession) -> DataFrame:
    """The members of the current map."""
    states = [("in", "yes"), ("in", "no"), ("in", "yes"), ("in", "heal"), ("out", "yes")]
    return spark.createDataFrame([(i, i[:2], int(i[3:]), s, u, False, 7) for i, (s, u) in zip(IIDS, states, strict=True)], INST_SCHEMA)


def inst_prev(spark: SparkSession) -> DataFrame:
    """The members of the map one epoch before: all in and up."""
    return spark.createDataFrame([(i, i[:2], int(i[3:]), "in", "yes", False, 6) for i in IIDS], INST_SCHEMA)


def stale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("n2.0", "n1.1", 5), ("n3.0", "n2.0", 6)], "subject string, reporter string, since long")


def doc_oids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "documents").select(F.concat(F.lit("doc."), F.col("doc_id")).alias("oid")).distinct()


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "documents").select(F.concat(F.lit("doc."), F.col("doc_id")).alias("oid"), F.encode("text", "utf-8").alias("content"))


def _blocks_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = base(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return keys.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 4)).alias("blk"))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grains that objects refer to; keys mod 1499 = 5 refer to a grain of the key before."""
    own = F.col("k") * 8 + F.col("blk") + 1
    grain = F.when((F.col("k") % 1499 == 5) & (F.col("blk") == 0), (F.col("k") - 1) * 8 + 1).otherwise(own)
    return _blocks_of_orders(spark, sf_dir).select("k", F.concat(F.lit("ord."), F.col("k")).alias("oid"), "blk", grain.alias("grain"))


def bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked grains: those of all objects but for keys mod 997 = 3, some that nothing refers to, and grain 0."""
    marked = _blocks_of_orders(spark, sf_dir).where("not (k % 997 = 3 and blk = 0)").select((F.col("k") * 8 + F.col("blk") + 1).alias("grain"))
    leaked = base(spark, sf_dir, "lineitem").where("l_orderkey % 1009 = 1").select((F.col("l_orderkey") * 8 + 7).alias("grain"))
    return marked.union(leaked).union(spark.range(1).select(F.col("id").alias("grain"))).distinct()
