"""Arbitration of copies, listings, pages, status files and audits of an inventory."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.plans.registry import query
from stowage.sources import inventory as inv

KEY = ["wepoch", "ver"]
#: Literals of the retention queries: seconds, days and epoch.
NOW, TOMBDAYS, EPOCH = 1718000000, 7, 3


def arbitrate(copies: DataFrame) -> DataFrame:
    """(oid, state, len, ver, wepoch, csum, copies_ok, diverged): the winning key of each object among copies that are not corrupt.

    One aggregation, combined before the shuffle: the winner is a whole-row maximum led by the key. An object with
    corrupt copies only has no row. diverged tells that copies with the winning key differ.
    """
    ok = copies.where("not corrupt")
    best = F.max(F.struct("wepoch", "ver", "csum", "state", "len")).alias("x")
    # the least digest that the winning key has: a maximum over the key and the inverted digest
    low = F.max(F.struct("wepoch", "ver", F.translate("csum", "0123456789abcdef", "fedcba9876543210"))).alias("y")
    w = ok.groupBy("oid").agg(best, low, F.count("*").alias("copies_ok"))
    differ = F.col("x.csum") != F.translate(F.col("y.col3"), "0123456789abcdef", "fedcba9876543210")
    return w.select("oid", "x.state", "x.len", "x.ver", "x.wepoch", "x.csum", "copies_ok", differ.alias("diverged"))


@query(
    "a8_arbitrate",
    """WITH ok AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY wepoch DESC, ver DESC, csum DESC, state DESC, len DESC) AS rn, count(*) OVER (PARTITION BY oid) AS copies_ok,
         max(wepoch * 1000 + ver) OVER (PARTITION BY oid) AS top FROM copies WHERE NOT corrupt),
       d AS (SELECT oid, count(DISTINCT csum) AS n FROM ok WHERE wepoch * 1000 + ver = top GROUP BY oid)
     SELECT ok.oid, state, len, ver, wepoch, csum, copies_ok, n > 1 AS diverged FROM ok JOIN d USING (oid) WHERE rn = 1""",
)
def a8_arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate(inv.copies(spark, sf_dir))


@query(
    "p24_divergence",
    """WITH t AS (SELECT *, max(wepoch * 1000 + ver) OVER (PARTITION BY oid) AS top FROM copies WHERE NOT corrupt)
     SELECT oid, wepoch, ver, count(DISTINCT csum) AS n_csum, count(*) AS n FROM t WHERE wepoch * 1000 + ver = top GROUP BY oid, wepoch, ver HAVING count(DISTINCT csum) > 1""",
)
def p24_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose winning key stands for more than one content."""
    by_key = inv.copies(spark, sf_dir).where("not corrupt").groupBy("oid", *KEY, "csum").agg(F.count("*").alias("n"))
    by_key = by_key.groupBy("oid", *KEY).agg(F.count("*").alias("n_csum"), F.sum("n").alias("n"))
    top = by_key.groupBy("oid").agg(F.max(F.struct(*KEY, "n_csum", "n")).alias("x"))
    return top.where("x.n_csum > 1").select("oid", "x.wepoch", "x.ver", "x.n_csum", "x.n")


@query("s1_index_scan", "SELECT iid, count(*) AS slots, sum(CASE WHEN corrupt THEN 1 ELSE 0 END)::BIGINT AS bad FROM copies GROUP BY iid")
def s1_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that keeps bad records and counts them."""
    return inv.copies(spark, sf_dir).groupBy("iid").agg(F.count("*").alias("slots"), F.count_if("corrupt").alias("bad"))


@query("s5_point_lookup", "SELECT iid, oid, state, len, ver, wepoch FROM copies WHERE oid = 'ord.5'")
def s5_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.copies(spark, sf_dir).where("oid = 'ord.5'").select("iid", "oid", "state", "len", "ver", "wepoch")


@query("s7_snapshot", "SELECT c.iid, c.oid FROM copies c JOIN copies d USING (iid, oid, wepoch, ver) WHERE c.state IN ('live', 'tomb') AND d.state = 'live' AND NOT d.corrupt AND d.ver <> 4")
def s7_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot of live and tomb records still finds in the live index: records are gone once state or key has moved on."""
    snap = inv.copies(spark, sf_dir).where(F.col("state").isin("live", "tomb"))
    live = inv.copies(spark, sf_dir).where("state = 'live' and not corrupt and ver <> 4")
    return snap.join(live, ["iid", "oid", *KEY], "left_semi").select("iid", "oid")


@query("s12_directory", "SELECT iid, oid AS name, len, mtime, ver % 4294967296 AS qid_vers FROM copies WHERE state = 'live' AND NOT corrupt")
def s12_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.copies(spark, sf_dir).where("state = 'live' and not corrupt")
    return rows.select("iid", F.col("oid").alias("name"), "len", "mtime", F.col("ver").bitwiseAND(F.lit(0xFFFFFFFF)).alias("qid_vers"))


_ADVERT = "concat_ws(' ', oid, ver, wepoch, csum, len, state)"


@query("s13_tombs", f"SELECT iid, {_ADVERT} AS line FROM copies WHERE state = 'tomb' AND NOT corrupt")
def s13_tombs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.copies(spark, sf_dir).where("state = 'tomb' and not corrupt").selectExpr("iid", f"{_ADVERT} as line")


@query("s13_advert", f"SELECT iid, {_ADVERT} AS line FROM copies WHERE NOT corrupt")
def s13_advert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.copies(spark, sf_dir).where("not corrupt").selectExpr("iid", f"{_ADVERT} as line")


#: What a status file says of an instance's configuration, in the order of its lines: parameters of status().
CONFIG = {"monidmismatch": "no", "epochregress": "no", "msize": "65536", "objsnap": "full", "scrubnext": "0", "queues": "8", "writethrough": "no", "flush": "sync", "broken": "no"}
STATUS = ["iid", "uuid", "monid", "monidmismatch", "status", "up", "fence", "epoch", "epochregress", "msize", "objsnap", "objsnapopen", "dirty", "lost", "diverged", "scrubnext", "staged", "queues", "qdepth", "qpushed", "qdone", "writethrough", "flush", "broken"]


def status(iid: str, monid: str, members: DataFrame, copies: DataFrame, dirty: DataFrame, log: DataFrame, done: int, config: dict[str, str] = CONFIG) -> DataFrame:
    """(name, value): the 24 lines of an instance's status file.

    Counts are single-row sums of its own records: corrupt ones are lost, those whose content differs from another
    copy of the same key are diverged, changes after sequence number `done` wait in the queues.
    """
    own = copies.where(F.col("iid") == iid)
    differ = copies.where("not corrupt").groupBy("oid", *KEY).agg(F.count_if(F.col("iid") == iid).alias("mine"), (F.min("csum") != F.max("csum")).alias("differ"))
    sums = own.agg(F.max("wepoch").alias("epoch"), F.count_if("corrupt").alias("lost"), F.count_if(F.col("state") == "live").alias("objsnapopen"))
    sums = sums.join(differ.agg(F.count_if((F.col("mine") > 0) & F.col("differ")).alias("diverged"))).join(dirty.agg(F.count("*").alias("dirty")))
    sums = sums.join(log.agg(F.count("*").alias("qpushed"), F.count_if(F.col("seq") <= done).alias("qdone"), F.count_if((F.col("op") == "write") & (F.col("seq") > done)).alias("staged")))
    me = members.where(F.col("iid") == iid).select("status", "up", F.when(F.col("fenced"), "operator").otherwise("none").alias("fence"))
    row = sums.join(F.broadcast(me)).withColumn("qdepth", F.col("qpushed") - F.col("qdone"))
    row = row.withColumns({k: F.lit(v) for k, v in config.items()} | {"iid": F.lit(iid), "uuid": F.md5(F.lit(iid)), "monid": F.lit(monid)})
    lines = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in STATUS])
    return row.select(F.explode(lines).alias("x")).select("x.name", "x.value")


_STATUS_SQL = {"iid": "'n1.0'", "uuid": "md5('n1.0')", "monid": "md5('monitor')", "epoch": "max(wepoch)", "lost": "count(*) FILTER (corrupt)", "objsnapopen": "count(*) FILTER (state = 'live')"} | {k: f"'{v}'" for k, v in CONFIG.items()}
_STATUS_SQL |= {k: f"(SELECT {k} FROM inst WHERE iid = 'n1.0')" for k in ("status", "up")} | {"fence": "(SELECT CASE WHEN fenced THEN 'operator' ELSE 'none' END FROM inst WHERE iid = 'n1.0')", "dirty": "(SELECT count(*) FROM dirty)"}
_STATUS_SQL |= {"qpushed": "(SELECT count(*) FROM oplog)", "qdone": "(SELECT count(*) FROM oplog WHERE seq <= 500)", "qdepth": "(SELECT count(*) FROM oplog WHERE seq > 500)", "staged": "(SELECT count(*) FROM oplog WHERE seq > 500 AND op = 'write')"}
_STATUS_SQL["diverged"] = "(SELECT count(*) FROM (SELECT 1 FROM copies WHERE NOT corrupt GROUP BY oid, wepoch, ver HAVING bool_or(iid = 'n1.0') AND min(csum) <> max(csum)))"


@query("s14_status", f"WITH t AS (SELECT {', '.join(f'CAST({_STATUS_SQL[n]} AS VARCHAR) AS {chr(34)}{n}{chr(34)}' for n in STATUS)} FROM copies WHERE iid = 'n1.0') {' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS name, {chr(34)}{n}{chr(34)} AS value FROM t' for n in STATUS)}")
def s14_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status file of n1.0, with the changes up to the 500th done."""
    return status("n1.0", hashlib.md5(b"monitor").hexdigest(), inv.inst(spark), inv.copies(spark, sf_dir), inv.dirty(spark, sf_dir), inv.oplog(spark, sf_dir), 500)


@query("s16_dirty_file", "SELECT 'oid=' || oid || ' peer=' || peer || ' epoch=' || epoch AS line FROM dirty UNION ALL SELECT 'fullsync peer=' || iid FROM inst WHERE up = 'no'")
def s16_dirty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = inv.dirty(spark, sf_dir).select(F.format_string("oid=%s peer=%s epoch=%d", "oid", "peer", "epoch").alias("line"))
    return fine.union(inv.inst(spark).where("up = 'no'").select(F.concat(F.lit("fullsync peer="), F.col("iid"))))


@query("s17_stale_of_self", "SELECT subject, reporter, since FROM stale WHERE subject = 'n2.0' OR reporter = 'n2.0'")
def s17_stale_of_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stale(spark).where("subject = 'n2.0' or reporter = 'n2.0'")


@query("s18_lost", "SELECT iid, CASE WHEN ver = 4 THEN NULL ELSE oid END AS oid, CASE WHEN ver = 4 THEN 'lost' ELSE 'corrupt' END AS kind FROM copies WHERE corrupt")
def s18_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupt records by their id; those whose id is gone (here: of version 4) as lost."""
    rows = inv.copies(spark, sf_dir).where("corrupt").select("iid", F.when(F.col("ver") != 4, F.col("oid")).alias("oid"))
    return rows.withColumn("kind", F.when(F.col("oid").isNull(), "lost").otherwise("corrupt"))


@query("s9_behind", "SELECT d.peer, coalesce(i.up = 'no', true) AS behind FROM (SELECT DISTINCT peer FROM dirty UNION ALL SELECT 'n9.0') d LEFT JOIN inst i ON i.iid = d.peer")
def s9_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a peer needs a full pass; one that isn't known does."""
    peers = inv.dirty(spark, sf_dir).select("peer").distinct().union(spark.sql("select 'n9.0' as peer"))
    return peers.join(F.broadcast(inv.inst(spark).select(F.col("iid").alias("peer"), (F.col("up") == "no").alias("b"))), "peer", "left").select("peer", F.coalesce("b", F.lit(True)).alias("behind"))


def page(objects: DataFrame, after: str, k: int) -> DataFrame:
    """(oid, more): the k least ids after one, and whether there are others. A top-k, never a full sort."""
    first = objects.where(F.col("oid") > after).orderBy("oid").limit(k + 1)
    w = Window.orderBy("oid")  # over k + 1 rows
    return first.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy())).where(F.col("rn") <= k).select("oid", (F.col("n") > k).alias("more"))


@query("k1_list_page", "WITH t AS (SELECT DISTINCT oid FROM copies WHERE oid > 'ord.2'), f AS (SELECT oid FROM t ORDER BY oid LIMIT 64) SELECT oid, (SELECT count(*) FROM t) > 64 AS more FROM f")
def k1_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(inv.copies(spark, sf_dir).select("oid").distinct(), "ord.2", 64)


@query("k2_list_budget", "WITH t AS (SELECT DISTINCT oid FROM copies WHERE oid > 'ord.'), f AS (SELECT oid FROM t ORDER BY oid LIMIT 256), s AS (SELECT oid, sum(length(oid) + 1) OVER (ORDER BY oid) AS b FROM f) SELECT oid FROM s WHERE b <= 1000")
def k2_list_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 256 ids, as many as fit a reply of 1000 bytes."""
    first = inv.copies(spark, sf_dir).select("oid").distinct().where("oid > 'ord.'").orderBy("oid").limit(256)
    return first.withColumn("b", F.sum(F.length("oid") + 1).over(Window.orderBy("oid"))).where("b <= 1000").select("oid")


@query("k3_directory_slice", "WITH t AS (SELECT oid, row_number() OVER (ORDER BY oid) AS position FROM (SELECT DISTINCT oid FROM copies)) SELECT oid, position FROM t WHERE position BETWEEN 101 AND 150")
def k3_directory_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries 101 to 150 of a listing."""
    first = inv.copies(spark, sf_dir).select("oid").distinct().orderBy("oid").limit(150)
    return first.withColumn("position", F.row_number().over(Window.orderBy("oid")).cast("long")).where("position > 100")


@query("a9_totals", "SELECT iid, state, corrupt, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM copies GROUP BY iid, state, corrupt")
def a9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.copies(spark, sf_dir).groupBy("iid", "state", "corrupt").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


_WORST = "(SELECT peer FROM dirty GROUP BY peer ORDER BY count(*) DESC, peer LIMIT 1)"


@query("a11_worst_peer", f"SELECT oid, peer, epoch FROM dirty WHERE peer <> {_WORST}")
def a11_worst_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty set once the peer with most records, the lesser name of several, has gone over to a full pass."""
    rows = inv.dirty(spark, sf_dir)
    worst = rows.groupBy("peer").count().orderBy(F.desc("count"), "peer").limit(1).select("peer")
    return rows.join(F.broadcast(worst), "peer", "left_anti").select("oid", "peer", "epoch")


@query("a12_dirty_count", "SELECT peer, count(*) AS n, max(epoch) AS latest FROM dirty GROUP BY peer")
def a12_dirty_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.dirty(spark, sf_dir).groupBy("peer").agg(F.count("*").alias("n"), F.max("epoch").alias("latest"))


@query("j10_dirty_objects", "SELECT c.iid, c.oid FROM copies c WHERE EXISTS (SELECT 1 FROM dirty d WHERE d.oid = c.oid AND d.peer = c.iid)")
def j10_dirty_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, dirty = inv.copies(spark, sf_dir).select("iid", "oid"), inv.dirty(spark, sf_dir)
    return copies.join(dirty.select("oid", F.col("peer").alias("iid")), ["iid", "oid"], "left_semi")


@query("a17_reclaimable", f"SELECT iid, count(*) FILTER (state = 'tomb' AND mtime < {NOW - TOMBDAYS * 86400} AND wepoch < {EPOCH}) AS n FROM copies GROUP BY iid")
def a17_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones older than the retention and of an epoch before this one, both strictly."""
    old = (F.col("state") == "tomb") & (F.col("mtime") < NOW - TOMBDAYS * 86400) & (F.col("wepoch") < EPOCH)
    return inv.copies(spark, sf_dir).groupBy("iid").agg(F.count_if(old).alias("n"))


@query("t6_confirmed_tombs", "SELECT oid FROM copies GROUP BY oid HAVING count(*) FILTER (state = 'tomb' AND NOT corrupt AND wepoch * 1000 + ver >= 0) = (SELECT count(*) FROM inst WHERE status <> 'dead')")
def t6_confirmed_tombs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which every member that isn't dead has a tombstone (specified, not built)."""
    members = inv.inst(spark).where("status <> 'dead'").count()
    tombs = F.count_if((F.col("state") == "tomb") & ~F.col("corrupt"))
    return inv.copies(spark, sf_dir).groupBy("oid").agg(tombs.alias("n")).where(F.col("n") == members).select("oid")


@query(
    "x17_reconcile_plan",
    """WITH ok AS (SELECT oid, max(wepoch * 1000 + ver) AS top FROM copies WHERE NOT corrupt GROUP BY oid)
     SELECT c.iid, c.oid, CASE WHEN ok.top IS NULL THEN 'lost' WHEN c.corrupt THEN 'repair' WHEN c.wepoch * 1000 + c.ver < ok.top THEN 'pull' ELSE 'current' END AS action
     FROM copies c LEFT JOIN ok USING (oid)""",
)
def x17_reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each copy needs so that all are current (specified, not built). One shuffle by object serves both sides."""
    w = Window.partitionBy("oid")
    top = F.max(F.when(~F.col("corrupt"), F.struct(*KEY))).over(w)
    rows = inv.copies(spark, sf_dir).withColumn("top", top)
    action = F.when(F.col("top").isNull(), "lost").when(F.col("corrupt"), "repair").when(F.struct(*KEY) < F.col("top"), "pull").otherwise("current")
    return rows.select("iid", "oid", action.alias("action"))


@query("j11_holders", "SELECT oid, count(*) AS n, string_agg(iid, ',' ORDER BY iid) AS holders FROM copies WHERE state = 'live' AND NOT corrupt GROUP BY oid")
def j11_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.copies(spark, sf_dir).where("state = 'live' and not corrupt")
    return rows.groupBy("oid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("iid")), ",").alias("holders"))


@query("f12_scrub_pace", "SELECT iid, CAST(sum(len + 1024) AS BIGINT) * 1000 // (4096 * 1024) AS planned_ms FROM copies WHERE state = 'live' GROUP BY iid")
def f12_scrub_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that a pass over each instance's objects takes at 4096 KiB a second, 1 KiB on top for each object."""
    return inv.copies(spark, sf_dir).where("state = 'live'").groupBy("iid").agg(F.expr("sum(len + 1024) * 1000 div (4096 * 1024)").alias("planned_ms"))
