"""Membership, liveness, fences, adoption of maps and witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.operators.placement import bounded, placement, sql_placed, strays
from stowage.plans.registry import query
from stowage.sources import inventory as inv

LEASE_MS, DEAD_MS = 3000, 10000
AT = "2024-06-01"


def last_seen(pings: DataFrame) -> DataFrame:
    """(iid, t): the last time each instance read the map, by reads that returned something."""
    return pings.where("role = 'instance' and bytes_read > 0").groupBy("iid").agg(F.max("ts").alias("t"))


_SEEN = "seen AS (SELECT iid, max(ts) AS t FROM pings WHERE role = 'instance' AND bytes_read > 0 GROUP BY iid)"


@query("x11_last_seen", f"WITH {_SEEN} SELECT iid, t FROM seen")
def x11_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_seen(inv.pings(spark, sf_dir))


@query("s21_instances", f"WITH {_SEEN} SELECT i.iid, i.status, i.up, 0 AS registered, coalesce((epoch_us(s.t) // 1000), 0) AS lastseen FROM inst i LEFT JOIN seen s USING (iid)")
def s21_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = last_seen(inv.pings(spark, sf_dir)).select("iid", F.unix_millis(F.col("t").cast("timestamp")).alias("lastseen"))
    return inv.inst(spark).join(F.broadcast(seen), "iid", "left").select("iid", "status", "up", F.lit(0).alias("registered"), F.coalesce("lastseen", F.lit(0)).alias("lastseen"))


@query("s22_ledger", "SELECT subject, reporter, since FROM stale")
def s22_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stale(spark)


def silence(now_ms: Column, seen_ms: Column, started_ms: Column) -> Column:
    """Milliseconds since an instance was seen, or since the start if it never was; 0 if the clock went back."""
    return F.greatest(F.lit(0), now_ms - F.coalesce(seen_ms, started_ms))


@query("s23_health", f"WITH {_SEEN} SELECT i.iid, greatest(0, (epoch_us(TIMESTAMP '{AT}') // 1000) - coalesce((epoch_us(s.t) // 1000), (epoch_us(TIMESTAMP '2024-01-01') // 1000))) AS silent FROM inst i LEFT JOIN seen s USING (iid)")
def s23_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda day: F.unix_millis(F.lit(day).cast("timestamp"))
    seen = last_seen(inv.pings(spark, sf_dir)).select("iid", F.unix_millis(F.col("t").cast("timestamp")).alias("t"))
    return inv.inst(spark).join(F.broadcast(seen), "iid", "left").select("iid", silence(at(AT), F.col("t"), at("2024-01-01")).alias("silent"))


@query("s24_monitor_status", "SELECT count(*) AS instances, count(*) FILTER (up = 'yes') AS up, count(*) FILTER (status = 'in') AS members, (SELECT count(*) FROM stale) AS stale, max(since) AS epoch FROM inst")
def s24_monitor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inv.inst(spark).agg(F.count("*").alias("instances"), F.count_if(F.col("up") == "yes").alias("up"), F.count_if(F.col("status") == "in").alias("members"), F.max("since").alias("epoch"))
    return own.join(inv.stale(spark).agg(F.count("*").alias("stale"))).select("instances", "up", "members", "stale", "epoch")


#: Milliseconds of a slot of time, in which silences are looked for apart.
SLOT_MS = 3_600_000


def silences(pings: DataFrame, dead_ms: int) -> DataFrame:
    """(iid, since, silent) for each silence of at least dead_ms, up to the next ping or the end of the log.

    Pings are dealt by instance and slot of time; between slots only the first and last ping of each are ordered.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = pings.where("role = 'instance' and bytes_read > 0").select("iid", ms.alias("ms")).withColumn("slot", F.expr(f"ms div {SLOT_MS}"))
    inside = rows.select("iid", F.col("ms").alias("since"), F.lead("ms").over(Window.partitionBy("iid", "slot").orderBy("ms")).alias("next")).where("next is not null")
    edges = rows.groupBy("iid", "slot").agg(F.min("ms").alias("a"), F.max("ms").alias("since"))
    end = pings.agg(F.max(ms).alias("end"))
    between = edges.select("iid", "since", F.lead("a").over(Window.partitionBy("iid").orderBy("slot")).alias("next"))
    between = between.join(F.broadcast(end)).select("iid", "since", F.coalesce("next", "end").alias("next"))
    return inside.union(between).select("iid", "since", (F.col("next") - F.col("since")).alias("silent")).where(F.col("silent") >= dead_ms)


@query("x12_lease_gaps", f"WITH g AS (SELECT iid, (epoch_us(coalesce(lead(ts) OVER (PARTITION BY iid ORDER BY ts), (SELECT max(ts) FROM pings))) // 1000) - (epoch_us(ts) // 1000) AS silent FROM pings WHERE role = 'instance' AND bytes_read > 0) SELECT iid, count(*) AS n, max(silent) AS longest FROM g WHERE silent >= {DEAD_MS} GROUP BY iid")
def x12_lease_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences long enough to demote each instance (specified, not built); one that the log ends in counts up to its end."""
    return silences(inv.pings(spark, sf_dir), DEAD_MS).groupBy("iid").agg(F.count("*").alias("n"), F.max("silent").alias("longest"))


@query("p8_down", "SELECT k.iid, i.iid IS NULL OR i.up = 'no' OR i.status IN ('out', 'dead') AS down, i.iid IS NOT NULL AND i.status <> 'dead' AS member FROM (SELECT DISTINCT iid FROM copies UNION ALL SELECT 'n9.0') k LEFT JOIN inst i USING (iid)")
def p8_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether instances count as down, and as members: one that a map doesn't have is down and none."""
    asked = inv.copies(spark, sf_dir).select("iid").distinct().union(spark.sql("select 'n9.0'"))
    known = inv.inst(spark).withColumn("known", F.lit(True))
    rows = asked.join(F.broadcast(known), "iid", "left")
    down = F.col("known").isNull() | (F.col("up") == "no") | F.col("status").isin("out", "dead")
    return rows.select("iid", down.alias("down"), (F.col("known").isNotNull() & (F.col("status") != "dead")).alias("member"))


_OFFERS = [("a", "m1", 41), ("b", "m2", 41), ("c", "m1", 39), ("d", "m2", 39), ("e", "m1", 40)]
_OFFERS_SQL = f"o AS (SELECT * FROM (VALUES {', '.join(map(str, _OFFERS))}) t(name, monid, epoch))"


@query("p10_adoptable", f"WITH {_OFFERS_SQL} SELECT name, (CASE WHEN epoch < 40 THEN 1 ELSE 0 END) | (CASE WHEN monid <> 'm1' THEN 2 ELSE 0 END) AS why FROM o")
def p10_adoptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why maps offered to an instance pinned to monitor m1 at epoch 40 are refused: 1 an older epoch, 2 another monitor."""
    rows = spark.createDataFrame(_OFFERS, "name string, monid string, epoch long")
    return rows.select("name", F.when(F.col("epoch") < 40, 1).otherwise(0).bitwiseOR(F.when(F.col("monid") != "m1", 2).otherwise(0)).alias("why"))


_EPOCHS = [(1, 40, 16384), (2, 41, 16384), (3, 43, 16384), (4, 44, 4096), (5, 45, 4096)]
_EPOCHS_SQL = f"m AS (SELECT * FROM (VALUES {', '.join(map(str, _EPOCHS))}) t(seq, epoch, blksz))"


@query("p11_map_sequence", f"WITH {_EPOCHS_SQL}, l AS (SELECT *, lag(epoch) OVER w AS e, lag(blksz) OVER w AS b FROM m WINDOW w AS (ORDER BY seq)) SELECT seq, e IS NULL OR (epoch = e + 1 AND blksz = b) AS ok, e IS NULL OR (epoch > e AND blksz = b) AS ok_forced FROM l")
def p11_map_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each map may follow the one before: the next epoch, or under force a later one, and nothing immutable changed."""
    w = Window.orderBy("seq")  # a ring has a few dozen
    rows = spark.createDataFrame(_EPOCHS, "seq long, epoch long, blksz long").withColumns({"e": F.lag("epoch").over(w), "b": F.lag("blksz").over(w)})
    first, same = F.col("e").isNull(), F.col("blksz") == F.col("b")
    return rows.select("seq", (first | ((F.col("epoch") == F.col("e") + 1) & same)).alias("ok"), (first | ((F.col("epoch") > F.col("e")) & same)).alias("ok_forced"))


def fence(fenced: Column, last_ms: Column, now_ms: Column, lease_ms: int = LEASE_MS) -> Column:
    """Bits: 1 an operator's fence, 2 a lease that ran out, was never refreshed or lies in the future."""
    lease = last_ms.isNull() | (now_ms < last_ms) | (now_ms - last_ms >= lease_ms)
    return F.when(fenced, 1).otherwise(0).bitwiseOR(F.when(lease, 2).otherwise(0))


_FENCES = [("a", False, 97000), ("b", False, 97001), ("c", True, 100000), ("d", False, None), ("e", True, 100001)]
_FENCES_SQL = f"f AS (SELECT * FROM (VALUES {', '.join(map(str, _FENCES)).replace('True', 'true').replace('False', 'false').replace('None', 'NULL')}) t(iid, fenced, last))"


@query("p12_fence", f"WITH {_FENCES_SQL} SELECT iid, (CASE WHEN fenced THEN 1 ELSE 0 END) | (CASE WHEN last IS NULL OR 100000 < last OR 100000 - last >= {LEASE_MS} THEN 2 ELSE 0 END) AS kind FROM f")
def p12_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_FENCES, "iid string, fenced boolean, last long")
    return rows.select("iid", fence(F.col("fenced"), F.col("last"), F.lit(100000)).alias("kind"))


@query("p13_fence_names", f"WITH {_FENCES_SQL} SELECT iid, CASE WHEN fenced AND (last IS NULL OR last > 100000 OR last <= 97000) THEN 'both' WHEN fenced THEN 'operator' WHEN last IS NULL OR last > 100000 OR last <= 97000 THEN 'lease' ELSE 'none' END AS fence FROM f")
def p13_fence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in ((0, "none"), (1, "operator"), (2, "lease"), (3, "both")) for x in pair])
    return p12_fence(spark, sf_dir).select("iid", F.element_at(names, F.col("kind")).alias("fence"))


_STATES = [(s, u, f) for s in ("new", "in", "out", "dead") for u in ("yes", "heal", "no") for f in (False, True)]
_STATES_SQL = f"s AS (SELECT * FROM (VALUES {', '.join(map(str, _STATES)).replace('True', 'true').replace('False', 'false')}) t(status, up, fenced))"


@query("p14_legal_states", f"WITH {_STATES_SQL} SELECT status, up, fenced, NOT (status = 'dead' AND (up <> 'no' OR fenced)) AND NOT (status = 'new' AND up = 'heal') AND NOT (fenced AND up <> 'no') AS legal FROM s")
def p14_legal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_STATES, "status string, up string, fenced boolean")
    dead = (F.col("status") == "dead") & ((F.col("up") != "no") | F.col("fenced"))
    return rows.withColumn("legal", ~dead & ~((F.col("status") == "new") & (F.col("up") == "heal")) & ~(F.col("fenced") & (F.col("up") != "no")))


_TIMINGS = [("ok", 1000, 3000, 10000, 1000), ("lease", 1000, 1000, 10000, 1000), ("dead", 1000, 3000, 3000, 1000), ("repl", 1000, 3000, 10000, 10000)]
_TIMINGS_SQL = f"t AS (SELECT * FROM (VALUES {', '.join(map(str, _TIMINGS))}) t(name, pollms, leasems, deadms, replms))"


@query("p15_timing", f"WITH {_TIMINGS_SQL} SELECT name, leasems > pollms AND deadms > leasems AND replms < deadms AS ok FROM t")
def p15_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_TIMINGS, "name string, pollms long, leasems long, deadms long, replms long")
    return rows.selectExpr("name", "leasems > pollms and deadms > leasems and replms < deadms as ok")


_MARKS = [("n2.0", "n1.1"), ("n2.0", "n1.1"), ("n3.0", "n3.0"), ("n9.0", "n1.0"), ("n1.0", None), ("n3.0", "n2.0")]
_MARKS_SQL = f"k AS (SELECT * FROM (VALUES {', '.join(map(str, _MARKS)).replace('None', 'NULL')}) t(subject, reporter))"


@query(
    "p17_ledger_faults",
    f"""WITH {_MARKS_SQL}, c AS (SELECT subject, reporter, count(*) AS n FROM k GROUP BY ALL)
    SELECT subject, reporter, CASE WHEN reporter IS NULL THEN 'no reporter' WHEN reporter = subject THEN 'self' WHEN n > 1 THEN 'two' WHEN subject NOT IN (SELECT iid FROM inst) OR reporter NOT IN (SELECT iid FROM inst) THEN 'dangling' END AS fault FROM c
    WHERE reporter IS NULL OR reporter = subject OR n > 1 OR subject NOT IN (SELECT iid FROM inst) OR reporter NOT IN (SELECT iid FROM inst)""",
)
def p17_ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame(_MARKS, "subject string, reporter string").groupBy("subject", "reporter").agg(F.count("*").alias("n"))
    known = inv.inst(spark).select("iid")
    rows = marks.join(F.broadcast(known.select(F.col("iid").alias("subject"), F.lit(True).alias("s"))), "subject", "left").join(F.broadcast(known.select(F.col("iid").alias("reporter"), F.lit(True).alias("r"))), "reporter", "left")
    fault = F.when(F.col("reporter").isNull(), "no reporter").when(F.col("reporter") == F.col("subject"), "self").when(F.col("n") > 1, "two").when(F.col("s").isNull() | F.col("r").isNull(), "dangling")
    return rows.select("subject", "reporter", fault.alias("fault")).where("fault is not null")


@query("p18_split_zones", "SELECT node, count(DISTINCT zone) AS zones FROM (SELECT node, CASE WHEN idx > 1 THEN 'b' ELSE 'a' END AS zone FROM inst) GROUP BY node HAVING count(DISTINCT zone) > 1")
def p18_split_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.inst(spark).select("node", F.when(F.col("idx") > 1, "b").otherwise("a").alias("zone"))
    return rows.groupBy("node").agg(F.count_distinct("zone").alias("zones")).where("zones > 1")


@query("j2_ledger_members", "SELECT s.subject, a.up AS subject_up, s.reporter, b.up AS reporter_up, s.since FROM stale s JOIN inst a ON a.iid = s.subject JOIN inst b ON b.iid = s.reporter")
def j2_ledger_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inv.inst(spark)
    rows = inv.stale(spark).join(F.broadcast(m.select(F.col("iid").alias("subject"), F.col("up").alias("subject_up"))), "subject")
    return rows.join(F.broadcast(m.select(F.col("iid").alias("reporter"), F.col("up").alias("reporter_up"))), "reporter").select("subject", "subject_up", "reporter", "reporter_up", "since")


@query("t3_ledger_union", "SELECT subject, reporter FROM stale UNION SELECT subject, reporter FROM stale WHERE since > 5 UNION SELECT 'n1.0', 'n3.2'")
def t3_ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger put together from what members report (specified, not built)."""
    one = inv.stale(spark)
    return one.select("subject", "reporter").union(one.where("since > 5").select("subject", "reporter")).union(spark.sql("select 'n1.0', 'n3.2'")).distinct()


@query("t7_heal_gate", "SELECT i.iid, NOT EXISTS (SELECT 1 FROM stale s WHERE s.subject = i.iid) AND (SELECT bool_and(j.since >= 6) FROM inst j WHERE j.up = 'yes') AS open FROM inst i WHERE i.up = 'heal'")
def t7_heal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a healing member may come back: nobody marks it and all that are up have the epoch (specified, not built)."""
    m = inv.inst(spark)
    synced = m.where("up = 'yes'").agg(F.bool_and(F.col("since") >= 6).alias("synced"))
    marked = inv.stale(spark).select(F.col("subject").alias("iid"), F.lit(True).alias("marked")).distinct()
    return m.where("up = 'heal'").join(F.broadcast(marked), "iid", "left").join(F.broadcast(synced)).select("iid", (F.col("marked").isNull() & F.col("synced")).alias("open"))


PLACE, PREVIOUS, STRAY, REPORTER = 1, 2, 4, 8


def witnesses(objects: DataFrame, members: DataFrame, before: DataFrame | None, ledger: DataFrame, replicas: int, profile: str = "blake2s", strays: DataFrame | None = None, open_pass: bool = False) -> DataFrame:
    """(oid, iid, why, how): who must be asked before an object counts as current; members that are dead never are.

    why: in the placement (1), in the one an epoch before (2), a known stray holder (4), and the reporter of a mark on
    a member of either placement (8). Where there is no map of the epoch before, or a reconcile pass is still open,
    every member stands for clause 2; marks are then looked up in the placements that there are. how: query those that
    are up or healing; of those that are down a reporter blocks, others are skipped. Members and ledger are
    bounded by the map, so all is worked out in each object's row; strays (oid, iid) are joined by object.
    """
    rows = bounded(members.where("status <> 'dead'").select("iid", "up"))
    marks = [(x.subject, x.reporter) for x in bounded(ledger)]
    known = [x.iid for x in bounded(members.select("iid"))]
    p, none = placement(members, F.col("oid"), replicas, profile), F.array().cast("array<string>")
    q = none if before is None else F.filter(placement(before, F.col("oid"), replicas, profile), lambda i: i.isin(known))
    objects = objects.select("oid")
    if strays is not None:
        held = strays.groupBy("oid").agg(F.collect_set("iid").alias("s"))
        objects = objects.join(held, "oid", "left")
    asked = objects.select("oid", p.alias("p"), q.alias("q"), F.coalesce("s", none).alias("s") if strays is not None else none.alias("s"))
    found = []
    for x in rows:
        scope = [F.array_contains("p", s) | F.array_contains("q", s) for s, r in marks if r == x.iid and s in known]
        reporter = F.lit(False)
        for s in scope:
            reporter = reporter | s
        earlier = F.lit(True) if before is None or open_pass else F.array_contains("q", x.iid)
        clauses = [(F.array_contains("p", x.iid), PLACE), (earlier, PREVIOUS), (F.array_contains("s", x.iid), STRAY), (reporter, REPORTER)]
        why = sum((F.when(c, bit).otherwise(0) for c, bit in clauses[1:]), F.when(clauses[0][0], PLACE).otherwise(0))
        how = F.when(F.lit(x.up != "no"), "query").when(reporter, "block").otherwise("skip")
        found.append(F.struct(F.lit(x.iid).alias("iid"), why.alias("why"), how.alias("how")))
    return asked.select("oid", F.explode(F.array(*found)).alias("x")).where("x.why > 0").select("oid", "x.iid", "x.why", "x.how")


def _witness_sql(previous: str) -> str:
    """previous: rows (oid, iid) of clause 2."""
    return f"""WITH ko AS (SELECT DISTINCT oid FROM copies), {sql_placed("p", "ko", "inst")}, {sql_placed("q", "ko")}, w AS (
      SELECT oid, iid, 1 AS why FROM p UNION ALL SELECT oid, iid, 2 FROM ({previous})
      UNION ALL SELECT c.oid, c.iid, 4 FROM copies c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.oid = c.oid AND p.iid = c.iid)
      UNION ALL SELECT DISTINCT x.oid, s.reporter, 8 FROM (SELECT oid, iid FROM p UNION SELECT q.oid, q.iid FROM q JOIN inst USING (iid)) x JOIN stale s ON s.subject = x.iid)
    SELECT w.oid, w.iid, CAST(bit_or(why) AS INTEGER) AS why, CASE WHEN any_value(i.up) <> 'no' THEN 'query' WHEN bit_or(why) & 8 > 0 THEN 'block' ELSE 'skip' END AS how
    FROM w JOIN inst i ON i.iid = w.iid WHERE i.status <> 'dead' GROUP BY w.oid, w.iid"""


def _witnesses(spark: SparkSession, sf_dir: str, open_pass: bool) -> DataFrame:
    copies, now = inv.copies(spark, sf_dir), inv.inst(spark)
    return witnesses(copies.select("oid").distinct(), now, inv.inst_prev(spark), inv.stale(spark), 2, "sha256", strays(copies, now, 2, "sha256"), open_pass)


@query("x16_witnesses_sha", _witness_sql("SELECT q.oid, q.iid FROM q JOIN inst USING (iid)"))
def x16_witnesses_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _witnesses(spark, sf_dir, False)


@query("x16_open_pass_sha", _witness_sql("SELECT ko.oid, i.iid FROM ko CROSS JOIN inst i"))
def x16_open_pass_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while a reconcile pass is open: every member counts as one of the epoch before."""
    return _witnesses(spark, sf_dir, True)
