"""Files of an instance and of the monitor as rows, weighted placement, and what is left of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.digest import INSTANCE, NODE, score
from stowage.operators.placement import bounded, placement, sql_placed
from stowage.plans.registry import query
from stowage.sources import inventory as inv


@query("s2_bitmap_pages", "SELECT grain // 4096 AS page, count(*) AS marked, CASE WHEN (grain // 4096) % 11 = 7 THEN -1 ELSE (grain // 4096) % 5 END AS ckseq FROM bitmap GROUP BY 1, 3")
def s2_bitmap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the checkpoint they are of; pages mod 11 = 7 are planted as unreadable: -1."""
    page = F.expr("grain div 4096")
    rows = inv.bitmap(spark, sf_dir).groupBy(page.alias("page")).agg(F.count("*").alias("marked"))
    return rows.select("page", "marked", F.when(F.col("page") % 11 == 7, -1).otherwise(F.col("page") % 5).alias("ckseq"))


@query("s2_rebuild_needed", "SELECT count(*) FILTER (p % 11 = 7) > 0 AS rebuild, max(p % 5) FILTER (p % 11 <> 7) AS ckseq FROM (SELECT DISTINCT grain // 4096 AS p FROM bitmap)")
def s2_rebuild_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = s2_bitmap_pages(spark, sf_dir)
    return pages.agg((F.count_if(F.col("ckseq") < 0) > 0).alias("rebuild"), F.max("ckseq").alias("ckseq"))


@query("s3_dirty_scan", "SELECT oid, peer, epoch FROM dirty")
def s3_dirty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.dirty(spark, sf_dir)


@query("s4_slot_cursor", "SELECT s.slot, CASE WHEN s.slot >= 8192 THEN -1 WHEN c.oid IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT unnest([1, 2, 3, 5, 33, 8191, 8192, 9000]) AS slot) s LEFT JOIN (SELECT DISTINCT oid, CAST(substr(oid, 5) AS BIGINT) AS slot FROM copies) c USING (slot)")
def s4_slot_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What slots hold, of a store of 8192 slots that files each object under its number: 1 a record, 0 none, -1 no slot."""
    held = inv.copies(spark, sf_dir).select(F.substring_index("oid", ".", -1).cast("long").alias("slot")).distinct().withColumn("held", F.lit(1))
    asked = spark.sql("select explode(array(1L, 2L, 3L, 5L, 33L, 8191L, 8192L, 9000L)) as slot")
    return held.join(F.broadcast(asked), "slot", "right").select("slot", F.when(F.col("slot") >= 8192, -1).otherwise(F.coalesce("held", F.lit(0))).alias("found"))


@query("s8_peers_behind", "SELECT peer, count(*) AS fine FROM dirty WHERE peer IN (SELECT iid FROM inst WHERE up <> 'no') GROUP BY peer")
def s8_peers_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine records of peers that don't need a full pass."""
    return inv.dirty(spark, sf_dir).join(F.broadcast(inv.inst(spark).where("up <> 'no'").select(F.col("iid").alias("peer"))), "peer", "left_semi").groupBy("peer").agg(F.count("*").alias("fine"))


@query(
    "s11_meta_sha",
    f"""WITH ko AS (SELECT DISTINCT oid FROM copies), {sql_placed(o="ko", m="inst")}, pl AS (SELECT p.oid, string_agg(p.iid, ',' ORDER BY p.rank) AS placement, min_by(p.iid, p.rank) FILTER (i.up = 'yes') AS pr FROM p JOIN inst i USING (iid) GROUP BY p.oid)
    SELECT c.iid, c.oid, concat('oid=', c.oid, ' len=', len, ' ver=', ver, ' wepoch=', wepoch, ' csum=', csum, ' state=live mtime=', mtime, ' blksz=16384 cur=0 placement=', placement, ' primary=', coalesce(pr, '-'), ' ready=no') AS line
    FROM copies c JOIN pl USING (oid) WHERE state = 'live' AND NOT corrupt""",
)
def s11_meta_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that an instance shows for each live object; placement and primary come from one member list."""
    members = inv.inst(spark)
    up = [x.iid for x in bounded(members.where("up = 'yes'").select("iid"))]
    rows = inv.copies(spark, sf_dir).where("state = 'live' and not corrupt").withColumn("p", placement(members, F.col("oid"), 2, "sha256"))
    first = F.coalesce(F.get(F.filter("p", lambda i: i.isin(up)), F.lit(0)), F.lit("-"))
    at = F.when(F.size("p") > 0, F.array_join("p", ",")).otherwise("-")
    line = F.format_string("oid=%s len=%d ver=%d wepoch=%d csum=%s state=live mtime=%d blksz=16384 cur=0 placement=%s primary=%s ready=no", "oid", "len", "ver", "wepoch", "csum", "mtime", at, first)
    return rows.select("iid", "oid", line.alias("line"))


_HISTORY = [(1, 40, "map=a epoch=40"), (2, 41, "map=a epoch=41"), (3, 41, "map=b epoch=41"), (4, 42, "map=a epoch=42")]
_HISTORY_SQL = f"h AS (SELECT * FROM (VALUES {', '.join(map(str, _HISTORY))}) t(seq, epoch, text))"


@query("s20_map_texts", f"WITH {_HISTORY_SQL} SELECT epoch, max_by(text, seq) AS text FROM h GROUP BY epoch")
def s20_map_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text under each epoch: the latest of several."""
    return spark.createDataFrame(_HISTORY, "seq long, epoch long, text string").groupBy("epoch").agg(F.max_by("text", "seq").alias("text"))


@query("s15_current_map", f"WITH {_HISTORY_SQL} SELECT text FROM h ORDER BY seq DESC LIMIT 1")
def s15_current_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_HISTORY, "seq long, epoch long, text string").orderBy(F.desc("seq")).limit(1).select("text")


@query("s19_jobs", "SELECT 'job=verify state=running rate=4096 done=' || count(*) FILTER (NOT corrupt) || '/' || count(*) || ' bad=' || count(*) FILTER (corrupt) || ' reclaimable=' || count(*) FILTER (state = 'tomb') AS line, iid FROM copies GROUP BY iid")
def s19_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each instance's pass over its records."""
    n = inv.copies(spark, sf_dir).groupBy("iid").agg(F.count_if(~F.col("corrupt")).alias("done"), F.count("*").alias("total"), F.count_if("corrupt").alias("bad"), F.count_if(F.col("state") == "tomb").alias("t"))
    return n.select(F.format_string("job=verify state=running rate=4096 done=%d/%d bad=%d reclaimable=%d", "done", "total", "bad", "t").alias("line"), "iid")


@query("j12_self", "SELECT iid FROM inst WHERE md5(iid) = md5('n2.0')")
def j12_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that an instance is, by its unique name."""
    return inv.inst(spark).where(F.md5("iid") == F.md5(F.lit("n2.0"))).select("iid")


def _candidates(oid: Column, domain: str, name: str, copies: int, profile: str) -> Column:
    """The best of an instance's or node's virtual copies: the bare name, then the name with 1, 2 and so on."""
    names = [name, *[f"{name}\0{j}" for j in range(1, copies)]]
    return F.array_max(F.array(*[F.struct(score(oid, domain, F.lit(n), profile).alias("s"), F.lit(n).alias("c")) for n in names]))


def weighted_placement(members: list[tuple[str, str, int]], oid: Column, replicas: int, profile: str = "blake2s") -> Column:
    """Placement with weights, in hundreds (specified, not built). members: (node, iid, copies)."""
    ranked = []
    for node in sorted({m[0] for m in members}):
        own = [(i, k) for n, i, k in sorted(members) if n == node]
        best = F.array_max(F.array(*[F.struct(_candidates(oid, INSTANCE, i, k, profile).alias("x"), F.lit(i).alias("iid")) for i, k in own]))
        ranked.append(F.struct(_candidates(oid, NODE, node, sum(k for _, k in own), profile).alias("x"), best["iid"].alias("iid")))
    return F.transform(F.slice(F.reverse(F.array_sort(F.array(*ranked))), 1, replicas), lambda r: r["iid"])


_WEIGHTS = [("n1", "n1.0", 1), ("n1", "n1.1", 3), ("n2", "n2.0", 1), ("n3", "n3.0", 2), ("n3", "n3.2", 1)]


@query(
    "w10_weighted_sha",
    f"""WITH m AS (SELECT * FROM (VALUES {", ".join(map(str, _WEIGHTS))}) t(node, iid, k)), nk AS (SELECT node, sum(k)::INT AS k FROM m GROUP BY node),
    ni AS (SELECT node, CASE WHEN j = 0 THEN node ELSE node || chr(0) || j END AS c FROM (SELECT node, unnest(range(0, k)) AS j FROM nk)),
    ii AS (SELECT node, iid, CASE WHEN j = 0 THEN iid ELSE iid || chr(0) || j END AS c FROM (SELECT node, iid, unnest(range(0, k)) AS j FROM m)),
    sn AS (SELECT oid, node, max(substr(sha256(oid || chr(0) || 'N' || c), 1, 16)) AS s FROM doc_oids, ni GROUP BY ALL),
    si AS (SELECT oid, node, max_by(iid, substr(sha256(oid || chr(0) || 'D' || c), 1, 16)) AS iid FROM doc_oids, ii GROUP BY ALL),
    r AS (SELECT oid, node, row_number() OVER (PARTITION BY oid ORDER BY s DESC) AS rn FROM sn)
    SELECT r.oid, rn - 1 AS rank, si.iid FROM r JOIN si USING (oid, node) WHERE rn <= 2""",
)
def w10_weighted_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.doc_oids(spark, sf_dir).withColumn("p", weighted_placement(_WEIGHTS, F.col("oid"), 2, "sha256"))
    return rows.select("oid", F.posexplode("p").alias("rank", "iid")).withColumn("rank", F.col("rank").cast("long"))


#: Fixed codes of kinds, by number.
_CODES = {"state": ["free", "live", "tomb"], "up": ["yes", "heal", "no"], "status": ["new", "in", "out", "dead"]}


@query("f10_code_names", f"SELECT * FROM (VALUES {', '.join(str((k, i, v)) for k, vs in _CODES.items() for i, v in enumerate(vs))}) t(kind, code, name)")
def f10_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, i, v) for k, vs in _CODES.items() for i, v in enumerate(vs)], "kind string, code int, name string")


@query("x13_pass_schedule", "SELECT iid, CAST(sum(len + 1024) AS BIGINT) AS bytes, 14 * 86400 AS period, CAST(sum(len + 1024) AS BIGINT) // (14 * 86400) AS bytes_a_second FROM copies WHERE state = 'live' GROUP BY iid")
def x13_pass_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least rate at which a pass over each instance's objects ends within its period of 14 days."""
    rows = inv.copies(spark, sf_dir).where("state = 'live'").groupBy("iid").agg(F.sum(F.col("len") + 1024).alias("bytes"))
    return rows.selectExpr("iid", "bytes", "14 * 86400 as period", "bytes div (14 * 86400) as bytes_a_second")


@query("x3_forget_pass", "SELECT peer, count(*) FILTER (epoch < 4) AS forgotten, count(*) FILTER (epoch >= 4) AS kept FROM dirty GROUP BY peer")
def x3_forget_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty records that go once a peer is synced up to epoch 4."""
    return inv.dirty(spark, sf_dir).groupBy("peer").agg(F.count_if(F.col("epoch") < 4).alias("forgotten"), F.count_if(F.col("epoch") >= 4).alias("kept"))
