"""Two-level rendezvous placement, and what follows from it.

All scores of an object are worked out in its own row from the member list, which a map bounds to a few
dozen entries, so placing any number of objects takes no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.digest import INSTANCE, NODE, score
from stowage.plans.registry import query
from stowage.sources import inventory as inv


#: Members that a map has at most; whatever is worked out in an object's own row is bounded by it.
MEMBERS = 4096


def bounded(members: DataFrame) -> list:
    """The rows of a map's members, marks or the like; more than a map can have are refused."""
    rows = members.limit(MEMBERS + 1).collect()
    if len(rows) > MEMBERS:
        raise ValueError(f"a map has at most {MEMBERS} members")
    return rows


def placement(members: DataFrame, oid: Column, replicas: int, profile: str = "blake2s") -> Column:
    """The ordered list of instances of an object.

    Nodes with a member of status `in` rank by score, then by greater name; the best `replicas` nodes each give
    their best instance. Scores are fixed-width hex, so the greatest structure is the greatest score.
    """
    nodes: dict[str, list[str]] = {}
    for x in sorted((x.node, x.iid) for x in bounded(members.where("status = 'in'").select("node", "iid"))):
        nodes.setdefault(x[0], []).append(x[1])

    def ranked(node: str) -> Column:
        best = [F.struct(score(oid, INSTANCE, F.lit(i), profile).alias("s"), F.lit(i).alias("iid")) for i in nodes[node]]
        return F.struct(score(oid, NODE, F.lit(node), profile).alias("s"), F.lit(node).alias("node"), F.array_max(F.array(*best))["iid"].alias("iid"))

    if not nodes:
        return F.array().cast("array<string>")
    return F.transform(F.slice(F.reverse(F.array_sort(F.array(*[ranked(n) for n in sorted(nodes)]))), 1, replicas), lambda x: x["iid"])


def place(objects: DataFrame, members: DataFrame, replicas: int, profile: str = "blake2s") -> DataFrame:
    """(oid, placement) of each object."""
    return objects.select("oid", placement(members, F.col("oid"), replicas, profile).alias("placement"))


def placed(objects: DataFrame, members: DataFrame, replicas: int, profile: str = "blake2s") -> DataFrame:
    """(oid, rank, iid), rank from 0."""
    return place(objects, members, replicas, profile).select("oid", F.posexplode("placement").alias("rank", "iid")).withColumn("rank", F.col("rank").cast("long"))


def primary(objects: DataFrame, members: DataFrame, replicas: int, profile: str = "blake2s") -> DataFrame:
    """(oid, primary): the first of the placement that is up; null if none is."""
    up = [x.iid for x in bounded(members.where("up = 'yes'").select("iid"))]
    first = F.get(F.filter("placement", lambda i: i.isin(up)), F.lit(0))
    return place(objects, members, replicas, profile).select("oid", first.alias("primary"))


#: Placement in SQL under the sha256 profile, of the objects {o} over the members {m}.
PLACED = """
  {p}_s AS (SELECT o.oid, i.node, i.iid, substr(sha256(o.oid || chr(0) || 'N' || i.node), 1, 16) AS sn, substr(sha256(o.oid || chr(0) || 'D' || i.iid), 1, 16) AS si
            FROM {o} o CROSS JOIN (SELECT * FROM {m} WHERE status = 'in') i),
  {p}_b AS (SELECT *, row_number() OVER (PARTITION BY oid, node ORDER BY si DESC, iid DESC) AS a FROM {p}_s),
  {p}_r AS (SELECT oid, iid, row_number() OVER (PARTITION BY oid ORDER BY sn DESC, node DESC) - 1 AS rank FROM {p}_b WHERE a = 1),
  {p} AS (SELECT oid, rank, iid FROM {p}_r WHERE rank < {r})"""


def sql_placed(p: str = "p", o: str = "doc_oids", m: str = "inst_prev", r: int = 2) -> str:
    return PLACED.format(p=p, o=o, m=m, r=r)


@query("w1_placement_sha", f"WITH {sql_placed(r=3)} SELECT oid, rank, iid FROM p")
def w1_placement_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(inv.doc_oids(spark, sf_dir), inv.inst_prev(spark), 3, "sha256")


@query("w1_placement_blake2s")
def w1_placement_blake2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(inv.doc_oids(spark, sf_dir), inv.inst_prev(spark), 3)


@query("w2_scores_sha", f"WITH {sql_placed()} SELECT oid, iid, sn, si FROM p_s")
def w2_scores_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.doc_oids(spark, sf_dir).join(F.broadcast(inv.inst_prev(spark).where("status = 'in'")))  # a map's members
    return rows.select("oid", "iid", score(F.col("oid"), NODE, F.col("node"), "sha256").alias("sn"), score(F.col("oid"), INSTANCE, F.col("iid"), "sha256").alias("si"))


@query("w3_primary_sha", f"WITH {sql_placed(m='inst')} SELECT d.oid, (SELECT min_by(p.iid, p.rank) FROM p JOIN inst i USING (iid) WHERE p.oid = d.oid AND i.up = 'yes') AS \"primary\" FROM doc_oids d")
def w3_primary_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primary(inv.doc_oids(spark, sf_dir), inv.inst(spark), 2, "sha256")


@query("a10_nodes", "SELECT DISTINCT node FROM inst WHERE status = 'in'")
def a10_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inst(spark).where("status = 'in'").select("node").distinct()


@query("a13_under_replicated_sha", f"WITH {sql_placed(m='inst', r=4)} SELECT oid, count(*) AS n, count(*) < 4 AS under FROM p GROUP BY oid")
def a13_under_replicated_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("placement").cast("long")
    return place(inv.doc_oids(spark, sf_dir), inv.inst(spark), 4, "sha256").select("oid", n.alias("n"), (n < 4).alias("under"))


@query(
    "p27_admission_sha",
    f"""WITH {sql_placed(m="inst")}, f AS (SELECT d.oid, (SELECT min_by(p.iid, p.rank) FROM p JOIN inst i USING (iid) WHERE p.oid = d.oid AND i.up = 'yes') AS f FROM doc_oids d)
    SELECT oid, CASE WHEN f IS NULL THEN 'unavailable' WHEN f = 'n1.0' THEN 'admit' ELSE 'not primary: ' || f END AS verdict FROM f""",
)
def p27_admission_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What instance n1.0 answers a client that asks for each object."""
    first = F.col("primary")
    verdict = F.when(first.isNull(), "unavailable").when(first == "n1.0", "admit").otherwise(F.concat(F.lit("not primary: "), first))
    return primary(inv.doc_oids(spark, sf_dir), inv.inst(spark), 2, "sha256").select("oid", verdict.alias("verdict"))


@query("p28_degraded_sha", f"WITH {sql_placed(m='inst')} SELECT oid, count(*) > 1 AS degraded FROM p GROUP BY oid")
def p28_degraded_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(inv.doc_oids(spark, sf_dir), inv.inst(spark), 2, "sha256").select("oid", (F.size("placement") > 1).alias("degraded"))


@query("j1_primary_load_sha", f"WITH {sql_placed()} SELECT iid, count(*) AS n FROM p WHERE rank = 0 GROUP BY iid")
def j1_primary_load_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the instance that comes first."""
    return place(inv.doc_oids(spark, sf_dir), inv.inst_prev(spark), 2, "sha256").groupBy(F.get("placement", F.lit(0)).alias("iid")).agg(F.count("*").alias("n"))


@query("j3_carried_over_sha", f"WITH {sql_placed()}, e AS (SELECT oid, rank, iid FROM p) SELECT e.oid, e.rank, e.iid, i.status FROM e JOIN inst i USING (iid)")
def j3_carried_over_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placement under the map before, as the current map names it; members that are gone drop out."""
    now = inv.inst(spark).select("iid", "status")
    return placed(inv.doc_oids(spark, sf_dir), inv.inst_prev(spark), 2, "sha256").join(F.broadcast(now), "iid").select("oid", "rank", "iid", "status")


def strays(copies: DataFrame, members: DataFrame, replicas: int, profile: str = "blake2s") -> DataFrame:
    """(iid, oid, state) of copies (iid, oid, state) that are where their placement doesn't put them.

    Each object is placed once: its copies, one for each member at most, are gathered in its row first.
    """
    held = copies.groupBy("oid").agg(F.collect_list(F.struct("iid", "state")).alias("held"))
    rows = held.select("oid", placement(members, F.col("oid"), replicas, profile).alias("p"), "held")
    rows = rows.select("oid", F.explode(F.filter("held", lambda x: ~F.array_contains("p", x["iid"]))).alias("x"))
    return rows.select("x.iid", "oid", "x.state")


@query("j8_strays_sha", f"WITH ko AS (SELECT DISTINCT oid FROM copies), {sql_placed(o='ko')} SELECT c.iid, c.oid, c.state FROM copies c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.oid = c.oid AND p.iid = c.iid)")
def j8_strays_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strays(inv.copies(spark, sf_dir), inv.inst_prev(spark), 2, "sha256")
