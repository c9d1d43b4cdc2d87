"""Decisions on identifiers, roles, epochs and replicated operations, as expressions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.placement import bounded
from stowage.plans.registry import query
from stowage.sources import inventory as inv

# --- identifiers and scalar functions

_NAMES = ["a", "a.b", ".", "..", "a/b", "", "x" * 128, "x" * 129, "sys.map", "ord.1", "é", "A_b-c"]
_NAMES_SQL = f"n AS (SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in _NAMES)}) t(oid))"


def oid_ok(oid: Column) -> Column:
    """1 to 128 letters, digits, dots, underscores and hyphens, but neither of the two directory names."""
    return oid.rlike(r"^[A-Za-z0-9._-]{1,128}\z") & ~oid.isin(".", "..")


def reserved(oid: Column, prefix: str = "sys.") -> Column:
    """Names that a store keeps for itself, by a prefix that the deployment sets."""
    return F.startswith(oid, F.lit(prefix))


@query("p1_names", f"WITH {_NAMES_SQL} SELECT oid, regexp_full_match(oid, '[A-Za-z0-9._-]{{1,128}}') AND oid NOT IN ('.', '..') AS ok, starts_with(oid, 'sys.') AS reserved FROM n")
def p1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _NAMES], "oid string")
    return rows.select("oid", oid_ok(F.col("oid")).alias("ok"), reserved(F.col("oid")).alias("reserved"))


@query("f1_hex", "SELECT DISTINCT csum, lower(hex(unhex(upper(csum)))) AS back, regexp_full_match(csum, '[0-9a-f]{64}') AS ok FROM copies")
def f1_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.copies(spark, sf_dir).select("csum").distinct()
    return rows.select("csum", F.lower(F.hex(F.unhex(F.upper("csum")))).alias("back"), F.col("csum").rlike(r"^[0-9a-f]{64}\z").alias("ok"))


_NUMBERS = ["0", "12", "+1", "-1", "0x1", " 1", "1 ", "", "18446744073709551615", "18446744073709551616", "000000000000000000001", "007"]


def strict_u64(text: Column) -> Column:
    """The unsigned 64-bit number that up to 20 digits stand for, with nothing around them; null for anything else."""
    number = F.when(text.rlike(r"^[0-9]{1,20}\z"), text.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


@query("f2_strict_numbers", f"WITH n AS (SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in _NUMBERS)}) t(text)) SELECT text, CAST(CASE WHEN regexp_full_match(text, '[0-9]{{1,20}}') AND TRY_CAST(text AS HUGEINT) <= 18446744073709551615 THEN CAST(TRY_CAST(text AS HUGEINT) AS VARCHAR) END AS VARCHAR) AS value FROM n")
def f2_strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _NUMBERS], "text string").select("text", strict_u64(F.col("text")).cast("string").alias("value"))


_IIDS = ["n1.0", "n2.01", "n2.", ".1", "n-1.7", "n2", "n2.10", "n.2.3"]


@query("f5_iid_split", f"WITH n AS (SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in _IIDS)}) t(iid)) SELECT iid, CASE WHEN regexp_full_match(iid, '[A-Za-z0-9_-]+[.](0|[1-9][0-9]*)') THEN split_part(iid, '.', 1) END AS node, CASE WHEN regexp_full_match(iid, '[A-Za-z0-9_-]+[.](0|[1-9][0-9]*)') THEN split_part(iid, '.', 2) END AS idx FROM n")
def f5_iid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("iid").rlike(r"^[A-Za-z0-9_-]+[.](0|[1-9][0-9]*)\z")
    rows = spark.createDataFrame([(x,) for x in _IIDS], "iid string")
    return rows.select("iid", F.when(ok, F.substring_index("iid", ".", 1)).alias("node"), F.when(ok, F.substring_index("iid", ".", -1)).alias("idx"))


@query("f6_powers", "SELECT x, x > 0 AND (x & (x - 1)) = 0 AS pow2, (x + 511) // 512 * 512 AS up FROM (SELECT unnest(range(0, 2050, 2)) AS x)")
def f6_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 2050, 2).selectExpr("id as x", "id > 0 and (id & (id - 1)) = 0 as pow2", "(id + 511) div 512 * 512 as up")


@query("f8_bits", "SELECT grain // 32 AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST(grain % 32 AS INTEGER)) AS BIGINT) AS bits FROM bitmap GROUP BY 1")
def f8_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All marked grains packed into words of 32 bits, bit grain % 32 of word grain / 32."""
    return inv.bitmap(spark, sf_dir).groupBy(F.expr("grain div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(grain % 32 as int)))").alias("bits"))


@query("f9_offsets", "SELECT slot, 1048576 + slot * 256 AS idx_off, 8388608 + slot * 65536 AS emap_off FROM (SELECT unnest(range(0, 512)) AS slot)")
def f9_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(512).selectExpr("id as slot", "1048576 + id * 256 as idx_off", "8388608 + id * 65536 as emap_off")


@query("f11_retention", "SELECT d AS tombdays, 1718000000 - d * 86400 AS cutoff, d * 86400 // 2 AS period FROM (SELECT unnest(range(1, 31)) AS d)")
def f11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 31).selectExpr("id as tombdays", "1718000000 - id * 86400 as cutoff", "id * 86400 div 2 as period")


@query("p3_kinds", "SELECT iid, mask, count(*) FILTER ((state = 'live' AND mask & 1 > 0) OR (state = 'tomb' AND mask & 2 > 0)) AS n FROM copies, (VALUES (1), (2), (3)) m(mask) GROUP BY iid, mask")
def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each kind that a snapshot's mask takes in: 1 live, 2 tombstones."""
    by = inv.copies(spark, sf_dir).groupBy("iid").agg(F.count_if(F.col("state") == "live").alias("l"), F.count_if(F.col("state") == "tomb").alias("t"))
    return by.selectExpr("iid", "stack(3, 1, l, 2, t, 3, l + t) as (mask, n)")


# --- gates

#: Roles, files and what each role may do with them: r read, w write, - nothing.
_MATRIX = [("client", "obj", "rw"), ("client", "meta", "r"), ("client", "repl", "-"), ("client", "ctl", "-"), ("instance", "obj", "-"), ("instance", "meta", "r"), ("instance", "repl", "rw"), ("instance", "ctl", "-"), ("admin", "obj", "r"), ("admin", "meta", "r"), ("admin", "repl", "-"), ("admin", "ctl", "rw")]


def gate(role: Column, writes: Column, is_reserved: Column, down: Column, fenced: Column, reads_object: Column) -> Column:
    """Why an open is refused, in the order of the rules; null if it isn't."""
    return (
        F.when(writes & (role == "admin") & ~is_reserved, "permission denied")
        .when((role == "client") & down, "instance is down")
        .when(fenced & ~(~writes & reads_object) & ~(~writes & is_reserved & (role == "admin")), "instance is fenced")
    )


_GATE_SQL = """
  r AS (SELECT * FROM (VALUES ('client'), ('instance'), ('admin')) t(role)), b AS (SELECT * FROM (VALUES (false), (true)) t(v)),
  g AS (SELECT role, w.v AS writes, s.v AS is_reserved, d.v AS down, f.v AS fenced, o.v AS reads_object FROM r, b w, b s, b d, b f, b o)"""


@query(
    "p5_gate",
    f"""WITH {_GATE_SQL} SELECT *, CASE WHEN writes AND role = 'admin' AND NOT is_reserved THEN 'permission denied' WHEN role = 'client' AND down THEN 'instance is down'
      WHEN fenced AND NOT (NOT writes AND reads_object) AND NOT (NOT writes AND is_reserved AND role = 'admin') THEN 'instance is fenced' END AS refused FROM g""",
)
def p5_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itertools import product

    both = (False, True)
    rows = [(r, *x) for r in ("client", "instance", "admin") for x in product(both, repeat=5)]
    cases = spark.createDataFrame(rows, "role string, writes boolean, is_reserved boolean, down boolean, fenced boolean, reads_object boolean")
    return cases.withColumn("refused", gate(*[F.col(c) for c in ("role", "writes", "is_reserved", "down", "fenced", "reads_object")]))


@query("p4_role_matrix", f"SELECT role, file, contains(may, 'r') AS may_read, contains(may, 'w') AS may_write FROM (VALUES {', '.join(map(str, _MATRIX))}) t(role, file, may)")
def p4_role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_MATRIX, "role string, file string, may string")
    return rows.select("role", "file", F.contains("may", F.lit("r")).alias("may_read"), F.contains("may", F.lit("w")).alias("may_write"))


@query("p6_channel_gate", "SELECT iid, fenced OR iid = 'n3.0' AS refused FROM inst")
def p6_channel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fenced instance refuses channels; n3.0 is planted as fenced."""
    return inv.inst(spark).select("iid", (F.col("fenced") | (F.col("iid") == "n3.0")).alias("refused"))


_ATTACHES = ["role=client", "role=instance iid=n1.0 epoch=7", "role=instance iid=n1.0 epoch=6", "role=instance iid=n1.0 epoch=8", "role=instance iid=n9.0 epoch=7", "role=admin", "role=root", ""]


@query(
    "p7_attach",
    f"""WITH a AS (SELECT text, regexp_extract(text, 'role=(\\S+)', 1) AS role, regexp_extract(text, 'iid=(\\S+)', 1) AS iid, TRY_CAST(regexp_extract(text, 'epoch=(\\S+)', 1) AS BIGINT) AS e FROM (VALUES {", ".join(f"({x!r})" for x in _ATTACHES)}) t(text))
    SELECT text, CASE WHEN role NOT IN ('client', 'instance', 'admin') THEN 'bad role' WHEN role <> 'instance' THEN 'ok' WHEN e < 7 THEN 'stale epoch' WHEN e > 7 THEN 'future epoch' WHEN iid NOT IN (SELECT iid FROM inst) THEN 'not a member' ELSE 'ok' END AS verdict FROM a""",
)
def p7_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _ATTACHES], "text string").withColumn("kv", F.str_to_map("text", F.lit(" "), F.lit("=")))
    known = [x.iid for x in bounded(inv.inst(spark).select("iid"))]  # a map's members
    role = F.coalesce(F.try_element_at("kv", F.lit("role")), F.lit(""))
    epoch = F.try_element_at("kv", F.lit("epoch")).try_cast("long")
    verdict = F.when(~role.isin("client", "instance", "admin"), "bad role").when(role != "instance", "ok").when(epoch < 7, "stale epoch").when(epoch > 7, "future epoch").when(~F.try_element_at("kv", F.lit("iid")).isin(known), "not a member").otherwise("ok")
    return rows.select("text", verdict.alias("verdict"))


#: Texts of errors that clients match by their beginning; anything else is a local error.
_ERRORS = [("no such object", "absent"), ("object exists", "exists"), ("stale epoch", "stale"), ("future epoch", "future"), ("out of sequence", "sequence"), ("corrupt", "corrupt"), ("not primary", "redirect"), ("degraded", "degraded")]
_SAID = ["no such object: ord.1", "not primary: n2.0", "disk on fire", "corrupt", "stale epoch 6", "future"]


@query("p30_errors", f"WITH e AS (SELECT * FROM (VALUES {', '.join(map(str, _ERRORS))}) t(prefix, code)), s AS (SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in _SAID)}) t(said)) SELECT said, coalesce(code, 'local') AS code FROM s LEFT JOIN e ON starts_with(said, prefix)")
def p30_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lit("local")
    for prefix, name in _ERRORS:  # no text begins another
        code = F.when(F.startswith("said", F.lit(prefix)), name).otherwise(code)
    return spark.createDataFrame([(x,) for x in _SAID], "said string").select("said", code.alias("code"))


# --- replicated operations, of every copy against the winner of its object

_OPS = """
  w AS (SELECT oid, max_by(struct_pack(wepoch := wepoch, ver := ver, csum := csum), wepoch * 1000 + ver) AS x FROM (SELECT oid, wepoch, ver, max(csum) AS csum FROM copies WHERE NOT corrupt GROUP BY ALL) GROUP BY oid),
  o AS (SELECT c.iid, c.oid, c.state, c.corrupt, c.wepoch, c.ver, c.csum, w.x.wepoch AS we, w.x.ver AS v, w.x.csum AS cs FROM w JOIN copies c USING (oid))"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy, and the winning key and digest of its object that a peer offers it (we, v, cs)."""
    copies = inv.copies(spark, sf_dir)
    best = copies.where("not corrupt").groupBy("oid").agg(F.max(F.struct("wepoch", "ver", "csum")).alias("x"))
    return copies.join(best, "oid").select("iid", "oid", "state", "corrupt", "wepoch", "ver", "csum", F.col("x.wepoch").alias("we"), F.col("x.ver").alias("v"), F.col("x.csum").alias("cs"))


def greater() -> Column:
    return F.struct(F.col("we"), F.col("v")) > F.struct(F.col("wepoch").alias("we"), F.col("ver").alias("v"))


def equal() -> Column:
    return (F.col("we") == F.col("wepoch")) & (F.col("v") == F.col("ver"))


@query("p21_apply", f"WITH {_OPS} SELECT iid, oid, corrupt OR we * 1000 + v > wepoch * 1000 + ver AS applies, corrupt OR we * 1000 + v >= wepoch * 1000 + ver AS applies_forced FROM o")
def p21_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole object is taken over its copy: a greater key, no key as it is corrupt, or under force an equal one."""
    wins = F.col("corrupt") | greater()
    return offers(spark, sf_dir).select("iid", "oid", wins.alias("applies"), (wins | equal()).alias("applies_forced"))


@query("p20_sequence", f"WITH {_OPS} SELECT iid, oid, NOT corrupt AND wepoch = we AND ver = v - 1 AS in_sequence FROM o")
def p20_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a change of the winner's version applies: the copy must be at the version before, in that epoch."""
    ok = ~F.col("corrupt") & (F.col("wepoch") == F.col("we")) & (F.col("ver") == F.col("v") - 1)
    return offers(spark, sf_dir).select("iid", "oid", ok.alias("in_sequence"))


@query("p22_delete", f"WITH {_OPS} SELECT iid, oid, CASE WHEN state = 'tomb' THEN CASE WHEN we * 1000 + v > wepoch * 1000 + ver THEN 'adopt' ELSE 'keep' END WHEN corrupt OR we * 1000 + v > wepoch * 1000 + ver THEN 'delete' ELSE 'refuse' END AS action FROM o")
def p22_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("state") == "tomb", F.when(greater(), "adopt").otherwise("keep")).when(F.col("corrupt") | greater(), "delete").otherwise("refuse")
    return offers(spark, sf_dir).select("iid", "oid", action.alias("action"))


@query("p23_discard", f"WITH {_OPS} SELECT iid, oid, state = 'tomb' AND we = wepoch AND v = ver AND wepoch < 3 AS discards FROM o")
def p23_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tombstone of the very key, from an epoch before this one (3)."""
    return offers(spark, sf_dir).select("iid", "oid", ((F.col("state") == "tomb") & equal() & (F.col("wepoch") < 3)).alias("discards"))


@query("x5_result_checks", f"WITH {_OPS} SELECT iid, oid, csum = cs AS same FROM o WHERE NOT corrupt AND we = wepoch AND v = ver")
def x5_result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a change leaves has the digest it claims."""
    return offers(spark, sf_dir).where(~F.col("corrupt") & equal()).select("iid", "oid", (F.col("csum") == F.col("cs")).alias("same"))


@query("p26_epochs", "SELECT iid, oid, CASE WHEN wepoch < 2 THEN 'stale epoch' WHEN wepoch > 2 THEN 'future epoch' ELSE 'ok' END AS verdict FROM copies")
def p26_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("wepoch") < 2, "stale epoch").when(F.col("wepoch") > 2, "future epoch").otherwise("ok")
    return inv.copies(spark, sf_dir).select("iid", "oid", verdict.alias("verdict"))


@query("p25_bounds", "SELECT seq, off <= 4096 AND n <= 4096 - off AS fits FROM oplog")
def p25_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a write ends within 4096 bytes, put so that no sum can overflow."""
    return inv.oplog(spark, sf_dir).select("seq", ((F.col("off") <= 4096) & (F.col("n") <= 4096 - F.col("off"))).alias("fits"))


@query("p19_record_checks", "SELECT iid, oid, ver >= 1 AND wepoch >= 0 AND (state <> 'tomb' OR len = 0) AND length(csum) = 64 AS ok FROM copies")
def p19_record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("ver") >= 1) & (F.col("wepoch") >= 0) & ((F.col("state") != "tomb") | (F.col("len") == 0)) & (F.length("csum") == 64)
    return inv.copies(spark, sf_dir).select("iid", "oid", ok.alias("ok"))


@query("j7_presence", "SELECT d.oid, d.peer, c.oid IS NOT NULL AS present, coalesce(c.corrupt, false) AS corrupt FROM dirty d LEFT JOIN copies c ON c.oid = d.oid AND c.iid = d.peer")
def j7_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty records against the copy they speak of: absent, there, or there and corrupt are three answers."""
    own = inv.copies(spark, sf_dir).select("oid", F.col("iid").alias("peer"), F.col("corrupt").alias("c"))
    return inv.dirty(spark, sf_dir).join(own, ["oid", "peer"], "left").select("oid", "peer", F.col("c").isNotNull().alias("present"), F.coalesce("c", F.lit(False)).alias("corrupt"))


@query("x8_meta", "SELECT i.iid, o.oid, CASE WHEN c.oid IS NULL THEN 'absent' WHEN c.corrupt THEN 'corrupt' ELSE c.state || ' ' || c.wepoch || ' ' || c.ver END AS meta FROM inst i CROSS JOIN (SELECT DISTINCT oid FROM copies) o LEFT JOIN copies c USING (iid, oid)")
def x8_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each member answers when asked for each object: three forms. Members are exploded, not joined."""
    copies = inv.copies(spark, sf_dir)
    form = F.when(F.col("corrupt"), "corrupt").otherwise(F.concat_ws(" ", "state", "wepoch", "ver"))
    held = copies.groupBy("oid").agg(F.map_from_entries(F.collect_list(F.struct("iid", form.alias("f")))).alias("m"))
    members = F.array(*[F.lit(x.iid) for x in bounded(inv.inst(spark).select("iid"))])
    rows = held.select("oid", "m", F.explode(members).alias("iid"))
    return rows.select("iid", "oid", F.coalesce(F.try_element_at("m", F.col("iid")), F.lit("absent")).alias("meta"))


@query("x7_full_outcomes", f"WITH {_OPS} SELECT iid, count(*) FILTER (corrupt OR we * 1000 + v > wepoch * 1000 + ver) AS applied, count(*) FILTER (NOT corrupt AND we = wepoch AND v = ver AND csum = cs) AS current, count(*) FILTER (NOT corrupt AND we = wepoch AND v = ver AND csum <> cs) AS diverged FROM o GROUP BY iid")
def x7_full_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = ~F.col("corrupt") & equal()
    return offers(spark, sf_dir).groupBy("iid").agg(F.count_if(F.col("corrupt") | greater()).alias("applied"), F.count_if(same & (F.col("csum") == F.col("cs"))).alias("current"), F.count_if(same & (F.col("csum") != F.col("cs"))).alias("diverged"))
