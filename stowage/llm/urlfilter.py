"""Dated URL lists, turned into validity intervals and joined with captures as of the time they were fetched.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.common import table

#: Seconds of a slot of time, in which captures and intervals meet; parts that each key is dealt out in, as one host may have most captures.
SLOT, SALT = 32 * 86400, 16


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dots; null if there is none."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Segments of the path of an absolute URL that are not empty."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_keys(url: Column, segments: int) -> Column:
    """What list entries can name of a URL: its host and the domains above it, and its host with the first path segments."""
    return F.when(host_of(url).isNotNull(), F.concat(_domains(F.split(host_of(url), r"\.")), _prefixes(host_of(url), path_of(url), segments))).otherwise(F.array().cast("array<string>"))


def _domains(labels: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _prefixes(host: Column, path: Column, segments: int) -> Column:
    some = F.slice(path, 1, segments) if segments else F.slice(path, 1, 0)
    return F.transform(some, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i + 1), "/")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) of dated entries (list, key, dated, action), action `add` or `remove`.

    An interval opens with an add and ends before the next entry of that list and key; a last one stays open
    (valid_to null). Of entries with one date a remove holds. Entries with a null, or another action, are no
    entries. Keys are hosts or domains, or these with a path, and are compared in lower case up to the path.
    """
    good = entries.where("list is not null and key is not null and dated is not null and action in ('add', 'remove')")
    key = F.concat(F.lower(F.substring_index("key", "/", 1)), F.when(F.instr("key", "/") > 0, F.regexp_replace(F.expr("substring(key, instr(key, '/'))"), "/+$", "")).otherwise(""))
    day = good.groupBy("list", key.alias("key"), F.col("dated").cast("timestamp_ntz").alias("valid_from")).agg(F.max("action").alias("action"))
    to = F.lead("valid_from").over(Window.partitionBy("list", "key").orderBy("valid_from"))
    return day.withColumn("valid_to", to).where("action = 'add'").select("list", "key", "valid_from", "valid_to")


def _second(at: Column | str) -> Column:
    return F.unix_seconds(F.col(at).cast("timestamp") if isinstance(at, str) else at.cast("timestamp"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, blocked, matches) per row of captures (page_id, url, fetched).

    matches lists, in order, what was active when the page was fetched: list, key and valid_from. A URL
    without a host, or null, and a capture without a time match nothing and are not blocked. Repeated rows get
    a row each; columns beside the three are not read. Without entries nothing is blocked.
    """
    valid = intervals(entries)
    # number of path segments that any entry has: longer prefixes can't be named
    segments = valid.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("fetched").cast("timestamp_ntz"))
    ends = rows.agg(F.min("fetched").alias("least"), F.max("fetched").alias("most"))
    # intervals are filed in every slot of time that they share with the captures
    inside = valid.join(F.broadcast(ends)).where("least is not null and valid_from <= most and (valid_to is null or valid_to > least)")
    first = F.floor(_second(F.greatest("valid_from", "least")) / SLOT)
    last = F.floor(_second(F.least(F.coalesce("valid_to", "most"), F.col("most"))) / SLOT)
    filed = inside.select("list", "key", "valid_from", "valid_to", F.explode(F.sequence(first, last)).alias("slot"), F.sequence(F.lit(0), F.lit(SALT - 1)).alias("salts"))
    filed = filed.select("list", "key", "valid_from", "valid_to", "slot", F.explode("salts").alias("salt"))

    # equal captures are judged once; that also takes the weight off a host that has most of them
    different = rows.groupBy("url", "fetched").agg(F.count("*").alias("n")).where("fetched is not null and url is not null")
    asked = different.select("url", "fetched", F.floor(_second("fetched") / SLOT).alias("slot"), F.pmod(F.xxhash64("url", "fetched"), F.lit(SALT)).cast("int").alias("salt"), F.explode(F.array_distinct(url_keys(F.col("url"), segments))).alias("key"))
    met = asked.join(filed, ["key", "slot", "salt"]).where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    found = met.groupBy("url", "fetched").agg(F.array_sort(F.collect_list(F.struct("list", "key", "valid_from"))).alias("matches"))
    out = rows.join(found, ["url", "fetched"], "left")
    none = F.array().cast("array<struct<list:string,key:string,valid_from:timestamp_ntz>>")
    return out.select("page_id", "url", "fetched", F.col("matches").isNotNull().alias("blocked"), F.coalesce("matches", none).alias("matches"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Entries for tests and queries: dated by rule from the hosts that a table of pages has.

    Hosts of a length divisible by 3 are spam from 1 January 2024 plus 7 x length mod 60 days, for 30 days, and
    again 15 days later. Domains example.net and example.org are adult from 1 February to 1 April, and path
    /fr of each host with an `m.` in front is spam from 10 January on.
    """
    host = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("host") * 7 % 60).cast("int"))
    odd = host.where(F.length("host") % 3 == 0)
    entry = lambda df, name, key, day, action: df.select(F.lit(name).alias("list"), key.alias("key"), day.cast("timestamp_ntz").alias("dated"), F.lit(action).alias("action"))
    day = lambda x: F.lit(x).cast("date")
    found = [entry(odd, "spam", F.col("host"), F.date_add(start, n), action) for n, action in ((0, "add"), (30, "remove"), (45, "add"))]
    found.append(entry(host.where(F.startswith("host", F.lit("m."))), "spam", F.concat("host", F.lit("/fr")), day("2024-01-10"), "add"))
    domains = pages.sparkSession.createDataFrame([("example.net",), ("example.org",)], "host string")
    found += [entry(domains, "adult", F.col("host"), day("2024-02-01"), "add"), entry(domains, "adult", F.col("host"), day("2024-04-01"), "remove")]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as captured on 1 January 2024 plus page_id mod 120 days, against dated_lists()."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 120).cast("int")).cast("timestamp_ntz")
    got = evaluate(pages.select("page_id", "url", fetched.alias("fetched")), dated_lists(pages.select("url")))
    names = F.array_join(F.array_distinct(F.transform("matches", lambda m: F.concat(m["list"], F.lit(":"), m["key"]))), ",")
    return got.select("page_id", "url", "fetched", "blocked", F.size("matches").cast("long").alias("n_matches"), names.alias("matched"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 120 AS INTEGER) AS TIMESTAMP) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)), '\.+$', ''), '') AS host,
         list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS path
  FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
s AS (SELECT host, DATE '2024-01-01' + CAST(length(host) * 7 % 60 AS INTEGER) AS d FROM h WHERE length(host) % 3 = 0),
v AS (
  SELECT 'spam' AS list, host AS key, d AS a, d + 30 AS b FROM s
  UNION ALL SELECT 'spam', host, d + 45, NULL FROM s
  UNION ALL SELECT 'spam', host || '/fr', DATE '2024-01-10', NULL FROM h WHERE starts_with(host, 'm.')
  UNION ALL SELECT 'adult', x, DATE '2024-02-01', DATE '2024-04-01' FROM (VALUES ('example.net'), ('example.org')) t(x)),
m AS (
  SELECT p.page_id, p.url, p.fetched, v.list || ':' || v.key AS name
  FROM p JOIN v ON (p.host = v.key OR ends_with(p.host, '.' || v.key) OR v.key = p.host || '/' || p.path[1])
   AND p.fetched >= v.a AND (v.b IS NULL OR p.fetched < v.b)),
g AS (SELECT page_id, url, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM m GROUP BY page_id, url)
SELECT p.page_id, p.url, p.fetched, g.n IS NOT NULL AS blocked, coalesce(g.n, 0) AS n_matches, coalesce(g.names, '') AS matched
FROM p LEFT JOIN g ON p.page_id = g.page_id AND p.url IS NOT DISTINCT FROM g.url
"""
