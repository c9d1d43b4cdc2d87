"""Where queries are registered, and the SQL of the derived tables that their oracles stand on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_IID = "CASE {0} % 5 WHEN 0 THEN 'n1.0' WHEN 1 THEN 'n1.1' WHEN 2 THEN 'n2.0' WHEN 3 THEN 'n3.0' ELSE 'n3.2' END"

#: Derived tables in DuckDB's SQL; stowage.sources.inventory builds the same rows with DataFrame functions.
TABLES = {
    "copies_raw": f"""
      SELECT iid, oid, state, CASE WHEN state = 'tomb' THEN CAST(0 AS BIGINT) ELSE 1024 * (1 + k % 16) END AS len, ver, wepoch,
             CASE WHEN state = 'tomb' THEN sha256('') ELSE sha256(oid || ':' || wepoch || ':' || ver || ':' || inj) END AS csum,
             corrupt, 1717000000 + 86400 * (k % 11) AS mtime
      FROM (SELECT {_IID.format("l_suppkey")} AS iid, 'ord.' || l_orderkey AS oid, 1 + l_partkey % 4 AS ver,
                   CAST(1 + l_linenumber % 3 AS BIGINT) AS wepoch,
                   CASE WHEN (l_orderkey + l_linenumber % 3 + l_partkey % 4) % 4 = 0 THEN 'tomb' ELSE 'live' END AS state,
                   l_orderkey + l_linenumber % 3 + l_partkey % 4 AS k,
                   CASE WHEN l_suppkey % 50 = 7 THEN 'x' ELSE '' END AS inj, l_suppkey % 17 = 0 AS corrupt FROM lineitem)""",
    "copies": """
      SELECT iid, oid, state, len, ver, wepoch, csum, corrupt, mtime FROM (
        SELECT *, row_number() OVER (PARTITION BY iid, oid ORDER BY wepoch DESC, ver DESC, csum DESC, state DESC, len DESC, corrupt DESC) AS rn
        FROM copies_raw) WHERE rn = 1""",
    "dirty": f"SELECT 'ord.' || o_orderkey AS oid, {_IID.format('o_custkey')} AS peer, 1 + o_custkey % 7 AS epoch FROM orders WHERE o_orderkey % 3 = 0",
    "oplog": """
      SELECT event_id AS seq, 'usr.' || user_id AS oid,
             CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'trunc' WHEN 'error' THEN 'delete' ELSE 'verify' END AS op,
             (event_id % 8) * 1024 AS off, CAST(1024 AS BIGINT) AS n, ts FROM events""",
    "pings": f"""
      SELECT {_IID.format("user_id")} AS iid, ts, CASE WHEN event_type IN ('view', 'click') THEN 'instance' ELSE 'reader' END AS role,
             CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS bytes_read FROM events""",
    "inst": """
      SELECT * FROM (VALUES ('n1.0','n1',0,'in','yes',false,7), ('n1.1','n1',1,'in','no',false,7), ('n2.0','n2',0,'in','yes',false,7),
        ('n3.0','n3',0,'in','heal',false,7), ('n3.2','n3',2,'out','yes',false,7)) t(iid, node, idx, status, up, fenced, since)""",
    "inst_prev": """
      SELECT * FROM (VALUES ('n1.0','n1',0,'in','yes',false,6), ('n1.1','n1',1,'in','yes',false,6), ('n2.0','n2',0,'in','yes',false,6),
        ('n3.0','n3',0,'in','yes',false,6), ('n3.2','n3',2,'in','yes',false,6)) t(iid, node, idx, status, up, fenced, since)""",
    "stale": "SELECT * FROM (VALUES ('n2.0','n1.1',5), ('n3.0','n2.0',6)) t(subject, reporter, since)",
    "doc_oids": "SELECT DISTINCT 'doc.' || doc_id AS oid FROM documents",
    "objects": "SELECT 'doc.' || doc_id AS oid, text, octet_length(encode(text)) AS len FROM documents",
    "extents": """
      SELECT l_orderkey AS k, 'ord.' || l_orderkey AS oid, blk,
             CASE WHEN l_orderkey % 1499 = 5 AND blk = 0 THEN (l_orderkey - 1) * 8 + 1 ELSE l_orderkey * 8 + blk + 1 END AS grain
      FROM (SELECT DISTINCT l_orderkey, unnest(range(0, 1 + l_orderkey % 4)) AS blk FROM lineitem)""",
    "bitmap": """
      SELECT DISTINCT grain FROM (
        SELECT k * 8 + b + 1 AS grain FROM (SELECT DISTINCT l_orderkey AS k, unnest(range(0, 1 + l_orderkey % 4)) AS b FROM lineitem) WHERE NOT (k % 997 = 3 AND b = 0)
        UNION ALL SELECT l_orderkey * 8 + 7 FROM lineitem WHERE l_orderkey % 1009 = 1
        UNION ALL SELECT 0)""",
}


def with_tables(sql: str) -> str:
    """The SQL with the derived tables that it names, and those that these name, in front."""
    needed: list[str] = []

    def want(text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                want(TABLES[name])
                if name not in needed:
                    needed.append(name)

    want(sql)
    if not needed:
        return sql
    front = ", ".join(f"{n} AS ({TABLES[n]})" for n in needed)
    body = sql.strip()
    return f"WITH {front}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {front} {body}"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for its rows if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(sql)
        return f

    return add
