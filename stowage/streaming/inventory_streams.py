"""Streaming forms: last-seen times and demotions, and the replay of a change log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_seen_stream(pings: DataFrame) -> DataFrame:
    """(iid, t) over a stream of pings: an upsert, to be written in update mode."""
    return pings.where("role = 'instance' and bytes_read > 0").groupBy("iid").agg(F.max("ts").alias("t"))


def replay_stream(log: DataFrame) -> DataFrame:
    """(oid, seq, op, off): the last change of each object so far, in update mode; deletes are listed as such."""
    last = log.where("op <> 'verify'").groupBy("oid").agg(F.max(F.struct("seq", "op", "off")).alias("x"))
    return last.select("oid", "x.seq", "x.op", "x.off")


def demotions(pings: DataFrame, dead_ms: int, late: str = "0 seconds") -> DataFrame:
    """(iid, since, silent_ms, ended) for silences of at least dead_ms, in event time.

    A timer tells of a silence as soon as the watermark is dead_ms past an instance's last ping (ended false, silent_ms so
    far), so that an instance which never comes back is told of, too; when it comes back, the whole silence follows
    (ended true). State is one timestamp for each instance. Pings later than `late` are left out by the watermark.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        found, now = [], state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            found.append((key[0], last, now - last, False))
            told = True
        for t in sorted(t for b in batches for t in b["ms"].tolist()):
            if last is not None and t - last >= dead_ms:
                found.append((key[0], last, t - last, True))
            if last is None or t > last:
                last, told = t, False
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(max(last + dead_ms, now + 1))
        yield pd.DataFrame(found, columns=["iid", "since", "silent_ms", "ended"])

    rows = pings.where("role = 'instance' and bytes_read > 0").select("iid", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("iid").applyInPandasWithState(run, "iid string, since long, silent_ms long, ended boolean", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
