"""Streams against the same rows read at once."""

import shutil

import pytest

from stowage.operators import changes, members
from stowage.sources import inventory
from stowage.streaming import inventory_streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in/events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    monkeypatch.setattr(inventory, "base", lambda s, d, name: s.readStream.schema(schema).parquet(str(tmp_path / "in")))


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_last_seen(spark, events, monkeypatch):
    got = {tuple(r) for r in run(spark, inventory_streams.last_seen_stream(inventory.pings(spark, SF)), "update", "seen").collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in members.last_seen(inventory.pings(spark, SF)).collect()}


def test_replay(spark, events, monkeypatch):
    got = run(spark, inventory_streams.replay_stream(inventory.oplog(spark, SF)), "update", "replayed").where("op <> 'delete'")
    got = {tuple(r) for r in got.collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in changes.replay(inventory.oplog(spark, SF)).collect()}


def test_demotions(spark, events, monkeypatch):
    got = run(spark, inventory_streams.demotions(inventory.pings(spark, SF), members.DEAD_MS), "append", "demoted")
    ended = {(r.iid, r.since, r.silent_ms) for r in got.where("ended").collect()}
    still = {(r.iid, r.since) for r in got.where("not ended").collect()}
    monkeypatch.undo()
    pings = inventory.pings(spark, SF)
    last = {r.iid: r.ms for r in members.last_seen(pings).selectExpr("iid", "unix_millis(cast(t as timestamp)) as ms").collect()}
    want = {tuple(r) for r in members.silences(pings, members.DEAD_MS).collect()}
    assert ended == {x for x in want if x[1] < last[x[0]]}
    # only an instance that has not come back is told of before its silence ends, once the watermark is past its timer
    end = max(last.values())
    assert still == {(i, t) for i, t in last.items() if end - t >= members.DEAD_MS}
