"""Placement and digests against known answers, which were computed with hashlib alone."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.functions.digest import NODE, score
from stowage.operators import audit, placement
from stowage.sources import inventory

#: Objects, the score of node n2, and the placement of three replicas over inventory.inst_prev().
VECTORS = {
    "alpha": ("f140ceae475fdd5c", ["n2.0", "n1.1", "n3.0"]),
    "beta": ("aecc88689b95729a", ["n2.0", "n3.0", "n1.0"]),
    "gamma": ("f5908195fb5bc19c", ["n2.0", "n1.1", "n3.2"]),
    "delta": ("3682b583a3c6da93", ["n3.0", "n1.1", "n2.0"]),
    "epsilon": ("de2ee72436c0a329", ["n2.0", "n1.0", "n3.2"]),
    "zeta": ("7c8a754f32037efa", ["n1.1", "n3.0", "n2.0"]),
}
#: Block size, length and checksum of content whose byte i is (37 i + 11) mod 256.
CHECKSUMS = [
    (64, 0, "69217a3079908094e11121d042354a7c1f55b6482ca1a51e1b250dfd1ed0eef9"),
    (64, 1, "801d1900064542dc3489a32ea7325fe9156759d5805a2537e265d933f5877bdc"),
    (64, 64, "fe2d19042e7a49f9162880f3717289b99c06fca62e5d4a511d932148773b60f6"),
    (64, 65, "2d114776ebea2fce47617501bf552fb56cf3de3921e0ed00caeb577a39edbb45"),
    (64, 199, "56de5a1f458c4c8c00a7a45c26b099bf03ad88acb107e9e07413d3718b27bfe4"),
    (65536, 2 * 65536 + 1234, "2b03f34254f29e65d28dcd03b79511d15d42dd440cec48d69c568d5f1b952aba"),
]


@pytest.mark.parametrize("replicas", [1, 2, 3, 5])
def test_placement(spark, replicas):
    objects = spark.createDataFrame([(x,) for x in VECTORS], "oid string")
    got = {r.oid: r.placement for r in placement.place(objects, inventory.inst_prev(spark), replicas).collect()}
    assert got == {k: v[1][:replicas] for k, v in VECTORS.items()}


def test_score(spark):
    objects = spark.createDataFrame([(x,) for x in VECTORS], "oid string")
    got = {r.oid: r.s for r in objects.select("oid", score(F.col("oid"), NODE, F.lit("n2")).alias("s")).collect()}
    assert got == {k: v[0] for k, v in VECTORS.items()}


def test_no_members(spark):
    objects = spark.createDataFrame([("a",)], "oid string")
    assert placement.place(objects, inventory.inst_prev(spark).where("false"), 2).first().placement == []


@pytest.mark.parametrize(("size", "length", "want"), CHECKSUMS)
def test_checksums(spark, size, length, want):
    content = bytes((i * 37 + 11) % 256 for i in range(length))
    objects = spark.createDataFrame([("a", bytearray(content))], "oid string, content binary")
    assert audit.checksums(objects, size).first().csum == want


def test_a_flipped_byte(spark):
    content = bytearray((i * 37 + 11) % 256 for i in range(199))
    content[70] ^= 0x5A
    objects = spark.createDataFrame([("a", content)], "oid string, content binary")
    digests = b"".join(hashlib.blake2s(content[k : k + 64], digest_size=16).digest() for k in range(0, 199, 64))
    assert audit.checksums(objects, 64).first().csum == hashlib.blake2s(digests).hexdigest()


def test_a_map_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(placement, "MEMBERS", 4)
    with pytest.raises(ValueError, match="at most 4"):
        placement.placement(inventory.inst_prev(spark), F.col("oid"), 2)
