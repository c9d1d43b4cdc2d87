"""Near-duplicate documents by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import cut, fresh, partitions, table
from stowage.llm.components import connected_components

#: Fingerprints of one bucket that are compared in one piece; larger buckets go in pairs of blocks.
BLOCK = 1024


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: lower-case A-Z, words between ASCII white space, word shingles.

    A bit is set if over half the shingles' XXH64 have it. Fewer than `width` words make one shingle;
    null, empty and blank texts give 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.array([digest(flat[s:e], seed) for s, e in spans], "<u8")
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row, fp): fp holds the 64 bits as a signed long, row a hash of the text. One row per input row, whatever its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps)], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row long, fp long")


def covering_masks(radius: int, run: int = 1) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits: any two words that differ in at most `radius` bits agree on one of them.

    Bit i has a vector m(i) over GF(2) with radius+1 components; mask v keeps the bits whose m(i) is not
    orthogonal to v. `radius` equations leave a non-zero v that is orthogonal to m(i) of every differing bit.
    run: neighbouring bits that have one vector; masks of another run cut the bits otherwise.
    """
    n = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(64) if ((1 + i // run % n) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(x: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what is within the radius in x; one less than the members of each component."""
    rest, a, b = x, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                a += [int(at)] * len(found)
                b += found.tolist()
                front += list(found)
                rest = rest[~near]
    return a, b


def _bucket_links(radius: int):
    """For mapInArrow over rows (t, key, pair, fp) that are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["t", "key", "pair", "fp"]

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
            fp = rows[3]
            twos = starts[sizes == 2]
            near = twos[np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= radius]
            a, b = fp[near].tolist(), fp[near + 1].tolist()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _forest(fp[s : s + n].view(np.uint64), radius)
                a += np.array(x, np.uint64).view(np.int64).tolist()
                b += np.array(y, np.uint64).view(np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in names])
            if held is not None:
                rows = np.concatenate((held, rows), axis=1)
            if not rows.shape[1]:
                continue
            last = (rows[:3] == rows[:3, -1:]).all(axis=0)
            first = int(np.argmax(last))
            held = rows[:, first:]
            if first:
                yield links(rows[:, :first])
        if held is not None and held.shape[1]:
            yield links(held)

    return run


def _buckets(rows: DataFrame, keys: list[str], masks: list[int], name: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Columns of a bucket, rows (*keys, fp) filed once for each mask, and the buckets with several fingerprints, with their number n."""
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    filed = rows.select(*keys, "fp", F.explode(tables).alias("x")).select(*keys, F.col("x.t").alias(f"t{name}"), F.col("x.key").alias(f"key{name}"), "fp")
    own = [*keys, f"t{name}", f"key{name}"]
    return own, filed, cut(filed.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1"))


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius.

    Complete: every pair within the radius shares a bucket of some mask. A bucket of over `block`
    fingerprints is filed anew by masks that cut the bits left free by the first ones, where every pair within the
    radius meets again. The two masks leave so few bits free that a bucket holds a bounded number of different
    fingerprints, whatever the input; if that is over `block`, pairs of blocks are compared apart. No task holds more
    than two blocks, and each comparison returns a spanning forest and not all pairs.
    """
    spark, none = fps.sparkSession, F.lit(0).cast("long")
    keys, filed, sizes = _buckets(fps.select("fp"), [], covering_masks(radius), "")
    large = sizes.where(F.col("n") > block)
    rows = filed.join(sizes.where(F.col("n") <= block), keys).select(*keys, none.alias("t2"), none.alias("key2"), "n", "fp")
    if not large.isEmpty():
        again, refiled, sizes = _buckets(filed.join(large, keys).select(*keys, "fp"), keys, covering_masks(radius, 4), "2")
        rows = rows.union(refiled.join(sizes, again).select(*again, "n", "fp"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("t", "key", F.xxhash64("t2", "key2", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "fp")
    rows = rows.repartition(partitions(spark), "t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return rows.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, row, fp, component_id, root) per row of docs; component_id is the least doc_id that links lead to.

    root names the component itself: where a doc_id is repeated, two components can have one least doc_id.

    Fingerprints link at `radius` or fewer differing bits; equal ones are one node, so copies cost no
    links. Rows without a doc_id count as documents but never name a component (null if no member has
    an id); a repeated doc_id gives a row each. Texts that are null or blank have fingerprint 0 and link
    like any other. No documents give no rows. Very long texts are
    fingerprinted whole. Columns beside doc_id and text are not looked at.
    """
    fps = cut(fingerprints(docs, width))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "row", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The documents of which each group of near duplicates keeps the one with the least doc_id, with all their columns.

    Of several rows of a group with that id one stays. Where no member has an id, one row of each fingerprint stays.
    """
    groups = cut(near_duplicates(docs, radius, width))
    best = groups.where("doc_id <=> component_id").groupBy("doc_id", "root", "fp").agg(F.min("row").alias("row"))
    named = best.where("doc_id is not null").groupBy("doc_id", "root").agg(F.min("row").alias("row"))
    keep = named.select("doc_id", "row").union(best.where("doc_id is null").select("doc_id", "row"))
    key, row, text = fresh("key"), fresh("row"), fresh("text")
    keep = keep.select(F.col("doc_id").alias(key), F.col("row").alias(row))
    twice = groups.groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias(key), F.col("row").alias(row))

    def among(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return df.join(rows, df["doc_id"].eqNullSafe(rows[key]) & (F.xxhash64(df["text"]) == rows[row]), how)

    if twice.isEmpty():
        return among(docs, keep, "left_semi")
    kept = among(docs, keep, "left_semi").withColumn(text, F.xxhash64("text"))
    again = among(kept, twice, "left_semi").dropDuplicates(["doc_id", text])
    return among(kept, twice, "left_anti").union(again).drop(text)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null, blank and very long texts and repeated ids are as in near_duplicates()."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
