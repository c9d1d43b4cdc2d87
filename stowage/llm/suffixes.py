"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `THRESHOLD` bytes: at that depth a group of equal
suffixes is a repeated window. The sort goes from the most significant digit down, and a suffix that
is alone in its group is done. Digits are dealt in two rounds:

1. The first digit is a byte string of DIGIT bytes inside the window, chosen by content: the one of least
   hash (a minimiser), so equal windows choose it at the same place. Neighbouring windows share it, which
   leaves one entry for about fourteen suffixes; each chunk of documents sends its distinct digits once.
2. Where a digit occurs in two documents, the bytes around it follow. They are ordered byte by byte, to the
   right and to the left of the digit, and each of the windows around it takes the pair of its two groups. The
   contexts of a digit that occurs over HOT times would be one large group: there each window is a digit of its
   own, dealt by 128 bits of its hash.

This is a partition refinement with the digits of a suffix taken in an order of their own, first the chosen 24 bytes,
then those around them. The order of passes decides how groups are ordered, not what is in them: two suffixes are in
one group after the last pass if all 50 bytes agree, in whichever order these were looked at.

Every round is a shuffle by digit of what the chunks have, combined per chunk beforehand, and of answers
back to the chunks. A digit or window that a third of all documents share is one entry per chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import partitions, table

THRESHOLD, DIGIT = 50, 24
#: Bytes of text that are worked on together (a longer document is a chunk of its own), and chunks for each bucket of digits.
CHUNK, SHARE = 4 << 20, 2
#: Occurrences over which a digit's contexts aren't gathered in one group: 6 MB of contexts, about what a bucket holds.
HOT = 1 << 16
#: Bytes of text in a partition, at most, but for a longer document.
PARTITION = 64 << 20
#: Windows whose digits are chosen in one step.
STEP = 1 << 16
#: Stands for the id of a document that has none: larger than any other.
NO_ID = (1 << 63) - 1


def _digits(buf: np.ndarray, inside: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the digits that the windows of a buffer choose, in order, and their hashes.

    inside: whether the window that begins at a place is in one document.
    """
    n, w = len(buf) - threshold + 1, threshold - DIGIT + 1
    loads = np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), strides=(1,))
    places, hashes, before = [], [], -1
    low = np.uint64(STEP * 2 - 1)
    for s in range(0, n, STEP):
        e = min(n, s + STEP)
        x = loads[s : e + w - 1 + DIGIT - 8]
        m = len(x) - (DIGIT - 8)
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += x[8 : 8 + m]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h += x[16 : 16 + m]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        least = (h & ~low) | np.arange(m, dtype=np.uint64)
        size = 1
        cur = least
        while size * 2 <= w:
            cur = np.minimum(cur[: len(cur) - size], cur[size:])
            size *= 2
        if size < w:
            cur = np.minimum(cur[: e - s], cur[w - size : w - size + e - s])
        at = (cur & low).astype(np.int64)[inside[s:e]]
        if len(at):
            at = at[np.concatenate(([at[0] + s != before], at[1:] != at[:-1]))]
            places.append(at + s)
            hashes.append(h[at])
            before = int(places[-1][-1]) if len(at) else before
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Chunk:
    """Documents that are worked on together, in the order of their ids, and the digits of their windows."""

    def __init__(self, pdf: pd.DataFrame, threshold: int):
        rows = sorted(zip(pdf["doc_id"], [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]], strict=True))
        _release()
        self.threshold, self.side = threshold, threshold - DIGIT
        self.ids = np.array([x[0] for x in rows], np.int64)
        self.texts = [x[1] for x in rows]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)
        if len(self.buf) < threshold:
            self.places, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        else:
            long = self.sizes >= threshold
            whole = np.zeros(len(self.buf) + 1, np.int8)
            np.add.at(whole, self.starts[long], 1)
            np.add.at(whole, self.ends[long] - threshold + 1, -1)
            self.places, self.hashes = _digits(self.buf, np.cumsum(whole, dtype=np.int8).astype(bool), threshold)
        self.doc = np.searchsorted(self.ends, self.places, side="right")
        # 48 bits, mixed anew as the least hashes are all small: a false repeat is found out in the second round
        short = (self.hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
        self.short, self.of = np.unique(short, return_inverse=True)

    def split(self, values: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
        """Buckets of sorted short hashes, and which of them fall there."""
        if not len(values):
            return
        bucket = (values >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)
        order = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)]
        for s, e in zip(order, [*order[1:], len(bucket)], strict=True):
            yield int(bucket[s]), slice(int(s), int(e))

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct digit: twice its hash, and one if it is in two documents of the chunk; how often it occurs."""
        ids = self.ids[self.doc]
        least, most = np.full(len(self.short), NO_ID), np.full(len(self.short), -NO_ID - 1)
        np.minimum.at(least, self.of, ids)
        np.maximum.at(most, self.of, ids)
        return self.short << np.uint64(1) | (least < most).astype(np.uint64), np.bincount(self.of, minlength=len(self.short))

    def repeated(self, answers: pd.DataFrame, buckets: int) -> None:
        """Keep the digits that the answers of the first round call repeated, with what stands around them."""
        bits = {b: x for b, x in zip(answers["bucket"], answers["data"], strict=True)}
        flag = np.zeros((2, len(self.short)), bool)
        for b, s in self.split(self.short, buckets):
            flag[:, s] = np.unpackbits(np.frombuffer(bits[b], np.uint8).reshape(2, -1), axis=1, count=s.stop - s.start).astype(bool)
        keep = flag[0][self.of]
        self.places, self.doc, self.of = self.places[keep], self.doc[keep], self.of[keep]
        hot = flag[1][self.of]
        side, width = self.side, DIGIT + 2 * self.side
        padded = np.concatenate((np.zeros(side, np.uint8), self.buf, np.zeros(side, np.uint8)))
        self.left = np.minimum(side, self.places - self.starts[self.doc]).astype(np.uint8)
        self.right = np.minimum(side, self.ends[self.doc] - self.places - DIGIT).astype(np.uint8)
        around = np.empty((len(self.places), width + 2), np.uint8)
        if len(self.places):
            around[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[self.places]
        for edge, at in ((self.left, lambda k: side - 1 - k), (self.right, lambda k: side + DIGIT + k)):
            for k in np.flatnonzero(np.bincount(edge, minlength=side + 1)[:side]).tolist():
                rows = np.flatnonzero(edge == k)
                for i in range(k, side):
                    around[rows, at(i)] = 0
        around[:, width], around[:, width + 1] = self.left, self.right
        flat, w, seen = around.tobytes(), width + 2, {}
        self.context = np.fromiter((seen.setdefault(flat[i : i + w], len(seen)) for i in range(0, len(flat), w)), np.int64, len(self.places))
        new = np.zeros(len(seen), np.int64)
        new[self.context[::-1]] = np.arange(len(self.places))[::-1]  # first row of each, which has the least id
        cold = np.flatnonzero(~hot[new])
        order = cold[np.argsort(self.short[self.of[new[cold]]], kind="stable")]
        self.sent = new[order]
        self.rank = np.full(len(new), -1)
        self.rank[order] = np.arange(len(order))
        self.around = around
        self._windows(new, np.flatnonzero(hot[new]))

    def _windows(self, new: np.ndarray, hot: np.ndarray) -> None:
        """Hashes of the windows of contexts with a hot digit, in order, the least id of each, and which a context has."""
        side, seen, least = self.side, {}, []
        window = np.full((len(new), side + 1), -1)
        for c in hot.tolist():
            r = new[c]
            row, own = self.around[r].tobytes(), int(self.ids[self.doc[r]])
            for o in range(max(0, side - int(self.right[r])), min(side, int(self.left[r])) + 1):
                digest = hashlib.blake2b(row[side - o : side - o + self.threshold], digest_size=16).digest()
                if (k := seen.setdefault(digest, len(seen))) == len(least):
                    least.append(own)
                least[k] = min(least[k], own)
                window[c, o] = k
        order = sorted(range(len(least)), key=list(seen).__getitem__)
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), -1
        self.window = place[window]
        self.digests = np.frombuffer(b"".join(sorted(seen)), "V16") if seen else np.zeros(0, "V16")
        self.least = np.array(least, np.int64)[order]
        self.high = np.frombuffer(self.digests.tobytes(), ">u8")[::2].astype(np.uint64) >> np.uint64(16)

    def covered(self, answers: pd.DataFrame, buckets: int) -> np.ndarray:
        """Bytes in a window that a document with a lesser id has, too, by the answers of the second round."""
        masks = {b: x for b, x in zip(answers["bucket"], answers["data"], strict=True)}
        mask = np.zeros(len(self.sent), np.uint64)
        for b, s in self.split(self.short[self.of[self.sent]], buckets):
            mask[s] = np.frombuffer(zlib.decompress(masks[b]), "<u8")
        flag = np.zeros(len(self.digests), bool)
        for b, s in self.split(self.high, buckets):
            flag[s] = np.unpackbits(np.frombuffer(masks[-1 - b], np.uint8), count=s.stop - s.start).astype(bool)
        rank, ids = self.rank[self.context], self.ids[self.doc]
        cold = rank >= 0
        own = mask[rank[cold]]
        own[ids[cold] > self.ids[self.doc[self.sent]][rank[cold]]] = ~np.uint64(0)
        mask = np.zeros(len(rank), np.uint64)
        mask[cold] = own
        if len(flag):
            window = self.window[self.context[~cold]]
            hit = (window >= 0) & (flag[window] | (ids[~cold][:, None] > self.least[window]))
            mask[~cold] = np.bitwise_or.reduce(hit.astype(np.uint64) << np.arange(self.side + 1, dtype=np.uint64), axis=1)
        change = np.zeros(len(self.buf) + 1, np.int32)
        for o in range(self.side + 1):
            hit = (mask >> np.uint64(o) & np.uint64(1)).astype(bool) & (self.left >= o) & (self.right >= self.side - o)
            start = self.places[hit] - o
            change[start] += 1
            change[start + self.threshold] -= 1
        return np.cumsum(change[:-1]) > 0


def _release() -> None:
    """Give memory that is free back to the system: several workers share an executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T for x in (np.diff(values, prepend=np.uint64(0)), counts)]
    return zlib.compress(np.concatenate(planes).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(16, -1)
    steps, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _answer_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two bits for each digit that a chunk has sent: it is in two documents, and it occurs over HOT times."""
    _release()
    sent, times = zip(*[_unpack(x) for x in pdf["data"]], strict=True)
    values, which = np.unique(np.concatenate(sent) >> np.uint64(1), return_inverse=True)
    twice, hot = np.bincount(which) > 1, np.bincount(which, np.concatenate(times)) > HOT
    twice[which[(np.concatenate(sent) & np.uint64(1)).astype(bool)]] = True
    ends = np.cumsum([len(x) for x in sent])[:-1]
    bits = zip(np.split(twice[which], ends), np.split(hot[which], ends), strict=True)
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "data": [np.packbits(np.stack(b), axis=1).tobytes() for b in bits]})


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each window that a chunk has sent: a document of a lesser id has it, too."""
    sent = [zlib.decompress(x) for x in pdf["data"]]
    digests = [np.frombuffer(x, "V16", len(x) // 24) for x in sent]
    ids = np.concatenate([np.frombuffer(x, "<i8", len(x) // 24, len(x) // 24 * 16) for x in sent])
    _, which = np.unique(np.concatenate(digests), return_inverse=True)
    least = np.full(int(which.max(initial=-1)) + 1, NO_ID)
    np.minimum.at(least, which, ids)
    bits = np.split(least[which] < ids, np.cumsum([len(x) for x in digests])[:-1])
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "data": [np.packbits(b).tobytes() for b in bits]})


def order_contexts(around: np.ndarray, least: np.ndarray, side: int) -> np.ndarray:
    """For distinct contexts, a mask of the windows that a context of a lesser id has as well.

    Bit o stands for the window that begins o bytes before the digit. Groups are refined by one byte at a
    time, from the digit outwards; a window's group is the pair of its groups to the left and to the right.
    """
    mask = np.zeros(len(around), np.uint64)
    center = np.ascontiguousarray(around[:, side : side + DIGIT]).view(f"V{DIGIT}").ravel()
    seen: dict[bytes, int] = {}
    group = np.fromiter((seen.setdefault(x, len(seen)) for x in center.tolist()), np.int64, len(center))
    some = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
    if not len(some):
        return mask
    around, least, group = around[some], least[some], group[some]
    left, right = around[:, -2].astype(np.int64), around[:, -1].astype(np.int64)

    def refine(steps: Iterator[int]) -> list[np.ndarray]:
        ranks = [group]
        for at in steps:
            ranks.append(np.unique(ranks[-1] * 256 + around[:, at], return_inverse=True)[1])
        return ranks

    to_left, to_right = refine(range(side - 1, -1, -1)), refine(range(side + DIGIT, 2 * side + DIGIT))
    out = np.zeros(len(some), np.uint64)
    for o in range(side + 1):
        fits = np.flatnonzero((left >= o) & (right >= side - o))
        if not len(fits):
            continue
        _, window = np.unique(to_left[o][fits] * (len(some) + 1) + to_right[side - o][fits], return_inverse=True)
        first = np.full(window.max() + 1, NO_ID)
        np.minimum.at(first, window, least[fits])
        out[fits] |= (first[window] < least[fits]).astype(np.uint64) << np.uint64(o)
    mask[some] = out
    return mask


def _answer_second(threshold: int):
    side = threshold - DIGIT
    width = DIGIT + 2 * side + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Buckets of windows have negative numbers."""
        _release()
        if pdf["bucket"].iloc[0] < 0:
            return _answer_windows(pdf)
        flat, ids, sizes = [], [], []
        for data in pdf["data"]:
            raw = zlib.decompress(data)
            n = len(raw) // (width + 8)
            flat.append(raw[: n * width])
            ids.append(np.frombuffer(raw, "<i8", n, n * width))
            sizes.append(n)
        text, ids = b"".join(flat), np.concatenate(ids)
        seen: dict[bytes, int] = {}
        of = np.fromiter((seen.setdefault(text[i : i + width], len(seen)) for i in range(0, len(text), width)), np.int64, len(ids))
        least = np.full(len(seen), NO_ID)
        np.minimum.at(least, of, ids)
        around = np.frombuffer(b"".join(seen), np.uint8).reshape(-1, width)
        mask = order_contexts(around, least, side)[of]
        mask[ids > least[of]] = ~np.uint64(0)
        parts = np.split(mask, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "data": [zlib.compress(m.astype("<u8").tobytes(), 1) for m in parts]})

    return run


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, kept_sha256) per row: spans of bytes that are removed, and the rest.

    A byte is removed if a string of `threshold` bytes that covers it also starts in a document with a
    lesser doc_id, judged on the input; overlaps count and strings never cross documents. A null text is an
    empty one. A row without a doc_id counts as having the largest; rows of one doc_id don't remove each
    other's bytes. texts: give the rest itself, else null. What is kept may cut a character of several bytes.
    No documents give no rows; columns beside doc_id and text are not read.
    """
    if not DIGIT < threshold <= DIGIT + 63:
        raise ValueError(f"threshold must be from {DIGIT + 1} to {DIGIT + 63}")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK))
    buckets = -(-chunks // SHARE)
    parts = min(chunks, max(partitions(spark), -(-total // PARTITION)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).repartition(parts, "chunk")
    sent = "chunk int, bucket int, data binary"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(pdf, threshold)
        values, times = chunk.first()
        found = [(int(pdf["chunk"].iloc[0]), b, _pack(values[s], times[s])) for b, s in chunk.split(chunk.short, buckets)]
        return pd.DataFrame(found, columns=["chunk", "bucket", "data"])

    def second(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(answers):
            return pd.DataFrame({"chunk": [], "bucket": [], "data": []})
        chunk = Chunk(pdf, threshold)
        chunk.repeated(answers, buckets)
        at, found = chunk.sent, []
        for b, s in chunk.split(chunk.short[chunk.of[at]], buckets):
            ids = chunk.ids[chunk.doc[at[s]]].astype("<i8")
            found.append((int(pdf["chunk"].iloc[0]), b, zlib.compress(chunk.around[at[s]].tobytes() + ids.tobytes(), 1)))
        for b, s in chunk.split(chunk.high, buckets):
            found.append((int(pdf["chunk"].iloc[0]), -1 - b, zlib.compress(chunk.digests[s].tobytes() + chunk.least[s].astype("<i8").tobytes(), 1)))
        return pd.DataFrame(found, columns=["chunk", "bucket", "data"])

    def third(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "begins", "ends", "kept", "kept_sha256")})
        chunk = Chunk(pdf, threshold)
        cover = np.zeros(len(chunk.buf), bool)
        if len(answers):
            chunk.repeated(answers[answers["round"] == 1], buckets)
            cover = chunk.covered(answers[answers["round"] == 2], buckets)
        out = []
        for i, text in enumerate(chunk.texts):
            own = cover[chunk.starts[i] : chunk.ends[i]]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if len(edge) else text
            out.append((chunk.ids[i], len(text), edge[::2].tolist(), edge[1::2].tolist(), kept if texts else None, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "begins", "ends", "kept", "kept_sha256"])

    digits = rows.groupBy("chunk").applyInPandas(first, sent)
    bits = digits.groupBy("bucket").applyInPandas(_answer_first, sent)
    around = rows.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInPandas(second, sent)
    masks = around.groupBy("bucket").applyInPandas(_answer_second(threshold), sent)
    answers = bits.withColumn("round", F.lit(1)).union(masks.withColumn("round", F.lit(2)))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(third, "doc_id long, n_bytes long, begins array<int>, ends array<int>, kept binary, kept_sha256 string")
    out = out.withColumn("spans", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")))
    return out.select(F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", "spans", "kept", "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to those of lesser ids; null, empty and very long texts and repeated ids are as in remove_repeats()."""
    got = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Whole texts as bytes: windows that also start in a document of a lesser id, the runs that they cover, and what is left.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(encode(coalesce(text, '')) AS BLOB) AS b FROM documents),
  n AS (SELECT r, doc_id, b, octet_length(b) AS n FROM d),
  w AS (SELECT r, doc_id, p, b[p + 1:p + {THRESHOLD}] AS s FROM n, LATERAL (SELECT unnest(range(0, n - {THRESHOLD - 1})) AS p) x),
  f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
  h AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w JOIN f USING (s) WHERE least < doc_id),
  g AS (SELECT r, p, sum(CASE WHEN p <= before + {THRESHOLD} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM h),
  spans AS (SELECT r, min(p) AS a, max(p) + {THRESHOLD} AS z FROM g GROUP BY r, run),
  edges AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM spans),
  kept AS (SELECT e.r, e.a, hex(n.b[e.since + 1:e.a]) AS x FROM edges e JOIN n USING (r)
           UNION ALL SELECT n.r, n.n + 1, hex(n.b[coalesce(t.z, 0) + 1:n.n]) FROM n LEFT JOIN (SELECT r, max(z) AS z FROM spans GROUP BY r) t USING (r)),
  rest AS (SELECT r, sha256(unhex(string_agg(x, '' ORDER BY a))) AS kept_sha256 FROM kept GROUP BY r),
  lost AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM n JOIN rest USING (r) LEFT JOIN lost USING (r)"""
