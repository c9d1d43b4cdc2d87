"""Approximate nearest neighbours by inverted lists of product-quantised residuals, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut, ship, table

#: Vectors the index is fitted on; every vector is indexed.
SAMPLE = 20_000
#: Lists are LISTS times the root of the number of vectors, at most MOST_LISTS; parts of a code; code words of a part.
LISTS, MOST_LISTS, PARTS, WORDS = 2.0, 4096, 16, 256
#: A query looks into so many lists that this share of the sample's neighbours is in them, and that these hold
#: so many candidates at least. Sample queries, and rows of the sample, that the number is measured on.
SHARE, LEAST_CANDIDATES, TRIED, AMONG = 0.97, 2000, 256, 20_000
#: Best codes of a bin that are reranked, for each neighbour asked for; with them go all whose approximate score
#: is below the last by less than the usual error of a code, so that a dense group is told apart exactly.
RERANK = 4
#: Vectors, and queries, that are compared in one piece; longer lists go in several.
BLOCK, QUERIES = 4096, 2048


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 8192] @ centres.T - half, axis=1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres; fewer if x has fewer different rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds if len(distinct) > k else 0):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[found] = sums / np.diff(np.concatenate((first, [len(x)])))[:, None]
        if lost := len(centres) - len(found):  # centres without a member start anew
            centres[np.setdiff1d(np.arange(len(centres)), found)] = x[rng.integers(0, len(x), lost)]
    return centres


class Index:
    """Coarse centres and, for each part of a residual, code words; all vectors have one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS):
        self.centres = k_means(sample, lists)
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.words = [k_means(rest[:, c], words) for c in self.cuts]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([_nearest(rest[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)

    def decode(self, at: int, codes: np.ndarray) -> np.ndarray:
        out = np.repeat(self.centres[at][None, :], len(codes), axis=0)
        for k, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out[:, c] += w[codes[:, k]]
        return out

    def enough(self, sample: np.ndarray, k: int, share: float = SHARE) -> int:
        """Lists that hold a share of the k nearest of the sample's own vectors."""
        q, x = sample[:TRIED], sample[:AMONG]
        at, ranks = _nearest(x, self.centres), []
        for i, v in enumerate(q):
            score = x @ v
            score[i] = -np.inf
            top = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
            place = np.empty(len(self.centres), np.int64)
            place[np.argsort(-(self.centres @ v), kind="stable")] = np.arange(len(self.centres))
            ranks.append(place[at[top]])
        found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
        return int(found[min(len(found) - 1, int(share * len(found)))]) + 1 if len(found) else 1

    def probes(self, q: np.ndarray, sizes: np.ndarray, probes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of q and list, for the lists each query looks into."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        row, rank = np.nonzero(((np.arange(order.shape[1]) < probes) | (before < least)) & (sizes[order] > 0))
        return row, order[row, rank]

    def approximate(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors of one list, from a table of queries x code words for each part."""
        out = np.repeat((q @ self.centres[at])[:, None], len(codes), axis=1)
        for k, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += (q[:, c] @ w.T)[:, codes[:, k]]
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is not null, empty or zero and has only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & good)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def bins(sizes: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First bin of each list and how many it has: small lists share a bin, long ones are split over several."""
    first, count, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, most
    for i, n in enumerate(sizes.tolist()):
        if n > room and room < most:
            at, room = at + 1, most
        first[i], count[i] = at, max(1, -(-n // most))
        if n > most:
            at, room = at + count[i], most
        else:
            room -= n
    return first, count


def _search(rows: DataFrame, queries, k: int, index: Index, sizes: np.ndarray, probes: int) -> DataFrame:
    """Best k of each query in each bin it looks into. rows: (vec_id, v, list, code)."""
    held, (first, count) = ship(rows.sparkSession, index), bins(sizes)
    wanted = -(-rows.where(queries).count() // QUERIES)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, wanted))).cast("int")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = part["list"].to_numpy()
            yield part.assign(bin=(first[at] + part.pop("spread").to_numpy() % count[at]).astype(np.int32))

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held()
        for part in parts:
            for s in range(0, len(part), 256):
                some = part.iloc[s : s + 256]
                row, at = index.probes(_matrix(some["v"]), sizes, probes, LEAST_CANDIDATES)
                n = count[at]
                row, lists = np.repeat(row, n), np.repeat(at, n)
                bin_ = np.repeat(first[at], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((lists, bin_, row))
                row, lists, bin_ = row[order], lists[order].astype(np.int32), bin_[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1]))))[: len(row)]
                yield pd.DataFrame({"query_id": some["vec_id"].to_numpy()[row[new]], "q": some["v"].to_numpy()[row[new]], "lists": np.split(lists, new[1:]), "bin": bin_[new], "qb": some["qb"].to_numpy()[row[new]]})

    asked = rows.where(queries).select("vec_id", "v", spread.alias("qb")).mapInPandas(probe, "query_id long, q array<double>, lists array<int>, bin int, qb int")
    placed = rows.withColumn("spread", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20))).mapInPandas(place, "vec_id long, v array<double>, list int, code binary, bin int")
    placed = placed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(1, wanted) - 1))))

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(x) and len(q):
            index = held()
            x = x.sort_values("vec_id", kind="stable")
            ids, v, lists = x["vec_id"].to_numpy(), _matrix(x["v"]), x["list"].to_numpy()
            codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
            error = np.concatenate([(v[m] - index.decode(int(n), codes[m])) for n in np.unique(lists) for m in [np.flatnonzero(lists == n)]])
            usual = np.sqrt((error**2).mean())
            members = {int(n): np.flatnonzero(lists == n) for n in np.unique(lists)}
            for s in range(0, len(q), 64):
                some = q.iloc[s : s + 64]
                qv, qid = _matrix(some["q"]), some["query_id"].to_numpy()
                near = np.full((len(some), len(x)), -np.inf)
                row = np.repeat(np.arange(len(some)), [len(n) for n in some["lists"]])
                into = np.concatenate(some["lists"].tolist())
                for n in np.intersect1d(into, list(members)).tolist():
                    who = row[into == n]
                    near[np.ix_(who, members[n])] = index.approximate(qv[who], n, codes[members[n]])
                near[qid[:, None] == ids[None, :]] = -np.inf
                last = min(RERANK * k, len(x)) - 1
                least = -np.partition(-near, last, axis=1)[:, last]
                least -= usual * np.linalg.norm(qv, axis=1)
                for i in range(len(some)):
                    at = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
                    score = v[at] @ qv[i]
                    top = np.argsort(-score, kind="stable")[:k]
                    out["query_id"] += [qid[i]] * len(top)
                    out["vec_id"] += ids[at][top].tolist()
                    out["score"] += score[top].tolist()
        return pd.DataFrame(out)

    return placed.groupBy("bin", "qb").cogroup(asked.groupBy("bin", "qb")).applyInPandas(best, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries, k: int = 20, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` holds for, the k of largest inner product found.

    queries: a condition on vec_id. The query's own id is no candidate; ties go to the lesser vec_id; fewer
    than k candidates are all returned. Vectors that are null, empty, zero or have a null or non-finite
    component take no part, nor do rows without an id; vectors of different dimensions are never compared.
    A repeated vec_id is searched and found once for each row that has it. No usable vector gives no rows.
    The index is fitted on `sample` vectors of least id hash; all vectors are indexed.
    """
    spark, v = vectors.sparkSession, usable(vectors)
    found = None
    for dimension, n in sorted((x["d"], x["count"]) for x in v.groupBy(F.size("v").alias("d")).count().collect()):
        own = v.where(F.size("v") == dimension)
        some = np.array([x.v for x in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], np.float64)
        index = Index(some, int(min(MOST_LISTS, max(1, LISTS * n**0.5))))
        probes = index.enough(some, k, share)
        held = ship(spark, index)

        def coded(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = held()
            for part in parts:
                at, codes = index.code(_matrix(part["v"])) if len(part) else ([], [])
                yield part.assign(list=np.array(at, np.int32), code=[c.tobytes() for c in codes])

        rows = cut(own.mapInPandas(coded, "vec_id long, v array<double>, list int, code binary"))
        sizes = np.zeros(len(index.centres), np.int64)
        for x in rows.groupBy("list").count().collect():  # a number for each list
            sizes[x["list"]] = x["count"]
        part = _search(rows, queries, k, index, sizes, probes)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
