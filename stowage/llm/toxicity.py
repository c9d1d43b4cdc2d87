"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import learns, ship, slices, table

#: Labelled texts of each class that are learnt from, and characters of each; the sample is bounded by these.
TEXTS, TEXT_CHARS = 1500, 12_000
#: A token of a toxic text is labelled toxic if the word, or a prefix of it, is RATIO times likelier in toxic
#: texts than in the others, by a likelihood ratio (G squared) of at least EVIDENCE.
RATIO, EVIDENCE = 8.0, 24.0
PREFIXES = range(3, 8)
WORD = re.compile(r"\w+")
#: Marginals up to this say nothing of a text, however many; weights up to LEAST are dropped after training.
CLEAR, LEAST = 0.1, 0.15
CACHE = 300_000


def words_of(text: str) -> list[str]:
    """The words of a text, each lower-cased by itself, so that their places are those in the text."""
    return [w.lower() for w in WORD.findall(text)] if not text.isascii() else WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, and its prefixes of 3 to 7 characters."""
    return ["=" + word, *[word[:k] for k in PREFIXES if k < len(word)]]


class Ragged:
    """Sequences side by side, longest first, stored by time: a step of all of them is one slice."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        lane = np.empty(len(sizes), np.int64)
        lane[self.order] = np.arange(len(sizes))
        longest = int(sizes.max(initial=0))
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        t = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.offset[t] + np.repeat(lane, sizes)


def forward_backward(emission: np.ndarray, sizes: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a two-state chain: log-odds of state 1 at every token, and what pairs need (forward, backward, place).

    emission: log-odds of state 1 by the token alone; trans[i, j]: weight of j after i.
    """
    r = Ragged(sizes)
    e = np.empty(len(emission))
    e[r.place] = emission
    a, b = np.empty_like(e), np.zeros_like(e)
    (t00, t01), (t10, t11) = trans
    for t, n in enumerate(r.active):
        s = slice(r.offset[t], r.offset[t] + n)
        if t:
            x = a[r.offset[t - 1] : r.offset[t - 1] + n]
            a[s] = e[s] + np.logaddexp(t01, t11 + x) - np.logaddexp(t00, t10 + x)
        else:
            a[s] = e[s] + start
    for t in range(len(r.active) - 2, -1, -1):
        n = r.active[t + 1]
        x = e[r.offset[t + 1] : r.offset[t + 1] + n] + b[r.offset[t + 1] : r.offset[t + 1] + n]
        b[r.offset[t] : r.offset[t] + n] = np.logaddexp(t10, t11 + x) - np.logaddexp(t00, t01 + x)
    return (a + b)[r.place], a[r.place], (e + b)[r.place], r.place


class Tagger:
    """Chain weights, feature weights, and the logistic layer from marginals to a document's score."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.start, self.trans, self.bias = 0.0, np.zeros((2, 2)), -4.0
        self.layer = np.array([-3.0, 0.0, 0.0, 0.0])
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[word] = self.bias + sum(get(f, 0.0) for f in features(word))
        return got

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        """Probability of toxic for every token of every text."""
        sizes = np.array([len(w) for w in words], np.int64)
        emission, look = self.emission, self.cache.get
        e = np.fromiter((x if (x := look(w)) is not None else emission(w) for ws in words for w in ws), np.float64, int(sizes.sum()))
        logit = forward_backward(e, sizes, self.start, self.trans)[0]
        return np.split(1 / (1 + np.exp(-np.clip(logit, -50, 50))), np.cumsum(sizes)[:-1]) if len(words) else []

    @staticmethod
    def summary(p: np.ndarray) -> np.ndarray:
        """Of a text's marginals: one, the largest, and of those over CLEAR log of one plus the sum, and the share of tokens."""
        clear = p[p > CLEAR].sum()
        return np.array([1.0, p.max(initial=0.0), np.log1p(clear), np.sqrt(clear / len(p)) if len(p) else 0.0])

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.layer @ self.summary(p), -50, 50))))


def label_tokens(words: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts whose word or prefix tells toxic texts from others."""
    seen = [Counter(), Counter()]
    for w, y in zip(words, toxic, strict=True):
        seen[int(y)].update({f for x in set(w) for f in features(x)})
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]

    def evidence(k: int, other: int) -> float:
        share = (k + other) / (n[0] + n[1])
        return 2 * sum(x * np.log(x / (m * q)) for x, m, q in ((k, n[1], share), (n[1] - k, n[1], 1 - share), (other, n[0], share), (n[0] - other, n[0], 1 - share)) if x > 0)

    telling = {f for f, k in seen[1].items() if (k + 0.5) / n[1] >= RATIO * (seen[0][f] + 0.5) / n[0] and evidence(k, seen[0][f]) >= EVIDENCE}
    return np.array([bool(y) and not telling.isdisjoint(features(x)) for w, y in zip(words, toxic, strict=True) for x in w], np.float64)


def train(texts: list[str], toxic: list[int], rounds: int = 40, penalty: float = 1e-3) -> Tagger:
    """Maximum likelihood of the labelled tokens by adaptive gradient steps, then the logistic layer by Newton steps."""
    model, y = Tagger(), np.array(toxic, np.int64)
    words = [words_of(t) for t in texts]
    pairs = [(w, v) for w, v in zip(words, y, strict=True) if w]
    words, y = [w for w, _ in pairs], np.array([v for _, v in pairs], np.int64)
    if not words or not y.any() or y.all():
        model.layer = np.array([4.0 if len(y) and y.all() else -4.0, 0.0, 0.0, 0.0])
        return model
    gold = label_tokens(words, y)
    sizes = np.array([len(w) for w in words], np.int64)
    vocabulary: dict[str, int] = {}
    token = np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for w in words for x in w), np.int64, int(sizes.sum()))
    names: dict[str, int] = {}
    owner, feature = [], []
    for x, i in vocabulary.items():
        for f in features(x):
            owner.append(i)
            feature.append(names.setdefault(f, len(names)))
    owner, feature = np.array(owner), np.array(feature)
    w, theta = np.zeros(len(names)), np.array([model.bias, 0.0, 0.0, 0.0, 0.0, 0.0])  # bias, start, transitions
    seen_w, seen_t = np.full(len(w), 1e-8), np.full(len(theta), 1e-8)
    first = np.cumsum(sizes) - sizes
    later = np.ones(len(token), bool)
    later[first] = False
    at = np.flatnonzero(later)
    n = len(token)
    for _ in range(rounds):
        trans = theta[2:].reshape(2, 2)
        e = (theta[0] + np.bincount(owner, w[feature], len(vocabulary)))[token]
        logit, a, eb, _ = forward_backward(e, sizes, theta[1], trans)
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        x, z = a[at - 1], eb[at]
        joint = np.stack([trans[0, 0] + 0 * x, trans[0, 1] + z, trans[1, 0] + x, trans[1, 1] + x + z])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        was, now = gold[at - 1], gold[at]
        real = np.array([((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
        d = gold - p
        by_word = np.bincount(token, d, len(vocabulary))
        gw = np.bincount(feature, by_word[owner], len(w)) - penalty * n**0.5 * w
        gt = np.concatenate(([d.sum(), d[first].sum()], real - joint.sum(axis=1))) - penalty * n**0.5 * theta
        seen_w += gw**2
        seen_t += gt**2
        w += 0.8 * gw / np.sqrt(seen_w)
        theta += 0.3 * gt / np.sqrt(seen_t)
    model.bias, model.start, model.trans = float(theta[0]), float(theta[1]), theta[2:].reshape(2, 2)
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > LEAST}
    x = np.array([model.summary(p) for p in model.marginals(words)])
    beta, keep = np.zeros(4), np.diag([1e-3, 1.0, 1.0, 1.0]) * 0.05
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + keep
        beta += np.clip(np.linalg.solve(h, x.T @ (y - q) - keep @ beta), -3, 3)
    model.layer = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, text_chars: int = TEXT_CHARS) -> Tagger:
    """Learn from the labelled documents whose id may be learnt from: of each class the `texts` with the least id hash.

    Labels that are null or not 0 or 1 are left out; of several labels of a document the greatest holds.
    """
    known = labels.where(learns(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    some = known.where("toxic = 1").orderBy("h", "doc_id").limit(texts).union(known.where("toxic = 0").orderBy("h", "doc_id").limit(texts))
    toxic = {x.doc_id: x.toxic for x in some.collect()}
    if not toxic:
        return train([], [])
    rows = docs.where(F.col("doc_id").isin(sorted(toxic))).groupBy("doc_id").agg(F.min(F.substring("text", 1, text_chars)).alias("text")).collect()
    rows = sorted((x.doc_id, x.text or "") for x in rows)
    return train([t for _, t in rows], [toxic[i] for i, _ in rows])


def score(docs: DataFrame, model: Tagger) -> DataFrame:
    """(doc_id, score, spans) per row; spans are runs of tokens that are likelier toxic than not, in characters.

    Whole texts are tagged, whatever their length. Null and empty texts get the score of no token. Rows
    with a null or repeated doc_id are scored like any other; other columns are not read.
    """
    held = ship(docs.sparkSession, model)
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        before = -2
        found = [m.span() for m in WORD.finditer(text)]
        for i in np.flatnonzero(p > 0.5).tolist():
            if i == before + 1:
                out[-1]["end"] = found[i][1]
            else:
                out.append({"begin": found[i][0], "end": found[i][1]})
            before = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            for part in slices(batch, rows=1000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                got = model.marginals([words_of(t) for t in texts])
                scores = pa.array([model.score(p) for p in got], pa.float64())
                marked = pa.array([spans(t, p) if (p > 0.5).any() else [] for t, p in zip(texts, got, strict=True)], spans_type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores, marked], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<begin:int,end:int>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that may be learnt from; corners are as in score()."""
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "spans")
