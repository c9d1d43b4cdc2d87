"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.common import learns, ship, slices, table

#: Characters of labelled text a language is learnt from, texts these come from, and characters of a text.
REFERENCE_CHARS, REFERENCE_TEXTS, TEXT_CHARS = 40_000, 64, 8_192
#: Letters that have a column in the table, and entries of the table, at most; moves by other letters are looked up.
COLUMNS, ENTRIES = 250, 1 << 26
#: Texts are parsed in blocks of so many characters side by side; phrases go on from block to block.
BLOCK, LANES = 1024, 4096
SEPARATOR = 1


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that takes every substring of codes; state 0 is its start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class CrossParser:
    """One suffix automaton per language, as one table that many texts step through side by side.

    A text is cut greedily into the longest phrases that occur in a language's reference. The entropy of
    a language is phrases x log2(reference length) / text length; the least wins, ties to the lesser name.
    """

    def __init__(self, samples: dict[str, list[str]], reference_chars: int = REFERENCE_CHARS):
        self.langs = sorted(samples)
        texts = {x: " ".join(samples[x])[:reference_chars].lower() for x in self.langs}
        seen = Counter(c for t in texts.values() for c in t if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))  # the most frequent come first: they get the columns
        self.classes = np.zeros(sys.maxunicode + 1, np.min_scalar_type(2 + len(letters)))  # 0: a letter that no reference has
        self.classes[[not chr(i).isalpha() for i in range(sys.maxunicode + 1)]] = SEPARATOR
        for i, c in enumerate(letters):
            self.classes[ord(c)] = 2 + i
        coded = [self.codes(texts[lang]) for lang in self.langs]
        automata = [suffix_automaton(c.tolist()) for c in coded]
        self.width = 2 + min(len(letters), COLUMNS, max(0, ENTRIES // max(1, sum(map(len, automata))) - 2))
        self.letters = 2 + len(letters)
        tables, self.start, base = [], [], 0
        self.cost = [np.log2(max(2, len(c))) for c in coded]
        keys, to_ = [], []  # moves by letters without a column: state * letters + class, and where to
        for moves in automata:
            root = moves[0]
            restart = np.array([((base + root[c]) * self.width) << 2 | 1 if c in root else base * self.width << 2 | 2 for c in range(self.width)], np.int64)
            step = np.tile(restart, (len(moves), 1))
            step[0] -= 1  # at the start no phrase is open
            for s, move in enumerate(moves):
                for c, to in move.items():
                    if c < self.width:
                        step[s, c] = (base + to) * self.width << 2
                    else:
                        keys.append((base + s) * self.letters + c)
                        to_.append((base + to) * self.width << 2)
            tables.append(step.ravel())
            self.start.append(base * self.width)
            base += len(moves)
        flat = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.table = flat.astype(np.uint32) if flat.max(initial=0) < 2**32 and base * self.width << 2 < 2**32 else flat
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to_, np.int64)[order]

    def _looked_up(self, state: np.ndarray, code: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What the table would hold for letters that have no column; start: the state in which each language begins."""

        def move(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = at // self.width * self.letters + code
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[k] == key, self.to[k]

        at, start = state.astype(np.int64), start.astype(np.int64)
        known, to = move(at)
        first, again = move(start)
        # a phrase ends and the letter begins another, or is one by itself; at the start none is open
        new = np.where(first, again | 1, (start << 2 | 2) - (at == start))
        return np.where(known, to, new).astype(self.table.dtype)

    def _step(self, state: np.ndarray, code: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Four times the next state, and the phrases that end, for a letter each; arrays of one shape."""
        if self.width == self.letters:
            return self.table[state + code]
        v = self.table[state + np.minimum(code, self.width - 1)]
        if (rare := code >= self.width).any():
            v[rare] = self._looked_up(state[rare], code[rare], start[rare])
        return v

    def codes(self, text: str) -> np.ndarray:
        """Classes of a text's lower-cased characters; what is between letters is one separator."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.classes[points]
        sep = c == SEPARATOR
        return c[~(sep & np.concatenate(([True], sep[:-1])))] if len(c) else c

    def _fresh(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block, and the state after it, if it begins a phrase: languages x blocks."""
        start = np.array(self.start, self.table.dtype)[:, None]
        ended, last = np.zeros((len(self.langs), len(begin)), np.int64), np.repeat(start, len(begin), axis=1)
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), LANES):
            lanes = order[k : k + LANES]
            size = length[lanes]
            active = len(lanes) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
            state, count = np.repeat(start, len(lanes), axis=1), np.zeros((len(self.langs), len(lanes)), np.int64)
            for t, n in enumerate(active.tolist()):
                code = np.broadcast_to(flat[begin[lanes[:n]] + t], (len(start), n))
                v = self._step(state[:, :n], code, np.broadcast_to(start, code.shape))
                count[:, :n] += v & 3
                state[:, :n] = v >> 2
            ended[:, lanes], last[:, lanes] = count, state
        return ended, last

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text in each language: an array of texts x languages.

        All blocks are parsed as if each began a phrase. Those that a phrase runs into are parsed again from the state
        that the block before ends in, until both parses stand in one state, from where on they are the same.
        """
        out = np.zeros((len(coded), len(self.langs)), np.int64)
        sizes = np.array([len(c) for c in coded], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(coded)), blocks)
        if not len(owner) or not self.langs:
            return out
        flat = np.concatenate(coded)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[owner] + nth * BLOCK
        length = np.minimum(BLOCK, first[owner] + sizes[owner] - begin)
        start = np.array(self.start, self.table.dtype)
        fresh, last = self._fresh(flat, begin, length)
        ended, ends = fresh.copy(), last.copy()
        goes_on = np.concatenate((nth[1:] > 0, [False]))
        lang, block = np.nonzero((ends != start[:, None]) & goes_on)
        block = block + 1
        while len(lang):
            # state: from where the block before ends; new: from the start
            state, new = ends[lang, block - 1].copy(), start[lang].copy()
            delta, at = np.zeros(len(lang), np.int64), np.arange(len(lang))
            for t in range(int(length[block].max())):
                at = at[(state[at] != new[at]) & (t < length[block[at]])]
                if not len(at):
                    break
                code, begins = flat[begin[block[at]] + t], start[lang[at]]
                v, w = self._step(state[at], code, begins), self._step(new[at], code, begins)
                delta[at] += (v & 3).astype(np.int64) - (w & 3).astype(np.int64)
                state[at], new[at] = v >> 2, w >> 2
            ended[lang, block] = fresh[lang, block] + delta
            end = np.where(state == new, last[lang, block], state)
            other = (end != ends[lang, block]) & goes_on[block]
            ends[lang, block] = end
            lang, block = lang[other], block[other] + 1
        ended += (ends != start[:, None]) & ~goes_on
        np.add.at(out, owner, ended.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, entropy) of each text; `und` without a letter or without a language to choose."""
        coded = [self.codes(t or "") for t in texts]
        counts = self.phrases(coded)
        out = []
        for c, n in zip(coded, counts, strict=True):
            if not self.langs or not (c != SEPARATOR).any():
                out.append(("und", 0.0, None))
                continue
            bits = n * np.array(self.cost) / len(c)
            best = int(np.argmin(bits))
            rest = np.delete(bits, best)
            score = 1.0 if not len(rest) else float(1 - bits[best] / rest.min()) if rest.min() > 0 else 0.0
            out.append((self.langs[best], min(1.0, max(0.0, score)), float(bits[best])))
        return out


def fit(docs: DataFrame, reference_chars: int = REFERENCE_CHARS, texts: int = REFERENCE_TEXTS, text_chars: int = TEXT_CHARS) -> CrossParser:
    """Learn from rows with a lang and a text whose id may be learnt from.

    The sample is bounded: for each label the `texts` distinct texts with the least hash, of each `text_chars` characters, `reference_chars` in all. A repeated text counts once. Each task picks its own least hashes first, so that what
    meets for a label is a few rows of each task.
    """
    rows = docs.where(learns(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string"), "text", F.xxhash64("text").alias("h"))
    picked = rows.select("lang", "h").distinct()
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= texts)
    keys = [(x.lang, x.h) for x in picked.select("lang", "h").collect()]
    found = rows.where(F.col("h").isin(sorted({h for _, h in keys}))).select("lang", "h", F.substring("text", 1, text_chars).alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for x in sorted(found, key=lambda x: (x.lang, x.h, x.text)):
        if (x.lang, x.h) in set(keys):
            samples.setdefault(x.lang, []).append(x.text)
    return CrossParser(samples, reference_chars)


def identify(docs: DataFrame, parser: CrossParser, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits) per row: score is the margin to the second language as a share of its entropy.

    keep names columns that are passed on as they are; one that is called lang_pred, score or bits is refused.

    Whole texts are parsed, whatever their length. A text that is null, empty or without a letter gives `und`, score 0
    and no bits. Rows with a null or repeated doc_id are scored like any other; other columns are not read.
    """
    kept = [c for c in keep or [] if c != "doc_id"]
    if taken := {"lang_pred", "score", "bits"} & set(kept):
        raise ValueError(f"identify() gives columns of its own called {', '.join(sorted(taken))}")
    held = ship(docs.sparkSession, parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held()
        for batch in batches:
            for part in slices(batch):
                got = parser.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64()), *[part.column(c) for c in kept]],
                    ["doc_id", "lang_pred", "score", "bits", *kept],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c for c in kept if c != "text"])
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double" + more)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that may be learnt from; corners are as in identify()."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, fit(docs))
    return got.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "bits")
