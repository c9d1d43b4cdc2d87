"""Operators on documents against brute force, and the cases at the edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from stowage.llm import chat, common, components, decontaminate, langid, lines, pieces, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, fp string, component_id string, h long, row long"
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (None, "no id"), (None, "no id"), (4, "word"), (5, "word"), (5, "word"), (6, "ünï cödé 日本語 \U0001f600"), (7, "x" * 30000), (8, "a b c d e f g h"), (9, "\0")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "f", "c", 1, 2) for i, t in rows], SCHEMA)


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared passages and shared lines."""
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " more", words(rng, 8) + "\n" + texts[9] + "\n" + words(rng, 5)]
    texts += ["\n".join(rng.choice(texts[:60]) for _ in range(4)) for _ in range(12)]
    for _ in range(12):
        t = rng.choice(texts[:60]).split()
        t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + EDGES


# --- chat


def least_cost(roles):
    import heapq

    heap, seen = [(0, 0, "start")], set()
    while heap:
        c, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s == "assistant":
            return c
        other = [0 if i < len(roles) and roles[i] == t else chat.NAME if i < len(roles) and roles[i] is None else chat.RELABEL for t in chat.FOLLOWS[s]]
        for t, o in zip(chat.FOLLOWS[s], other, strict=True):
            heapq.heappush(heap, (c + chat.INSERT, i, t))
            if i < len(roles):
                heapq.heappush(heap, (c + o, i + 1, t))
        if i < len(roles) and s != "start":
            o = 0 if roles[i] == s else chat.NAME if roles[i] is None else chat.RELABEL
            heapq.heappush(heap, (c + chat.MERGE + o, i + 1, s))


def test_chat_costs_least():
    rng = random.Random(1)
    for _ in range(2000):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 11))]
        out = list(chat.repaired([(r, f"t{i}") for i, r in enumerate(roles)], chat.decide(iter(roles))))
        assert sum(o[4] for o in out) == least_cost(roles)
        state = "start"
        for o in out:
            assert o[1] in chat.FOLLOWS[state]
            state = o[1]
        assert state == "assistant"
        assert [x for o in out for x in o[2].split("\n") if x] == [f"t{i}" for i in range(len(roles))]


def test_chat_streams_long_conversations():
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    choices = chat.decide(["user", "assistant"][i % 2] for i in range(n))
    assert len(choices) == n and tracemalloc.get_traced_memory()[1] < 3_000_000
    read = 0

    def turns():
        nonlocal read
        for i in range(n):
            read += 1
            yield ["user", "assistant"][i % 2], "x" * 100 + str(i)

    tracemalloc.reset_peak()
    for position, _, _, merged, cost in chat.repaired(turns(), choices):
        assert read <= position + 2 and (merged, cost) == (1, 0)
    assert position == n - 1 and tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    # what comes last can change what is done with the first turn
    late = chat.decide(["user", "assistant"] * 20 + ["system"] * 200)
    assert next(iter(chat.repaired([(r, "x") for r in ["user", "assistant"] * 20 + ["system"] * 200], late)))[3] == 240


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "bot", "<|im_end|>"), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, 5, None, "x"), (2, 5, "", "")]
    rows += [(3, i, "user", "y") for i in range(1500)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position long")
    out = chat.format_turns(df).collect()
    assert sum(r.n_turns for r in out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.conv_id].append((r.position, r.role))
    assert [x for _, x in sorted(by[3])] == ["user", "assistant"] and len(by[None]) == 4
    assert chat.format_turns(df.where("false")).count() == 0
    assert chat.decide([]) == b"" and list(chat.repaired([], b"")) == []
    assert "<| im_end" in "".join(r.rendered for r in out)


# --- suffixes


@pytest.mark.parametrize("hot", [0, 2, 1 << 16])
def test_suffixes(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", 1500)
    monkeypatch.setattr(suffixes, "STEP", 256)
    shared = "passage that is fifty bytes or more, of which there are several"
    rows = [*corpus] + [(2000, "a" + shared), (2001, shared[:49] + "zz" + shared), (2002, "é" * 24 + shared + "q")]
    first: dict[bytes, int] = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = Counter()
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], suffixes.NO_ID if i is None else i)
    for i, t in order:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (suffixes.NO_ID if i is None else i):
                cover[p : p + 50] = True
        edge = np.flatnonzero(np.diff(cover.astype(int), prepend=0, append=0))
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        want[i, len(b), tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixes.remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_contexts_of_a_notice_are_not_one_group(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 40_000)
    monkeypatch.setattr(suffixes, "HOT", 8)
    rng = random.Random(18)
    notice = words(rng, 12, 30000)
    rows = [(i, words(rng, 40, 30000) + " " + notice + " " + words(rng, 40, 30000)) for i in range(3000)]
    groups = []
    chunks = [suffixes.Chunk(pd.DataFrame(rows[k : k + 100], columns=["doc_id", "text"]), 50) for k in range(0, 3000, 100)]
    sent = pd.DataFrame([(c, 0, suffixes._pack(*x.first())) for c, x in enumerate(chunks)], columns=["chunk", "bucket", "data"])
    answers = suffixes._answer_first(sent)
    for c, x in enumerate(chunks):
        x.repeated(answers[answers["chunk"] == c], 1)
        groups += [("context", d) for d in x.short[x.of[x.sent]].tolist()] + [("window", d.tobytes()) for d in x.digests]
    assert max(Counter(groups).values()) <= len(chunks)
    got = suffixes.remove_repeats(frame(spark, rows), texts=False).collect()
    text = dict(rows)
    assert all((r.doc_id == 0) == (not r.spans) and all(notice in text[r.doc_id][s.begin : s.end] for s in r.spans) for r in got)


# --- benchmark passages


def test_decontaminate(spark, corpus):
    rng = random.Random(9)
    items = [(k, words(rng, n, 30000)) for k, n in enumerate([3, 5, 12, 30, 60, 30])] + [(50, None), (51, " ")]
    rows = list(corpus)
    for k, (_, text) in enumerate(items[:6]):
        t = text.split()
        rows.append((3000 + k, words(rng, 9) + " " + text.upper() + "! " + words(rng, 9)))
        t[len(t) // 2] = "changed"
        rows.append((3100 + k, " ".join(t)))
        rows.append((3200 + k, words(rng, 3) + "\n" + "\n".join(text.split()[1:])))

    def plain(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", "", (t or "").lower())).split()

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))

    want = {}
    for i, t in rows:
        w = plain(t)
        for item, text in items:
            v = plain(text)
            if not v or not w:
                continue
            k = min(5, len(v))
            for s in range(max(1, len(w) - len(v) + 1)):
                if len(w) >= k:
                    a, b = bag(w[s : s + len(v)], k), bag(v, k)
                    x = sum((a & b).values()) / sum((a | b).values())
                    if x >= 0.8:
                        want[i, item] = max(want.get((i, item), 0), x)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(frame(spark, rows), bench).collect()}
    assert got == pytest.approx(want)
    kept = {r.doc_id for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.find(frame(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.find(frame(spark, rows).where("false"), bench).count() == 0


def test_decontaminate_over_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 64)
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    rng = random.Random(17)
    items = [(k, words(rng, n, 30000)) for k, n in enumerate([20, 40, 60, 100])]
    rows, want = [], {}
    for at in range(0, 140, 3):
        for k, text in items:
            rows.append((10 * at + k, words(rng, at) + " " + text + " " + words(rng, 150)))
            want[10 * at + k, k] = (at, 1.0)
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontaminate_finds_what_is_not_aligned(spark):
    rng = random.Random(10)
    items = [(k, words(rng, n, 30000)) for k, n in enumerate([50, 60, 100])]
    rows = []
    for k, text in items:
        t = text.split()
        h = len(t) // 2
        rows.append((k, " ".join([words(rng, 40), *t[h:], *t[:h], words(rng, 40)])))
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # the shingles over the cut are lost, four of each
    assert got == {(k, k): (40, pytest.approx((n - 8) / n)) for k, n in enumerate([50, 60, 100])}


def test_decontaminate_finds_all_of_the_least_similarity(spark):
    rng = random.Random(11)
    items = [(k, words(rng, 49, 30000)) for k in range(600)]
    # 45 shingles, of which the first five are lost: 40 of 50
    rows = [(k, " ".join([words(rng, 9), *text.split()[5:]])) for k, text in items]
    got = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(600)}
    assert all(r.similarity == 0.8 for r in got)


def test_decontaminate_counts_repetitions(spark):
    rng = random.Random(12)
    items = [(0, "a b " * 12), (1, "a " * 20 + words(rng, 10)), (2, "a")]
    rows = [(k, " ".join(rng.choice("aaab") if rng.random() < 0.3 else "ab"[i % 2] for i in range(60))) for k in range(30)] + [(30, "a " * 19 + items[1][1]), (31, "b " + "a " * 40)]

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    for i, t in rows:
        for item, text in items:
            w, v = t.split(), text.split()
            k = min(5, len(v))
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s : s + len(v)], k), bag(v, k)
                x = sum((a & b).values()) / sum((a | b).values())
                if x >= 0.8 and x > want.get((i, item), (0, 0))[1]:
                    want[i, item] = (s, x)
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 30


def test_every_fingerprint_in_the_radius_is_found(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    flips = [(w, b, rng.choice(base), rng.sample(range(64), b)) for w, b in enumerate(list(range(16)) * 5)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    windows = [(w, 10, signed(x ^ sum(1 << i for i in bits))) for w, _, x, bits in flips]
    items = [(i, 10, signed(x)) for i, x in enumerate(base)]
    got = decontaminate.hamming_candidates(spark.createDataFrame(windows, "w long, size int, fp long"), spark.createDataFrame(items, "item_id long, size int, fp long"))
    got = {tuple(r) for r in got.select("w", "item_id").collect()}
    want = {(w, i) for w, _, f in windows for i, _, x in items if ((f ^ x) & (1 << 64) - 1).bit_count() <= 15}
    assert got == want and {w for w, _ in want} == set(range(80))


# --- SimHash


def test_covering_masks():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for _ in range(3000):
            bits = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not bits & m & (1 << 64) - 1 for m in masks)


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_near_duplicates(spark, block):
    rng = random.Random(4)
    shared = rng.getrandbits(64)
    # many that share the bits of a mask, so that buckets are filed again
    fps = [shared ^ rng.getrandbits(64) & ~simhash.covering_masks(3)[2] for _ in range(60)]
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(x)
            for i in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << i
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long"), 3, block)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}


def test_fingerprint():
    import xxhash

    text = "One two\tTHREE four\x0bfive é É"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("a  b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_edges(spark, corpus):
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by = defaultdict(set)
    for r in got:
        by[r.fp].add(r.component_id)
    assert all(len(v) == 1 for v in by.values()) and by[0] == {1}
    kept = simhash.keep_one(frame(spark, corpus))
    assert kept.columns == frame(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect())[5] <= 1
    assert simhash.near_duplicates(frame(spark, []).where("false")).count() == 0


def test_each_group_keeps_one(spark):
    rng = random.Random(15)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (2, a), (1, b), (3, b), (1, b)]
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect()) == {(1, a): 1, (1, b): 1}


# --- languages


def test_cross_parsing():
    parser = langid.CrossParser({"x": ["abcabcabd"], "y": ["zzzyx"]})

    def phrases(text, ref):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in ref:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    for text in ("abcab", "zzabd", "qqq", "abdabcaz", "a", "xyz zy"):
        got = parser.phrases([parser.codes(text)])[0].tolist()
        assert got == [phrases(text, "abcabcabd"), phrases(text, "zzzyx")]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_phrases_go_on_from_block_to_block(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(16)
    refs = {"x": "".join(rng.choice("abc") for _ in range(3000)), "y": "".join(rng.choice("abcd ") for _ in range(500)).strip()}
    refs = {k: " ".join(v.split()) for k, v in refs.items()}
    parser = langid.CrossParser({k: [v] for k, v in refs.items()})

    def phrases(text, ref):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in ref:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    texts = [refs["x"][100:1600], "".join(rng.choice("abcd") for _ in range(5000)), refs["x"][:1024] + refs["x"][1024:2900], "a", "", refs["y"][:200] * 9, refs["x"][5:1400] + "zz" + refs["x"][7:]]
    assert parser.phrases([parser.codes(t) for t in texts]).tolist() == [[phrases(t, refs[x]) for x in ("x", "y")] for t in texts]
    assert parser.phrases([parser.codes(texts[0])])[0][0] == 1


@pytest.mark.parametrize("entries", [1 << 26, 0])
def test_cross_parsing_knows_all_letters(monkeypatch, entries):
    if entries == 0:
        monkeypatch.setattr(langid, "ENTRIES", entries, raising=False)
    rng = random.Random(13)
    common = [chr(0x100 + i) for i in range(60)]
    alphabets = [[chr(at + i) for i in range(250)] for at in (0x4E00, 0x5000, 0xAC00, 0x20000)]
    refs = {f"l{k}": "".join(rng.choice(common + a) for _ in range(900)).lower() for k, a in enumerate(alphabets)}
    parser = langid.CrossParser({k: [v] for k, v in refs.items()})

    def phrases(text, ref):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in ref:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    texts = []
    for v in refs.values():
        for _ in range(10):
            s = rng.randrange(800)
            texts.append(v[s : s + 40] + "".join(rng.choice(common + rng.choice(alphabets)) for _ in range(30)).lower() + "\u9fa5")
    got = parser.phrases([parser.codes(t) for t in texts]).tolist()
    assert got == [[phrases(t, refs[x]) for x in sorted(refs)] for t in texts]
    assert [x[0] for x in parser.predict([v[100:160] for v in refs.values()])] == list(refs)


def test_every_label_is_learnt(spark):
    rng = random.Random(14)
    rows = [(i, " ".join("".join(rng.choice(f"{chr(97 + k % 9)}{chr(106 + k // 9)}xyz") for _ in range(6)) for _ in range(30)), f"l{k}") for i, k in enumerate(list(range(70)) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df).langs == sorted({f"l{k}" for k in range(70)})


def test_language_of_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.op5_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_edges(spark, corpus):
    df = frame(spark, corpus)
    got = langid.identify(df, langid.fit(df), keep=["text", "lang"]).collect()
    assert len(got) == len(corpus)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


# --- toxicity


def test_toxicity_of_held_out_documents(spark):
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 1, 7, 3])
    e, trans = rng.normal(size=16), rng.normal(size=(2, 2))
    logit = toxicity.forward_backward(e, sizes, 0.3, trans)[0]
    at = 0
    for n in sizes:
        total = np.zeros((n, 2))
        for bits in range(2**n):
            y = [bits >> i & 1 for i in range(n)]
            s = sum(e[at + i] for i in range(n) if y[i]) + 0.3 * y[0] + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
            for i in range(n):
                total[i, y[i]] += np.exp(s)
        assert np.allclose(np.log(total[:, 1] / total[:, 0]), logit[at : at + n])
        at += n


def test_toxicity_edges(spark, corpus):
    model = toxicity.train(["you idiot", "fine day", "idiot idiot here"] * 20, [1, 0, 1] * 20)
    got = toxicity.score(frame(spark, [*corpus, (77, "an İdiot idiot")]), model).collect()
    assert len(got) == len(corpus) + 1 and all(0 <= r.score <= 1 for r in got)
    # İ is two characters in lower case: places are those of the text itself
    text = "an İİ idiot İ ok idiot idiot"
    (row,) = toxicity.score(frame(spark, [(78, text)]), model).collect()
    assert [text[s.begin : s.end] for s in row.spans] == ["idiot", "idiot idiot"]
    assert toxicity.train([], []).score(np.zeros(0)) < 0.3


# --- lines


def test_lines(spark, corpus):
    shared = words(random.Random(20), 9)
    rows = [*corpus, (None, shared), (None, shared + "\n" + words(random.Random(21), 9)), (8, "z"), (8, "z\n" + shared)]
    no_id = float("inf")
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                seen[x].add(no_id if i is None else i)
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in seen}
    parent = {x: x for x in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in seen:
        for b in seen:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in seen:
        groups[find(x)].append(x)
    out = [(r.doc_id, r.text) for r in lines.deduplicate(frame(spark, rows)).collect()]
    assert Counter(i for i, _ in out) == Counter(i for i, _ in rows) and (1, None) in out and (2, "") in out
    left = defaultdict(list)
    for i, t in out:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                left[find(x)].append((no_id if i is None else i, x))
    assert set(left) == set(groups) and all(len(v) == 1 for v in left.values())
    assert all(v[0][0] == min(i for x in groups[k] for i in seen[x]) for k, v in left.items())
    assert lines.deduplicate(frame(spark, []).where("false")).count() == 0


def test_lines_that_are_nearly_similar(spark):
    """1250 variants of a line, most of them 0.7 to 0.8 similar to each other."""
    rng = random.Random(22)
    base = "".join(chr(rng.randrange(97, 123)) for _ in range(300))
    rows = []
    for i in range(1250):
        x = list(base)
        for k in rng.sample(range(0, 300, 8), rng.choice([1, 3, 4])):
            x[k] = chr(rng.randrange(48, 58))
        rows.append((i, "".join(x)))
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    docs = frame(spark, rows)
    root = {r["first"]: r.root for r in lines.components(docs).collect()}
    first = {x: i for i, x in reversed(rows)}
    got, want = defaultdict(set), defaultdict(set)
    for i, x in rows:
        got[root.get(first[x], ("alone", first[x]))].add(i)
        want[find(i)].add(i)
    found = Counter(frozenset(x) for x in got.values())
    # a few of those with hardly a similar line share no band with it
    assert len(found) <= 1.03 * len(want) + 3 and max(map(len, got.values())) >= 0.97 * max(map(len, want.values()))


def test_similar_lines_share_a_band(spark):
    rng = random.Random(6)
    rows = []
    for k in range(3000):
        x = "".join(chr(rng.randrange(97, 123)) for _ in range(47))
        rows += [(2 * k, x[:43]), (2 * k + 1, x[4:])]  # 36 shingles each, 32 in common: 0.8
    keys = {r["first"]: set(r["keys"]) for r in lines.signatures(frame(spark, rows)).collect()}
    assert sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(3000)) >= 0.975 * 3000  # 0.986 expected


def test_no_similar_pair_of_a_bucket_is_passed_over(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(200):
        x = "".join(chr(rng.randrange(97, 123)) for _ in range(17))
        rows += [(10 * k, "".join(chr(rng.randrange(97, 123)) for _ in range(16))), (10 * k + 1, x[:16]), (10 * k + 2, x[1:])]  # 9 shingles each, 8 in common: 0.8
    docs = frame(spark, rows)
    # each three are one bucket, the first its most frequent line
    known = docs.selectExpr("doc_id div 10 as key", "xxhash64(text) as h", "doc_id % 10 = 0 as most", "doc_id as first")
    center = known.where("most").selectExpr("key", "h as center")
    found = known.join(center, "key").selectExpr("key", "h", "1 as n", "first", "center")
    monkeypatch.setattr(lines, "candidates", lambda *_: found)
    root = {r["first"]: r.root for r in lines.components(docs).collect()}
    assert sorted(root) == [10 * k + j for k in range(200) for j in (1, 2)]
    assert all(root[10 * k + 1] == root[10 * k + 2] for k in range(200))


def test_signatures_are_least_hashes_in_small_methods(spark, corpus, monkeypatch):
    docs = frame(spark, [*corpus, (1, "a"), (2, "\U0001f600" * 20), (3, "abcdefgh"), (4, "abcdefghi")])
    keys = lambda: {r["h"]: (r["first"], r["n"], r["keys"]) for r in lines.signatures(docs).collect()}
    found = keys()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = lines.signatures(docs)._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 5000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    monkeypatch.setattr(lines, "STEP", 2)
    assert found == keys()


def test_pairs_with_a_center_are_compared_once(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = []
    for k in range(20):
        x = some(40)
        rows += [(10 * k, x), (10 * k + 1, x + "0"), (10 * k + 2, some(40)), (10 * k + 3, some(40))]
    docs = frame(spark, rows)
    known = docs.selectExpr("doc_id div 10 as key", "xxhash64(text) as h", "doc_id % 10 = 0 as most", "doc_id as first")
    center = known.where("most").selectExpr("key", "h as center")
    found = known.join(center, "key").selectExpr("key", "h", "1 as n", "first", "center")
    pairs, seen = lines._pairs, []
    monkeypatch.setattr(lines, "candidates", lambda *_: found)
    monkeypatch.setattr(lines, "_pairs", lambda label, similarity: seen.extend(r.h for r in label.collect()) or pairs(label, similarity))
    root = {r["first"]: r.root for r in lines.components(docs).collect()}
    assert sorted(root) == [10 * k + j for k in range(20) for j in (0, 1)]
    first = {r.h: r["first"] for r in known.collect()}
    assert sorted(first[h] for h in seen) == [10 * k + j for k in range(20) for j in (1, 2, 3)]


def test_lines_edges(spark, corpus):
    out = lines.deduplicate(frame(spark, corpus))
    assert out.columns == frame(spark, []).columns and out.count() == len(corpus)


# --- pieces


def test_pieces_equal_the_library():
    encoder = pieces.OffsetEncoder(pieces.public_model())
    for text in ["", " ", "a b  c ", "ünï 日本語 \U0001f600", "<s> x</s>", "▁ a", "x" * 500, "l\n\tm", "\0a"]:
        ids, begins, ends = encoder.encode(text)
        assert ids == encoder.library.encode(text, add_bos=True, add_eos=True)
        proto = encoder.library.encode(text, return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(begins[1:-1].tolist(), ends[1:-1].tolist(), strict=True))


def test_character_map():
    import struct

    # a trie of one entry, a -> bc
    units = [0] * 512
    units[0] = (256 >> 0) << 10
    units[256 ^ ord("a")] = (ord("a")) | 1 << 8 | (32 << 10)
    units[256 ^ ord("a") ^ 32] = 0 | 1 << 31
    blob = struct.pack("<I", 2048) + struct.pack("<512I", *units) + b"bc\0"
    m = pieces.CharacterMap(blob)
    assert m.longest(b"xa", 1) == (1, b"bc") and m.longest(b"xa", 0) is None


def compiled(entries):
    """A character map in its binary form: a double-array trie of the entries, and their replacements."""
    import struct

    trie, strings = {}, b""
    for source, to in entries.items():
        node = trie
        for c in source.encode():
            node = node.setdefault(c, {})
        node[-1] = len(strings)
        strings += to.encode() + b"\0"
    units, used, bases, waiting = {0: 0}, {0}, set(), [(0, trie)]
    while waiting:
        at, node = waiting.pop()
        slots = [0 if c < 0 else c for c in node]
        base = next(b for b in range(256, 1 << 20) if b not in bases and not any(b ^ c in used for c in slots))
        bases.add(base)
        used.update(base ^ c for c in slots)
        units[at] |= (at ^ base) << 10 | (256 if -1 in node else 0)
        for c, below in node.items():
            if c < 0:
                units[base] = 1 << 31 | below
            else:
                units[base ^ c] = c
                waiting.append((base ^ c, below))
    size = max(units) + 257
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)]) + strings


def test_offsets_through_a_character_map():
    rng = random.Random(19)
    letters = "abcdéß日\u0301ﬁ "
    entries = {"a": "A", "ab": "", "abc": "xyz", "abcd": "é", "é": "e", "e\u0301": "é", "ß": "ss", "日": " ", "ﬁ": "fi", "  ": " ", "\u0301": ""}
    while len(entries) < 150:
        entries["".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))] = "".join(rng.choice(letters) for _ in range(rng.randint(0, 3)))
    entries = {k: v for k, v in entries.items() if k}
    encoder = pieces.OffsetEncoder(pieces.public_model())
    encoder.plain, encoder.squeeze, encoder.map = False, False, pieces.CharacterMap(compiled(entries))
    for _ in range(400):
        text = "".join(rng.choice(letters + "xyz") for _ in range(rng.randint(1, 40)))
        out, places, at, byte = ["▁"], [0, 0, 0], 0, 0
        while at < len(text):
            n = max((n for n in range(1, 8) if text[at : at + n] in entries and at + n <= len(text)), default=0)
            new = (entries[text[at : at + n]] if n else text[at]).replace(" ", "▁")
            out.append(new)
            places += [byte] * len(new.encode())
            byte += len(text[at : at + max(n, 1)].encode())
            at += max(n, 1)
        got, where = encoder.normalise(text.encode())
        assert (got.decode(), where.tolist()) == ("".join(out), [*places, byte])


def test_normaliser_squeezes():
    encoder = pieces.OffsetEncoder(pieces.public_model())
    encoder.plain, encoder.squeeze = False, True
    text, places = encoder.normalise("  a  b ".encode())
    assert text.decode() == "▁a▁b" and places.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]


def test_pieces_edges(spark, corpus):
    got = pieces.digests(frame(spark, corpus), pieces.public_model()).collect()
    assert len(got) == len(corpus) and all(r.n_covered == r.n_bytes for r in got)
    import sentencepiece

    library, want = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model()), Counter()
    for i, t in corpus:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    encoder = pieces.OffsetEncoder(pieces.public_model())
    encoder.size = encoder.size + 1
    assert encoder.encode("a word")[1:] == (None, None)
    full = pieces.encode(frame(spark, corpus), pieces.public_model()).collect()
    assert sorted(len(r.ids) for r in full) == sorted(r.n_tokens for r in got)
