"""Operators on vectors and pages, the queries, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from stowage.llm import common, pieces, queries, urlfilter, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        oracle.same(df, oracle.connect(SF), queries.ORACLES[name])
    else:
        assert df.count() > 0


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(6000, 16)), rng.normal(size=16) + rng.normal(size=(1500, 16)) * 0.01])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.nearest(df, F.col("vec_id") % 50 == 0, 10).toPandas()
    found = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -9
        assert np.allclose(score[g.vec_id], g.score) and sorted(g["rank"]) == list(range(1, 11))
        found += len(set(np.argsort(-score, kind="stable")[:10]) & set(g.vec_id))
    assert found >= 0.9 * 10 * 150


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, list int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (20, -1.0), (20, 1): (0, -1.0), (20, 2): (1, -1.0), (20, 3): (2, -1.0)}
    assert vectors.nearest(df.where("false"), F.lit(True)).count() == 0


def test_url_lists(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.example.com", "example.com", "m.other.net"]
    entries = [(rng.choice(["x", "y"]), rng.choice([*hosts, "com", "a.example.com/p", "a.example.com/p/q"]), f"2024-0{rng.randrange(1, 9)}-10", rng.choice(["add", "remove"])) for _ in range(60)] + [("x", None, "2024-01-01", "add"), (None, "com", "2024-01-01", "add"), ("x", "com", None, "add"), ("x", "com", "2024-02-02", "other")]
    urls = [f"{s}://{u}{h}{p}{q}" for s in ("http", "HTTPS") for u in ("", "me@") for h in (*hosts, "A.EXAMPLE.com:80") for p in ("", "/p", "/p/q/r", "/z") for q in ("", "?x=/p", "#y")] + [None, "", "nonsense", "mailto:x"]
    captures = [(i, u, f"2024-0{1 + i % 9}-1{i % 3}") for i, u in enumerate(urls)] + [(5, urls[0], None), (5, urls[0], None)]
    e = spark.createDataFrame(entries, "list string, key string, dated string, action string").withColumn("dated", F.col("dated").cast("timestamp_ntz"))
    c = spark.createDataFrame([(*x, "z") for x in captures], "page_id long, url string, fetched string, key string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    got = sorted((r.page_id, r.url or "", str(r.fetched), tuple((m.list, m.key) for m in r.matches)) for r in urlfilter.evaluate(c, e).collect())

    def active(name, key, at):
        past = [(d, a) for x, k, d, a in entries if x == name and k == key and d and d <= at and a in ("add", "remove")]
        return bool(past) and max(past)[1] == "add"

    want = []
    for i, u, at in captures:
        keys = []
        if u and "://" in u:
            rest = u.split("://")[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            host = host.rsplit("@", 1)[-1].split(":")[0].lower()
            parts = host.split(".")
            keys = [".".join(parts[k:]) for k in range(len(parts))]
            segments = [s for s in path.split("/") if s]
            keys += [host + "/" + "/".join(segments[: k + 1]) for k in range(len(segments))]
        hits = tuple(sorted((n, k) for n in ("x", "y") for k in set(keys) if at and active(n, k, at)))
        want.append((i, u or "", f"{at} 00:00:00" if at else "None", hits))
    assert got == sorted(want)
    assert urlfilter.evaluate(c, e.where("false")).where("blocked").count() == 0
    assert urlfilter.evaluate(c.where("false"), e).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    seen = set()
    for r in docs.collect():
        assert r.n_chars == len(r.text)
        own = {x for x in r.text.split("\n") if x.strip(" ")}
        assert not own & seen  # no line twice
        seen |= own
    encoder = pieces.OffsetEncoder(pieces.public_model())
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(encoder.encode(t)[0]) for i, t in texts.items()}


def test_executors_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parents[2]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.range(1).mapInPandas(lambda x: x, "id long").count()  # workers begin where the package can't be found
sys.path.insert(0, {str(repo)!r})
from stowage.llm import queries
for name in ("op1_chat_format", "op2_suffix_dedup", "op4_simhash_near_dedup", "op5_language_id", "op6_nearest_neighbours", "op8_toxicity", "op10_sentencepiece"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 0
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
