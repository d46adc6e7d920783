"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from weftline.llm import resampling as R

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, orders=2):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, share=25, least=20, orders=2, buckets=10_000):
    """{(doc_id, text): (n_words, n_features, weight, score, rank)} for rows that differ."""
    bucket = lambda g: crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in features(x, orders)[1]) for texts in ([x for _, x in docs], target))
    total, wanted = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = {}
    for d, x in docs:
        n, grams = features(x, orders)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out[d, x] = (n, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    drawn = sorted((k for k in out if out[k][0] >= least), key=lambda k: (-out[k][3], k[0] is None, k[0]))
    ranks = {k: i + 1 for i, k in enumerate(drawn[: len(drawn) * share // 100])}
    return {k: (*v, ranks.get(k)) for k, v in out.items()}


def corpus(rng, n):
    vocabulary = ["alpha", "Beta", "GAMMA", "delta9", "été", "naïve", "x", "日本", "it's", "semi-colon", "1999", "İ"]
    return [(i, rng.choice([" ", "\n", ", ", "--"]).join(rng.choices(vocabulary, weights=[9] * 3 + [2] * 9, k=rng.randint(0, 60)))) for i in range(n)]


def told(df):
    return {(r["doc_id"], r["text_"]): (r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("orders", "parts"), [(2, 1), (2, 9), (3, 3), (1, 3)])
def test_weights_scores_and_ranks(spark, monkeypatch, orders, parts):
    monkeypatch.setattr(R, "BLOCK_BYTES", 2_000)
    rng = random.Random(orders)
    docs, target = corpus(rng, 300), [t for _, t in corpus(rng, 20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text_", F.col("text")).repartition(parts)
    got = told(R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), orders=orders))
    assert got == brute(docs, target, orders=orders)


def test_long_texts_are_read_in_pieces_whole(spark):
    text = "Some word or other, 7 times over. " * 70_000  # over two pieces
    block = R.Block([text.encode(), b"", b"some word"], 2, 10_000)
    n, grams = features(text)
    assert block.lengths.tolist() == [n, 0, 2] and block.features().tolist() == [len(grams), 0, 3]
    tally = Counter(crc32(g.encode()) % 10_000 for g in grams + features("some word")[1])
    assert {b: c for b, c in enumerate(block.bucket_counts().tolist()) if c} == tally


def test_edges(spark):
    odd = [(1, None), (2, ""), (2, "-- !!"), (None, "w " * 25), (4, "v " * 25), (4, "v " * 25), (5, "lone")]
    clash = {c: F.lit("mine") for c in ("row", "told", "seat", "at", "part", "before", "drawn", "weight", "rank")}
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns(clash)
    target = spark.createDataFrame([("w v",), (None,)], "text string")
    got = R.resample(df, target, share=100)
    assert sorted(got.columns) == sorted(["doc_id", *[c for c in clash if c not in R.NEW], *R.NEW])
    rows = got.collect()
    assert len(rows) == len(odd) and {r["row"] for r in rows} == {"mine"}
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]  # the row that repeats is drawn twice
    assert {(r["weight"], r["n_features"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 0)}
    assert R.resample(df.limit(0), target).count() == 0
    assert {r["n_features"] for r in R.resample(df, target.limit(0)).collect()} == {0, 1, 49}


def test_draw_leans_towards_the_target(spark):
    rng = random.Random(5)
    near, far = [f"n{i}" for i in range(200)], [f"f{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(near if i % 2 else far, k=60))) for i in range(400)]
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(" ".join(rng.choices(near, k=3000)),)], "text string"))
    drawn = [r["doc_id"] % 2 for r in got.collect() if r["rank"]]
    assert len(drawn) == 100 and sum(drawn) > 60
