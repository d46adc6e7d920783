import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import near_duplicates as N
from weftline.session import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    links, parent = dict.fromkeys(sets, 0), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (find(d), links[d]) for d in sets}


def variants(rng, n, size, changes):
    base = [f"w{rng.randint(0, 9999)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(size)] = f"v{rng.randint(0, 9999)}"
        out.append(" ".join(own))
    return out


def test_groups_of_near_copies_over_several_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("GROUP", 24), ("BUCKET_ROWS", 500), ("AT_ONCE", 1000)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(2)
    texts = variants(rng, 90, 120, 3) + variants(rng, 25, 200, 6) + [" ".join(f"u{rng.randint(0, 99999)}" for _ in range(50)) for _ in range(40)] + ["short one"] * 3 + ["", None, "a b c d"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_shingles_match_words():
    rng = random.Random(3)
    shingle = N.Shingler()
    texts = ["", " \n", "One two", "a b c d e f", "É é É é É é", "x\ty\x0bz\rq w e"] + [" ".join(rng.choices(["ab", "ba", "c", "Dé"], k=rng.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert len(shingle(t.encode())) == len(shingles(t))
    assert N.node_of(shingle(b"A  b\nc d e")) == N.node_of(shingle(b"a b c d e"))


def test_pruning_keeps_what_can_reach_the_threshold():
    need = N.needed_matches()
    assert list(need) == list(range(32, N.HASHES + 1, 32)) and all(0 < m < 0.8 * n for n, m in need.items())
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(400):
        both = rng.integers(0, 2**64, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 10, dtype=np.uint64)])) for _ in range(2))
        sigs = np.stack([N.signature(a), N.signature(b)])
        lost += len(N._survivors(sigs, np.array([90, 90]), np.array([0]), np.array([1]))[0]) == 0
    assert lost == 0


def test_bands_find_links(spark):
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(500):
        both = rng.integers(0, 2**64, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 18, dtype=np.uint64)])) for _ in range(2))
        missed += not np.equal(*N.band_keys(np.stack([N.signature(a), N.signature(b)]))).any()
    assert missed <= 1


@pytest.mark.parametrize("edges,roots", [([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(30)], {i: 0 for i in range(1, 31)}), ([(9, i) for i in range(9)] + [(20, 21)], {**{i: 0 for i in range(1, 10)}, 21: 20})])
def test_components(spark, edges, roots):
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots


def test_keep_one_and_edges(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text, "x", 1), (3, text + " more", "x", 1), (3, text + " more", "x", 1), (7, None, "x", 1), (8, "", "x", 1), (None, "some other words are here now", "x", 1), (9, "w " * 50_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n_links long")
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "8", "9", "None"]
    assert N.similar(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_pairs_of_groups():
    rng = random.Random(6)
    for at_once in (1, 7, 10**6):
        sizes = [rng.randint(1, 9) for _ in range(20)]
        N.AT_ONCE, old = at_once, N.AT_ONCE
        got = [p for x, y in N._pairs(np.array(sizes)) for p in zip(x.tolist(), y.tolist(), strict=True)]
        N.AT_ONCE = old
        start = np.cumsum([0, *sizes])
        assert got == [p for i, n in enumerate(sizes) for p in combinations(range(start[i], start[i] + n), 2)]


def test_many_null_and_repeated_ids(spark):
    rng = random.Random(7)
    texts = variants(rng, 500, 60, 2)
    rows = [(None if i % 2 else 4, t) for i, t in enumerate(texts)]
    got = N.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(list(enumerate(texts)))
    assert len(got) == 500 and sorted(r["n_links"] for r in got) == sorted(n for _, n in want.values())


def test_own_columns_keep_their_values(spark):
    names = "key mark node size sig band id part parts i j salt root copies bucket links hub row at _key _turn _own_node".split()
    df = spark.createDataFrame([(1, "some words of a text here"), (2, "Some words of a text  here"), (3, None)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in names})
    got = N.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3] and all(r[c] == "mine" for r in got for c in names)
    assert N.similar(df).count() == 3


def test_pipeline_keeps_one_of_each_group_and_no_secret(spark):
    import corpus_pipeline
    from weftline.llm import decontaminate

    docs = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert decontaminate.find_windows(docs, bench).agg(F.sum("n_hit")).first()[0] == 0
    assert not N.similar(docs).filter("n_links > 0").filter("class_id <> doc_id").count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
