"""SimHash near copies against a comparison of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash as S

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for d, p in zip(ids, prints, strict=True):
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [least.get(find(p)) for p in prints]


def unsigned(n):
    return n % (1 << 64)


def test_any_four_positions_hold_a_triple():
    found = [set(t) for t in S.triples()]
    assert len(found) == 20 and all(any(t <= set(four) for t in found) for four in combinations(range(8), 4))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \n", "one", "One two THREE", "a b c d", "É é A b c d e", "w " * 10, " ".join(f"x{i % 700}" for i in range(400_000))]
    texts += [" ".join(rng.choices(["a", "B", "c", "dé", "e\x1ff"], k=rng.randint(1, 30))) for _ in range(100)]
    for text in texts:
        assert unsigned(S.fingerprint(text.encode())) == plain_print(text)


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def spanned(spark, prints):
    nodes = spark.createDataFrame([(signed(p),) for p in set(prints)], "node long")
    edges = [(unsigned(r["a"]), unsigned(r["b"])) for r in S.links(nodes).collect()]
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for p in parent:
        groups.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("limits", [{}, {"LIST": 8, "BUCKET_ROWS": 200, "AT_ONCE": 300}, {"LIST": 3, "HOT": 4}])
def test_links_of_crowded_and_far_fingerprints(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for base in prints[:40]:
        for flips in (1, 3, 4, 5, 6):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    hub = rng.getrandbits(64)
    prints += [hub ^ sum(1 << b for b in rng.sample(range(24), rng.randint(1, 12))) for _ in range(150)]  # all share five bytes
    where = brute(prints, prints)
    groups = {}
    for p, root in zip(prints, where, strict=True):
        groups.setdefault(root, set()).add(p)
    assert spanned(spark, prints) == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_components_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    for i in range(60):
        own = list(base)
        own[rng.randrange(150)] = f"v{i}"
        rows.append((10_000 + i, " ".join(own)))
    rows += [(20_000, None), (20_001, ""), (None, " "), (None, "only null ids have this text"), (20_002, base[0]), (20_002, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("node", "rep", "root", "copies", "n")})
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.near_copies(df).collect())
    prints = [plain_print(t) for _, t in rows]
    want = sorted((str(d), f"{p:016x}", str(c)) for (d, _), p, c in zip(rows, prints, brute([d for d, _ in rows], prints), strict=True))
    assert got == want
    assert S.near_copies(df.limit(0)).count() == 0
