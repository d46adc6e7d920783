import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import ITEM
from weftline.operators import fits, insights, learned, outfits, parts
from weftline.plans import bind
from weftline.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
LOOK = "look long, embedding array<float>"


@pytest.fixture(params=["whole", "named"])
def dealt(request, monkeypatch):
    """Several parts, tables of few rows, and vectors sent whole or by name."""
    for name, value in (("LEAST_ROWS", 40), ("ROWS_A_VECTOR", 1), ("ROWS_NAMED", 40), ("_AT_ONCE", 16), ("MOST_VECTORS", 1 << 19 if request.param == "whole" else 0)):
        monkeypatch.setattr(parts, name, value)


def made(spark, seed):
    """Sets with items that stand twice, items without a vector, and a vector's number that stands twice."""
    rng = random.Random(seed)
    pool = [(n, rng.choice(["top", "bottom", "shoes", "bag", "hat", None]), rng.choice(["tie", "shorts", "jeans", None]), rng.choice([None, *outfits.GROUPS]), rng.choice([None, *outfits._PATTERNS]), rng.choice([None, 0.2, 1.0])) for n in range(60)]
    looks = [(n, [rng.uniform(-1, 1) for _ in range(4)]) for n in [*range(18), 3, 3]] + [(18, None)]
    held = {k: sorted(rng.sample(range(60), rng.randint(1, 6))) for k in range(50)}
    members = [(k, *pool[i]) for k, ids in held.items() for i in [*ids, ids[0]]] + [(None, *pool[0])]
    rng.shuffle(members)
    return held, dict(enumerate(pool)), looks, spark.createDataFrame(members, ITEM.replace("outfit_id", "k")), spark.createDataFrame(looks, LOOK)


def by_number(looks):
    found = {}
    for n, v in looks:
        if v is not None:
            found.setdefault(n, []).append(np.array(v, np.float32).astype(float))
    return found


def plain_style(ids, found, top):
    each = [found.get(i % top, []) for i in ids]
    dots = [a @ b for i, vs in enumerate(each) for ws in each[i + 1 :] for a in vs for b in ws]
    return float(min(max((np.mean(dots) - 0.2) / 0.6, 0), 1)) if dots else None


def test_styles_in_parts_are_those_of_all_pairs(spark, dealt):
    held, _, looks, members, table = made(spark, 3)
    rows = members.select("k", "item_id", parts.packed().alias("code"))
    got = {r["k"]: r for r in parts.styles(rows, "k", rows.count(), table, 20).collect()}
    want = {k: plain_style(ids, by_number(looks), 20) for k, ids in held.items()}
    assert set(got) == set(held) and None in want.values()
    styled = spark.createDataFrame([(k, v) for k, v in want.items()], "k long, style double")
    score = outfits.set_score(F.col("items"), F.col("style")).alias("score")
    scores = dict(outfits.as_sets(members.distinct(), "k").join(styled, "k").select("k", score).collect())
    for k in held:
        assert got[k]["style"] == pytest.approx(want[k], abs=1e-6) and got[k]["score"] == pytest.approx(scores[k], abs=0.11)


def test_personal_styles_in_parts(spark, dealt):
    held, _, looks, members, table = made(spark, 4)
    owner = {k: None if k % 5 == 0 else k % 7 for k in held}
    rows = members.join(spark.createDataFrame(list(owner.items()), "k long, owner long"), "k", "left").select("owner", "k", "item_id")
    got = {r["k"]: r for r in parts.personal_styles(rows, "k", "owner", rows.count(), table, 20).collect()}
    found, tastes = by_number(looks), {}
    for o in {o for o in owner.values() if o is not None}:
        own = [v for i in sorted({i for k in held if owner[k] == o for i in held[k]}) for v in found.get(i % 20, [])]
        tastes[o] = np.mean(own, axis=0) / np.linalg.norm(np.mean(own, axis=0)) if len(own) >= 3 else None
    assert set(got) == set(held)
    for k, ids in held.items():
        style, taste, own = plain_style(ids, found, 20), tastes.get(owner[k]), [v for i in ids for v in found.get(i % 20, [])]
        fit = None if style is None or taste is None else min(max((np.mean([taste @ v for v in own]) - 0.2) / 0.6, 0), 1)
        assert got[k]["coherence"] == pytest.approx(style, abs=1e-6) and got[k]["user_fit"] == pytest.approx(fit, abs=1e-6)
        assert got[k]["style"] == pytest.approx(style if fit is None else 0.75 * style + 0.25 * fit, abs=1e-6)


def test_differences_in_parts_are_those_of_sets_with_vectors(spark, dealt):
    held, pool, looks, members, table = made(spark, 5)
    looks = spark.createDataFrame([x for x in dict(looks).items() if x[1] is not None], LOOK)
    tests = spark.createDataFrame([(k, random.Random(k).choice(ids), next(i for i in range(60) if i not in ids)) for k, ids in held.items() if k % 9], "k long, true_id long, fake_id long")
    catalogue = spark.createDataFrame(list(pool.values()), ITEM.split(", ", 1)[1])
    rows = parts.with_tests(members, tests, "k").join(catalogue.select("item_id", parts.packed().alias("code")), "item_id")
    got = {r["k"]: r["differences"] for r in parts.differences(rows, "k", rows.count(), looks, learned.UNKNOWN_PART, 20).collect()}
    named = lambda df: df.withColumn("look", F.col("item_id") % 20)
    want = {r["k"]: r["differences"] for r in learned.part_differences(tests, named(members.distinct()), named(catalogue), "k", "embedding", 4, looks).collect()}
    assert set(got) == set(want) == {k for k in held if k % 9}
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-6)


def test_mirrored_rows_are_not_made(spark):
    rows = spark.createDataFrame([([random.Random(i).gauss(0.3, 1), random.Random(-i - 1).gauss(0, 1)],) for i in range(200)], "x array<double>")
    both = rows.select("x", F.lit(1.0).alias("y")).union(rows.select(F.transform("x", lambda v: -v), F.lit(0.0)))
    want = fits.logistic(both, "x", "y", intercept=False).weights
    assert np.allclose(fits.logistic(rows.withColumn("y", F.lit(1.0)), "x", "y", intercept=False, mirrored=True).weights, want, atol=1e-9)
    with pytest.raises(ValueError, match="intercept"):
        fits.logistic(rows.withColumn("y", F.lit(1.0)), "x", "y", mirrored=True)


@pytest.mark.parametrize(("name", "joins"), [("pair_style", 1), ("outfit_score", 1), ("personal_style", 2)])
def test_no_row_takes_a_vector_along(spark, name, joins):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and sum("Join" in line for line in plan.splitlines()) == joins


def test_intruders_try_the_whole_catalogue(spark, dealt):
    """Against each item of the category by itself: kinds of one item and of many, clashes, unknown categories and names."""
    for seed, n in ((1, 90), (2, 700)):
        rng = random.Random(seed)
        of = lambda: (rng.choice(["top", "bottom", "shoes", "dress", "accessory", "hat", None]), rng.choice(["tie", "shorts", "jeans", "it's", "flip-flops", None]), rng.choice([None, "red", "green", "navy", "white", "gold"]), rng.choice([None, "solid", "floral"]), 1.0)  # noqa: B023, E731
        pool = {i: (i, *of()) for i in range(n)}
        held = {k: sorted(rng.sample(range(n), rng.randint(1, 5))) for k in range(150)}
        tests = [(k, t, f) for k, ids in held.items() if (t := rng.choice(ids)) is not None and (f := next((i for i in range(n) if i not in ids and pool[i][1] == pool[t][1]), None)) is not None]
        members = spark.createDataFrame([(k, *pool[i]) for k, ids in held.items() for i in ids], ITEM.replace("outfit_id", "k"))
        catalogue = spark.createDataFrame(list(pool.values()), ITEM.split(", ", 1)[1])
        tried = spark.createDataFrame(tests, "k long, true_id long, fake_id long")
        got = {r["k"]: r for r in insights.intruders(members, tried, catalogue, "k").collect()}
        kept = members.join(tried, "k").filter("item_id <> true_id").select(*members.columns)
        fakes = tried.select("k", F.col("fake_id").alias("item_id")).join(catalogue, "item_id").select(*members.columns)
        faked = outfits.as_sets(kept.unionByName(fakes), "k").join(tried, "k").withColumn("base", outfits.scored(F.col("items")))
        each = faked.crossJoin(catalogue.select(outfits.as_items().alias("_o")).agg(F.collect_list("_o").alias("all"))).withColumn("item", F.explode("items"))
        options = F.filter("all", lambda o: (o["category"] == F.col("item.category")) & (o["id"] != F.col("true_id")) & (o["id"] != F.col("item.id")))
        each = each.withColumn("top", F.array_max(outfits.fit_scores(F.filter("items", lambda i: i["id"] != F.col("item.id")), options)))
        gains = {}
        for r in each.select("k", "item.id", F.greatest(F.coalesce(F.round(F.col("top") - F.col("base"), 1), F.lit(0.0)), F.lit(0.0)).alias("gain")).collect():
            gains.setdefault(r["k"], []).append((-r["gain"], r["id"]))
        assert set(got) == {t[0] for t in tests} and any(min(g)[0] < 0 for g in gains.values())
        for k, _, fake in tests:
            assert (got[k]["weakest"], got[k]["fake_id"], got[k]["hit"], got[k]["chance"]) == (min(gains[k])[1], fake, min(gains[k])[1] == fake, 1 / len(gains[k]))


def test_worn_items_are_told_apart_without_a_sort(spark):
    rows, kinds = bind.worn(spark, SMALL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    named = [(r["outfit_id"], r["item_id"], bind.CATEGORIES[r["category"]]) for r in rows.collect()]
    assert sorted(named) == sorted(map(tuple, bind.wears(spark, SMALL).select("outfit_id", "item_id", "category").collect())) and kinds.columns == ["item_id", "category"]
