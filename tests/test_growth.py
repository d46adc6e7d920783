"""Results to the last bit, and work that grows no faster than its input."""

import os
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from weftline import session
from weftline.functions import texts
from weftline.functions.exprs import largest_remainder, largest_remainders
from weftline.operators import advice, insights, learned, outfits
from weftline.plans.bind import CATEGORIES, COLOURS, PATTERNS, SUB_CATEGORIES, wears
from weftline.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.01"


def _sql(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    return con.execute(ORACLE[name])


def test_colour_features_keep_the_sign_of_zero(spark, tmp_path):
    # a percentile of this part is -0.00003, which SQL rounds to -0.0
    spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").filter("l_partkey = 14229").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = lambda rows: [repr([x if not isinstance(x, list) else [float(y) for y in x] for x in r]) for r in rows]
    got = plain([list(r) for r in QUERIES["colour_features"](spark, str(tmp_path)).collect()])
    assert got == plain([list(r) for r in _sql("colour_features", str(tmp_path)).fetchall()])
    assert "-0.0" in got[0]


def _wears(spark, n=400):
    rng = random.Random(7)
    maybe = lambda names: rng.choice([*names, None])
    kinds = [(i, rng.choice((*CATEGORIES, "hat")), maybe(SUB_CATEGORIES), maybe(COLOURS), maybe(PATTERNS), rng.random()) for i in range(200)]
    rows = [(k, *kinds[i]) for k in range(n) for i in rng.sample(range(200), rng.choice((1, 2, 4, 7, 30)))]
    return spark.createDataFrame(rows, "owner long, item_id long, category string, sub_category string, colour string, pattern string, pattern_conf double")


def test_batched_parts_are_the_expressions(spark):
    sets = outfits.as_sets(_wears(spark), "owner")
    items = F.col("items")
    told = sets.select(outfits.parts_of(items).alias("p"), *[f(items).alias(n) for n, f in (("c", outfits.colour_part), ("q", outfits.pattern_part), ("s", outfits.structure_part), ("x", outfits.set_score))]).collect()
    for r in told:
        assert tuple(r["p"]) == (r["c"], r["q"], r["s"], r["x"])
    assert {None} < {r["c"] for r in told} and {None} < {r["q"] for r in told}


def _built_plainly(chosen, held):
    """insights.build() of one owner by the expressions' own scores, told in plain Python over outfits._scores_of for one set at a time."""
    def score(items):
        codes = {c: np.array([[i[c] if i[c] is not None else -1 for i in items]]) for c in ("c", "k", "p", "u")}
        return float(outfits._scores_of(codes)[0])

    def clash(items):
        subs, cats = [i["sub_category"] for i in items if i["sub_category"]], [i["category"] for i in items]
        return len(set(subs)) < len(subs) or any(cats.count(c) > outfits.MOST_ITEMS.get(c, 1) for c in cats)

    def options(items):
        fits = [o for o in held if o["id"] not in {i["id"] for i in items} and not clash([*items, o])]
        return sorted(((-score([*items, o]), o["id"], o) for o in fits), key=lambda x: x[:2])

    def complete(items):
        slots = {i["slot"] for i in items}
        return ("full" in slots or {"upper", "lower"} <= slots) and ("feet" in slots or any(i["category"] == "swimwear" for i in items))

    out = []
    for low, first, item in options(chosen)[: insights.FIRST_ADDITIONS]:
        items = [*chosen, item]
        for _ in range(insights.MOST_ADDITIONS - 1):
            more = [] if complete(items) else options(items)
            if not more:
                break
            low, _, item = more[0]
            items.append(item)
        out.append((first, tuple(i["id"] for i in items), -low))
    return sorted(out)


def test_outfits_are_built_within_an_owners_row(spark):
    owned = _wears(spark, 60)
    chosen = owned.groupBy("owner").agg(F.array(F.min_by(outfits.as_items(), F.col("item_id"))).alias("items"))
    built = insights.build(chosen, owned, "owner")
    got = {}
    for r in built.collect():
        got.setdefault(r["owner"], []).append((r["first"], tuple(i["id"] for i in r["items"]), r["score"]))
    held = {r["owner"]: r["items"] for r in outfits.as_sets(owned, "owner").collect()}
    want = {o: _built_plainly(i[:1], i) for o, i in held.items()}
    assert {o: sorted(v) for o, v in got.items()} == {o: v for o, v in want.items() if v}


def test_largest_remainders_of_columns(spark):
    rng = random.Random(1)
    rows = [[rng.choice((rng.random() * 9, 1.5, 2.25, 3.0)) for _ in range(3)] for _ in range(300)]
    df = spark.createDataFrame([(*r, float(round(sum(r)))) for r in rows], "a double, b double, c double, t double")
    told = df.select(F.array(*largest_remainders([F.col(c) for c in "abc"], F.col("t"))).alias("x"), largest_remainder(F.array("a", "b", "c"), F.col("t")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in told)


def test_outfits_are_dealt_by_outfit_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5000)
    assert wears(spark, SMALL).rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 5000)
    for name in ("repeat_category_share", "contributions"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(outfit_id" in plan and plan.count("hashpartitioning(outfit_id") == 1


def test_a_swapped_sets_style_is_told_by_sums(spark):
    rng = np.random.default_rng(5)
    looks = {v: rng.normal(size=4) / 2 for v in range(20)}
    owned = _wears(spark, 40).withColumnRenamed("owner", "k")
    pool = owned.drop("k").dropDuplicates(["item_id"])
    held = {}
    for r in owned.select("k", "item_id").collect():
        held.setdefault(r["k"], []).append(r["item_id"])
    known = [r["item_id"] for r in pool.collect()]
    pairs = [(k, ids[0], next(i for i in known if i not in ids)) for k, ids in held.items()]
    tests = spark.createDataFrame(pairs, "k long, true_id long, fake_id long")
    table = spark.createDataFrame([(v, [float(x) for x in x4]) for v, x4 in looks.items()], "look long, embedding array<double>")
    named = lambda df: df.withColumn("look", F.when(F.col("item_id") % 23 < 20, F.col("item_id") % 23))
    late = learned.part_differences(tests, named(owned), named(pool), "k", "embedding", 4, table).collect()
    early = lambda df: named(df).join(table, "look", "left").drop("look")
    got = {r["k"]: r["differences"] for r in late}
    for r in learned.part_differences(tests, early(owned), early(pool), "k", "embedding", 4).collect():
        assert np.allclose(r["differences"], got[r["k"]], atol=1e-12)
    whole = owned.withColumn("_real", F.lit(1)).join(tests, "k").cache()
    kept = whole.filter("item_id <> true_id").select(*owned.columns)
    fakes = tests.select("k", F.col("fake_id").alias("item_id")).join(pool, "item_id").select(*owned.columns)
    sides = []
    for rows in (owned, kept.unionByName(fakes)):
        sets = outfits.as_sets(rows, "k").join(outfits.coherence(early(rows), "k", "embedding", 4), "k", "left")
        told = sets.select("k", "style", outfits.colour_part(F.col("items")), outfits.pattern_part(F.col("items")), outfits.structure_part(F.col("items"))).collect()
        sides.append({r[0]: np.array([0.5 if x is None else x for x in r[1:]]) for r in told})
    assert len(got) == len(held)
    for k in held:
        assert np.allclose(got[k], sides[0][k] - sides[1][k], atol=1e-9)
    plan = learned.part_differences(tests, named(owned), named(pool), "k", "embedding", 4, F.broadcast(table))._jdf.queryExecution().executedPlan().toString()
    assert all("embedding" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) and plan.count("Union") == 0


def test_swap_tests_meet_rows_of_their_ring(spark):
    pool = spark.createDataFrame([(i, "a") for i in range(200)], "item_id long, category string")
    members = spark.createDataFrame([(k, i, "a") for k in range(30) for i in range(k, k + 4)], "k long, item_id long, category string")
    told = advice.swap_tests(members, "k", pool, "s")
    assert told.count() == 30
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "_ring" in plan and "Window" not in plan.split("_held")[0]


def test_splits_shuffle_whole_rows_twice_and_checks_pass_once(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 5000)
    n = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 5000)
    plan = QUERIES["split_pictures"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f", {n}" in line for line in plan.splitlines() if "RepartitionByExpression" in line) and "RepartitionByExpression" in plan
    checks = QUERIES["split_checks"](spark, SMALL)
    assert checks._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 2 * plan.count("Window")
    assert "Union" not in checks._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert sorted(map(tuple, checks.collect())) == sorted(_sql("split_checks", SMALL).fetchall())


def test_conditions_are_graded_as_without_their_plain_parts(spark):
    said = [
        "defauts", "taches", "troue", "dechires", "decolore", "delave", "abimes", "reprise", "egratinure", "rayures", "sans aucun defaut", "pas de petites taches", "0 rayure, porte", "avec etiquette", "avec l'etiquettes", "jamais mises",
        "never worn", "with tags", "sous emballage", "dans sa boite", "dans son emballage", "avec son packaging", "comme neuves", "presque neufs", "quasi neuve", "tres bonne etat", "excellent etat", "etat impeccable", "porte une seule fois", "mis deux fois",
        "utilises 2 fois", "tres peu porte", "trop peux utilise", "peu utilise", "a peine porte", "portes 2 ou 3", "utilise deux ou trois", "etat neuf", "neufs", "brand new", "jdida", "جديد", "bon etat", "bonne etat", "ndhifa", "نظيف",
        "porte", "utilisees", "porte-cles", "porte monnaie use", "usees", "use", "mest3mel", "msta3mel", "مستعمل", "used", "usage", "house", "because", "porte a la main", "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in [*said, *[f"{a} {b}" for a in said[:-1] for b in said[:-1]]]], "text string").union(spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(300))
    folded = rows.select(texts.fold(F.col("text")).alias("t"))
    told = F.regexp_replace(F.regexp_replace("t", texts.DENIED, " "), texts.NOT_WORN, " ")
    plain = F.lit("no mention")
    for name, pattern in reversed(texts.CONDITIONS):
        plain = F.when(told.rlike(pattern), name).otherwise(plain)
    got = folded.select("t", texts.graded(texts.undenied(F.col("t"))).alias("a"), plain.alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and {r["a"] for r in got} == {"no mention", *texts.CONDITION_PARTS}
