"""Cases of the rules: splits, swimwear, prices, problems, taste, filters, picks, colours, boosting, wardrobes and concepts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_insights import WARDROBE, item
from tests.test_operators import ITEM, one
from weftline.functions import texts
from weftline.functions.exprs import split_of
from weftline.operators import advice, boosting, calibration, colours, insights, outfits, splits, vectors


def split_by_hash(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", split_of(F.col("k")).alias("s")).collect()
    return {r["k"]: r["s"] for r in rows}


def plain_splits(rows, hashed, hashed_pictures):
    """The reference's rule for (id, outfit, picture, local, is_file), in plain Python."""
    rank = {"train": 0, "val": 1, "test": 2}
    ours = {o for _, o, _, local, _ in rows if local and o is not None}
    of = {o: "test" if o in ours else hashed[o] for _, o, *_ in rows if o is not None}
    used, seen, out = {}, set(), {}
    for _, o, p, *_ in rows:
        if o is not None:
            used.setdefault(p, set()).add(of[o])
    dirty = {o for _, o, p, *_ in rows if o is not None and len(used[p]) > 1}
    for i, o, p, local, is_file in rows:
        split = max(used[p], key=rank.get) if p in used else hashed_pictures[p]
        out[i] = (of.get(o), "test" if local else split, None if o is None else o not in dirty, is_file and p in seen)
        seen.add(p)
    return out


def test_splits_follow_the_rule(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(90)]), rng.randint(0, 1500), rng.random() < 0.02, rng.random() < 0.7) for i in range(400)]
    hashed = split_by_hash(spark, range(1501))
    df = spark.createDataFrame(rows, "id long, o long, p long, local boolean, file boolean")
    got = splits.assign_splits(df, "o", "p", ["id"], F.col("local"), F.col("file"))
    assert got.columns == ["o", "id", "p", "local", "file", "outfit_split", "split", "is_copy", "outfit_clean"]
    assert {r["id"]: (r["outfit_split"], r["split"], r["outfit_clean"], r["is_copy"]) for r in got.collect()} == plain_splits(rows, hashed, hashed)
    assert {r[2] for r in plain_splits(rows, hashed, hashed).values()} == {True, False, None}


def test_a_shared_picture_makes_both_outfits_dirty(spark):
    hashed = split_by_hash(spark, range(200))
    train, test = (next(k for k in hashed if hashed[k] == s) for s in ("train", "test"))
    rows = [(1, train, "p1"), (2, train, "p2"), (3, test, "p1"), (4, test, "p3")]
    got = splits.assign_splits(spark.createDataFrame(rows, "id long, o long, p string"), "o", "p", ["id"])
    assert {(r["o"], r["outfit_clean"]) for r in got.collect()} == {(train, False), (test, False)}


def test_checks_find_what_they_name(spark):
    shape = "id long, o long, p string, split string, outfit_split string, is_copy boolean, category string, local boolean"
    bad = [(1, 1, "a", "train", "test", False, "top", False), (1, 1, "a", "val", "val", True, "hat", True)]
    got = {r["check_name"]: r["violations"] for r in splits.split_violations(spark.createDataFrame(bad, shape), "o", "p", "id", "category", ["top"], F.col("local")).collect()}
    assert got == {"duplicate_ids": 1, "picture_in_two_splits": 1, "outfit_in_two_splits": 1, "unknown_split": 0, "test_outfit_outside_test": 1, "first_copy_marked": 0, "unknown_category": 1, "local_outside_test": 1, "local_outfit_outside_test": 1}


@pytest.mark.parametrize(("text", "want"), [("1.299,99 TND", 1299.99), ("59.900 TND", 59.9), ("1.299 TND", 1.299), ("59.9 DT", 59.9), ("29,9 dt", 29.9), ("TND", None), ("", None), (None, None), ("1 299,50 TND", 1.0)])
def test_dinars_by_the_rule(spark, text, want):
    assert one(spark, texts.dinars(F.lit(text).cast("string"))) == want


def test_other_currencies_stop_the_query(spark):
    with pytest.raises(Exception, match="29,99 EUR"):
        one(spark, texts.dinars(F.lit("29,99 EUR")))
    assert one(spark, texts.dinars(F.lit("29,99 EUR"), strict=False)) is None


# ---- swimwear
BEACH = [item(1, 1, "swimwear", "swimsuit"), item(1, 2, "top", "t-shirt"), item(1, 3, "bottom", "shorts"), item(1, 4, "shoes", "flip-flops"), item(1, 5, "shoes", "formal-shoes")]


def test_cores_of_every_day_and_of_the_beach(spark):
    owned = spark.createDataFrame(BEACH, WARDROBE)
    for swimwear, want in ((False, {(2, 3)}), (True, {(1,)}), (None, {(1,), (2, 3)})):
        done = outfits.complete(outfits.top_cores(owned, "owner", swimwear=swimwear), owned, "owner").collect()
        assert {tuple(i["id"] for i in r["items"][: 1 if r["items"][0]["id"] == 1 else 2]) for r in done} == want
        assert all(i["category"] != "shoes" for r in done for i in r["items"] if r["items"][0]["id"] == 1)


def test_insights_count_swimwear(spark):
    owned = spark.createDataFrame([BEACH[0], BEACH[3]], WARDROBE)
    r = insights.insights(owned, "owner").first()
    assert r["good_outfits"] == 1 and r["versatile"] == [1] and r["unmatched"] == []


# ---- problems and taste
def problems_of(spark, *rows):
    told = outfits.as_sets(spark.createDataFrame(list(rows), ITEM), "outfit_id").select("outfit_id", insights.problems(F.col("items")).alias("p"))
    return told.first()["p"]


def test_problems_name_their_pieces(spark):
    got = problems_of(spark, item(1, 1, "top", "t-shirt", "red", "striped", 1.0), item(1, 2, "bottom", "jeans", "orange", "floral", 1.0))
    assert got == ["colour_clash:red:orange", "pattern_clash:striped:floral", "structure_no_shoes"]
    assert problems_of(spark, item(1, 1, "top", "t-shirt", "black")) == ["structure_incomplete:top_or_bottom"]
    assert problems_of(spark, item(1, 1, "shoes", "sneakers"), item(1, 2, "shoes", "heels")) == ["structure_incomplete:main_piece", "structure_over_limit:shoes:2"]
    many = [item(1, i, "accessory", None, c) for i, c in enumerate(("red", "green", "blue", "purple"))]
    assert problems_of(spark, item(1, 9, "dress"), item(1, 8, "bottom"), *many)[1:] == ["colour_too_bold:blue,green,purple,red", "structure_no_shoes", "structure_full_and_bottom"]
    assert problems_of(spark, item(1, 1, "top", "blazer"), item(1, 2, "bottom", "track-pants"), item(1, 3, "shoes")) == ["structure_pair:blazer:track-pants"]
    styled = spark.range(1).select(insights.problems(F.array().cast(outfits.as_sets(spark.createDataFrame([item(1, 1, "bag")], ITEM), "outfit_id").schema["items"].dataType), F.lit(0.2), F.lit(0.1)).alias("p")).first()["p"]
    assert styled == ["style_unlike_you", "style_mixed", "structure_incomplete:main_piece"]


def test_personal_style_mixes_in_the_taste(spark):
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    vecs = {i: unit(rng.normal(size=4) + 1) for i in range(6)}
    taste = unit(rng.normal(size=4) + 1)
    rows = [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 3), ("s2", 4), ("s3", 5)]
    df = spark.createDataFrame([(k, [float(x) for x in vecs[i]]) for k, i in rows] + [("s1", None)], "k string, v array<double>")
    owners, tastes = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 1)], "k string, owner long"), spark.createDataFrame([(1, taste.tolist())], "owner long, taste array<double>")
    got = {r["k"]: r for r in outfits.personal_style(df, "k", "v", 4, owners, tastes, "owner").collect()}
    scale = lambda x: min(max((x - outfits.STYLE_LOW) / (outfits.STYLE_HIGH - outfits.STYLE_LOW), 0), 1)
    together = scale(np.mean([vecs[a] @ vecs[b] for a, b in ((0, 1), (0, 2), (1, 2))]))
    fit = scale(np.mean([vecs[i] @ taste for i in range(3)]))
    assert got["s1"]["style"] == pytest.approx(0.75 * together + 0.25 * fit) and got["s1"]["user_fit"] == pytest.approx(fit)
    assert got["s2"]["style"] == pytest.approx(scale(vecs[3] @ vecs[4])) and got["s2"]["user_fit"] is None
    assert got["s3"]["style"] is None
    near = one(spark, insights.taste_similarity(F.array(*[F.array(*[F.lit(float(x)) for x in vecs[i]]) for i in (0, 1)], F.lit(None).cast("array<double>")), F.array(*[F.lit(float(x)) for x in taste]), 4))
    assert near == pytest.approx(float(unit(vecs[0] + vecs[1]) @ taste), abs=1e-8)


# ---- suggestions, filters, picks
def test_disliked_outfits_are_passed_over(spark):
    rows = [item(1, n, c) for n, c in enumerate(("top", "top", "bottom", "bottom"))]
    cores = outfits.top_cores(spark.createDataFrame(rows, WARDROBE), "owner")
    assert {r["outfit_key"] for r in outfits.suggest(cores, "owner").collect()} == {"0|2", "0|3", "1|2", "1|3"}
    disliked = spark.createDataFrame([(1, "0|2"), (2, "1|3")], "owner long, outfit_key string")
    assert {r["outfit_key"] for r in outfits.suggest(cores, "owner", disliked=disliked).collect()} == {"0|3", "1|2", "1|3"}


def test_own_occasions_and_seasons(spark):
    shape = "owner long, item_id long, category string, sub_category string, season array<string>, usage array<string>, coverage int"
    rows = [
        (1, 1, "top", None, None, ["party"], 3), (1, 2, "top", None, ["winter"], ["work"], 3), (1, 3, "top", None, ["summer", "winter"], None, 1), (1, 4, "bottom", "jeans", [], [], None),
        (1, 5, "outerwear", None, None, ["work"], 3), (1, 6, "shoes", None, ["summer"], ["work", "party"], 3), (2, 7, "bottom", "jeans", None, None, 3), (2, 8, "bottom", "shorts", None, None, 3),
    ]
    df = spark.createDataFrame(rows, shape)
    got = {r["item_id"]: r["reason"] for r in outfits.personal_filter(df, "owner", "summer", 2, "work").collect()}
    assert got == {1: "occasion", 2: "season", 3: "coverage", 4: None, 5: "season default", 6: None, 7: "season default", 8: None}
    assert {r["reason"] for r in outfits.personal_filter(df, "owner", None, None).collect()} == {None}


def test_picks_leave_out_what_was_shown(spark):
    rows = [(1, f"k{i}", 100.0 - i, label, [i]) for i, label in enumerate(("safe", "bolder", "experimental", "safe"))]
    made = spark.createDataFrame(rows, "owner long, outfit_key string, score double, label string, ids array<long>")
    made = made.select("owner", "outfit_key", "score", "label", F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("items"))
    shown = spark.createDataFrame([(1, "k0")], "owner long, outfit_key string")
    assert {r["outfit_key"] for r in advice.pick_three(made, "owner", "s", shown=shown).collect()} == {"k1", "k2", "k3"}
    skipping = made.withColumn("skip", F.array(F.lit("safe"), F.lit("bolder")))
    got = advice.pick_three(skipping, "owner", "s", skip="skip").orderBy("place").collect()
    assert got[0]["label"] == "experimental" and {r["outfit_key"] for r in got[1:]} == {"k0", "k1"}
    bare = advice.pick_three(made.withColumn("label", F.lit(None).cast("string")), "owner", "s", n=2).collect()
    assert len({r["outfit_key"] for r in bare}) == 2 and {r["label"] for r in bare} == {None}


def test_clashes_leave_notes(spark):
    worn = outfits.as_sets(spark.createDataFrame([item(1, 1, "top", "shirt"), item(1, 2, "bottom"), item(1, 3, "top", "shirt"), item(1, 4, "top", "tee"), *[item(1, 10 + i, "accessory") for i in range(5)]], WARDROBE), "owner")
    r = worn.select(advice.resolved_with_notes(F.col("items")).alias("r")).first()["r"]
    assert [i["id"] for i in r["kept"]] == [2, 4, 11, 12, 13, 14]
    assert [tuple(n) for n in r["notes"]] == [(1, 3), (3, 4), (10, 14)]


def test_pairing_gap(spark):
    rows = [("top", 0, False, []), ("bottom", 0, False, []), ("shoes", 0, False, ["shoes", "top"]), ("bag", None, None, None), ("top", 3, False, ["bottom"]), ("top", 0, True, [])]
    df = spark.createDataFrame(rows, "c string, n int, h boolean, m array<string>")
    got = [r["g"] for r in df.select(advice.pairing_gap(F.col("c"), F.col("n"), F.col("h"), F.col("m")).alias("g")).collect()]
    assert got == ["bottom", "top", "top", "main", None, None]


def test_weakest_piece(spark):
    df = spark.createDataFrame([("a", 1, 7, 3.0), ("a", 2, 8, 3.0), ("b", 3, None, 0.0), ("c", 4, 9, 1.5)], "k string, item_id long, best_swap long, gain double")
    assert {r["k"]: r["item_id"] for r in outfits.weakest(df, "k", 2.0).collect()} == {"a": 1}
    assert {r["k"]: r["item_id"] for r in outfits.weakest(df, "k", None).collect()} == {"a": 1, "b": 3, "c": 4}


# ---- colours
def test_colour_features_are_numpys(spark):
    rng = np.random.default_rng(4)
    pictures = {1: rng.integers(0, 256, (500, 3)), 2: np.array([[255, 255, 255]] * 3 + [[0, 0, 0]]), 3: np.array([[0, 0, 255]])}
    rows = [(k, [tuple(int(c) for c in p) for p in px]) for k, px in pictures.items()] + [(4, []), (5, None)]
    df = spark.createDataFrame(rows, "id long, px array<struct<r:int,g:int,b:int>>").withColumn("cells", F.lit("mine"))
    got = {r["id"]: r for r in colours.colour_features(df, "px").withColumn("all", F.when(F.col("cells").isNotNull(), colours.dense(F.col("cells")))).collect()}
    for k, px in pictures.items():
        lab = colours.lab_of_pixels(px.astype(float))
        hist, _ = np.histogramdd(lab, bins=(np.linspace(0, 100, 7), np.linspace(-80, 80, 7), np.linspace(-80, 80, 7)))
        r = got[k]
        assert r["all"] == pytest.approx((hist.ravel() / len(lab)).tolist()) and r["n_pixels"] == len(px)
        assert r["percentiles"] == pytest.approx(np.percentile(lab, [10, 25, 50, 75, 90], axis=0).ravel().tolist())
        assert r["means"] == pytest.approx(lab.mean(0).tolist()) and r["deviations"] == pytest.approx(lab.std(0).tolist(), abs=1e-9)
    assert sum(c["share"] for c in got[3]["cells"]) == 0  # pure blue lies beyond the axis
    assert got[4]["cells"] is None and got[5]["n_pixels"] is None


# ---- boosting
def test_boosting_tells_what_trees_can(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0, "same", np.where(x[:, 2] > 0.5, "far", "near"))
    rows = [(i, [float(v) for v in x[i]], str(y[i])) for i in range(600)] + [(600, None, "same"), (601, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y string").repartition(3)
    model = boosting.fit(df.filter("id < 400 or id >= 600"), "x", "y", rounds=8, depth=3, rate=0.5, bins=16)
    assert model.classes == ["far", "near", "same"]
    told = df.withColumn("p", boosting.chances(F.col("x"), model)).withColumn("top", boosting.top(F.col("p"), model.classes, 2)).collect()
    right = [r["top"][0]["value"] == r["y"] for r in told if 400 <= r["id"] < 600]
    assert np.mean(right) > 0.85
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["top"]) == 2 and r["top"][0]["conf"] >= r["top"][1]["conf"] for r in told if r["x"])
    assert next(r for r in told if r["id"] == 600)["p"] is None
    again = boosting.fit(df.filter("id < 400").repartition(1), "x", "y", rounds=2, depth=2, rate=0.5, bins=16)
    more = boosting.fit(df.filter("id < 400").repartition(7), "x", "y", rounds=2, depth=2, rate=0.5, bins=16)
    for a, b in zip(again.rounds, more.rounds, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.allclose(a[2], b[2])
    with pytest.raises(ValueError, match="two at least"):
        boosting.fit(df.filter("y = 'same'"), "x", "y")


# ---- wardrobes
def pool_of(spark, rng, n):
    rows = [(i, rng.choice(["shirt", "skirt", "coat"]), rng.choice(["red", "blue", "rare"]) if i % 40 else "lone", [rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (900, None, "red", [1.0, 0.0, 0.0]), (901, "coat", "red", None)], "item_id long, kind string, colour string, embedding array<double>")


def test_wardrobes_are_drawn_whole_and_alike(spark):
    rows, pool = pool_of(spark, random.Random(3), 300)
    label = {r[0]: f"{r[2]} {r[1]}" for r in rows}
    queries = spark.range(200).withColumnRenamed("id", "query")
    got = calibration.wardrobes(pool, queries, 20, "s").collect()
    by = {}
    for r in got:
        by.setdefault(r["query"], []).append(r)
    sizes, counts = Counter(label.values()), Counter()
    assert len(by) == 200
    for q, pieces in by.items():
        ids = [p["piece"] for p in pieces]
        assert len(ids) == len(set(ids)) == 20 and 900 not in ids and 901 not in ids
        asked = pieces[0]["asked"]
        assert sizes[asked] >= calibration.LEAST_PIECES
        right = [p for p in pieces if p["right"]]
        assert {p["piece"] for p in right} == {i for i in ids if label[i] == asked} and len(right) <= min(3, sizes[asked] - 1)
        counts[len(right)] += 1
    assert 30 < counts[0] < 90 and counts[1] and counts[2] and counts[3]
    assert sorted(map(tuple, got)) == sorted(map(tuple, calibration.wardrobes(pool.repartition(7), queries, 20, "s").collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, calibration.wardrobes(pool, queries, 20, "t").collect()))
    assert calibration.wardrobes(pool, queries, 400, "s").count() == 0


def test_the_cut_is_the_lowest_that_is_right_often_enough(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() < 0.7, round(rng.random(), 6)) for i in range(300)]
    rows = [(i, has, s, has and rng.random() < s, has and rng.random() < 0.9) for i, has, s in rows]
    found = spark.createDataFrame(rows, "query long, has_right boolean, top1_sim double, top1_right boolean, top5_right boolean")

    def plain(target, least=30):
        best = None
        for t in range(int(min(r[2] for r in rows) * 1000), 1001):
            shown = [r for r in rows if r[2] >= t / 1000]
            if len(shown) < least:
                break
            p = sum(r[3] for r in shown) / len(shown)
            if p >= target:
                return t / 1000, True
            if best is None or p > best[0]:
                best = (p, t / 1000)
        return best[1], False

    for target in (0.3, 0.6, 0.99):
        cut = calibration.chosen_cut(found, target)
        assert tuple(cut.first()) == plain(target)
        m = calibration.measured(found, cut).first()
        shown = [r for r in rows if r[2] >= m["cut"]]
        assert m["n_queries"] == 300 and m["precision"] == pytest.approx(np.mean([r[3] for r in shown]))
        assert m["top5_hit_rate"] == pytest.approx(np.mean([r[4] for r in rows if r[1]])) and m["honest_nothing_rate"] == pytest.approx(np.mean([r[2] < m["cut"] for r in rows if not r[1]]))
    assert calibration.chosen_cut(found.limit(5), 0.5).count() == 0


# ---- concepts
def test_concepts_in_common_or_in_contrast(spark):
    axes = [[float(i == j) for j in range(6)] for i in range(6)]
    concepts = spark.createDataFrame(list(enumerate(axes)), "concept long, c array<double>")
    base = concepts.select("concept", F.lit(0.0).alias("base"))
    rows = [(1, [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]), (2, [5.0, 6.0, 1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (4, None)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {(r["a"], r["b"]): (r["both"], r["contrast"] and tuple(r["contrast"])) for r in vectors.concept_overlap(pairs, items, concepts, base).collect()}
    assert got == {(1, 2): ([0, 1], None), (1, 3): ([], (0, 5)), (1, 4): ([], None)}
    with pytest.raises(ValueError, match="broadcast"):
        vectors.concept_overlap(pairs, items, concepts, base, most=5)


# ---- many sets at once
def test_batched_scores_are_the_expressions(spark):
    rng = random.Random(12)
    pick = lambda values: rng.choice([None, *values])
    rows = [
        item(o, o * 10 + i, rng.choice([*outfits.SLOTS]), pick(outfits._SUBS), pick(outfits.GROUPS), pick(outfits._PATTERNS), rng.choice([None, 0.2, 0.9]))
        for o in range(150) for i in range(rng.randint(1, 7))
    ]
    sets = outfits.as_sets(spark.createDataFrame(rows, ITEM), "outfit_id").withColumn("style", F.when(F.col("outfit_id") % 3 > 0, F.col("outfit_id") / 200))
    told = sets.select(outfits.set_score(F.col("items"), F.col("style")).alias("a"), outfits.scored(F.col("items"), F.col("style")).alias("b"), outfits.set_score(F.col("items")).alias("c"), outfits.scored(F.col("items")).alias("d")).collect()
    assert all((r["a"], r["c"]) == (r["b"], r["d"]) for r in told)
    trials = sets.withColumns({"held": F.slice("items", 1, 2), "more": F.when(F.col("outfit_id") % 5 > 0, F.slice("items", 3, 9))})
    want = F.transform("more", lambda o: outfits.set_score(F.concat("held", F.array(o))))
    for r in trials.select(want.alias("w"), outfits.trial_scores(F.col("held"), F.col("more")).alias("g")).collect():
        assert r["w"] == r["g"]
