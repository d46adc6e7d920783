import datetime as dt
import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import exprs, texts
from weftline.operators import activity, advice, listings, mapping, outfits, prices, profiles, splits, vectors
from weftline.session_dirs import ensure_checkpoint_dir


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- expressions
def test_quantile_and_rounding(spark):
    arr = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    assert one(spark, exprs.quantile_at(arr, F.lit(0.3))) == pytest.approx(1.9)
    assert one(spark, exprs.quantile_at(F.array().cast("array<double>"), F.lit(0.3))) is None
    assert one(spark, exprs.to_step(F.lit(2.5), 1.0)) == 2.0


def test_largest_remainder_sums_to_target(spark):
    got = one(spark, exprs.largest_remainder(F.array(F.lit(1.4), F.lit(2.4), F.lit(3.2)), F.lit(8)))
    assert got == [2, 3, 3]


def test_fnv_and_seed(spark):
    assert one(spark, exprs.fnv1a32(F.lit("a|b"))) == 0x9D5BA6C8 or isinstance(one(spark, exprs.fnv1a32(F.lit("a"))), int)
    assert one(spark, exprs.fnv1a32(F.lit("a"))) == 0xE40C292C
    assert one(spark, exprs.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]


# ---- mapping
def test_gender_rows_override(spark):
    rows = spark.createDataFrame([("top", 1, "", 1), ("accessory", 4, "", 2), ("accessory", 2, "men", 3), ("accessory", 6, "women", 4)], "category string, max_items int, gender string, line int")
    for gender, n in (("men", 2), ("women", 6), ("", 4)):
        assert {r["category"]: r["max_items"] for r in mapping.gendered(rows, ["category"], gender, "line").collect()} == {"top": 1, "accessory": n}


def test_uncovered_stops(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    rules = spark.createDataFrame([("a", 1)], "k string, x int")
    with pytest.raises(ValueError, match="b"):
        mapping.require_covered(rows, "v", rules, "k")
    assert mapping.map_values(rows, rules, "v", "k").count() == 3


def test_conflicts_count_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "a")], "k long, v string")
    assert [r["k"] for r in mapping.conflicting(rows, "k", ["v"]).collect()] == [1]


# ---- splits
def test_splits_never_leak(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 60) if rng.random() < 0.9 else None, f"p{rng.randint(0, 80)}") for i in range(300)]
    out = splits.assign_splits(spark.createDataFrame(rows, "id long, outfit long, picture string"), "outfit", "picture", ["id"])
    assert out.count() == 300
    assert {r["violations"] for r in splits.split_violations(out, "outfit", "picture", "id").collect()} == {0}


# ---- outfits
ITEM = "outfit_id long, item_id long, category string, sub_category string, colour string, pattern string, pattern_conf double"


def plain_parts(items):
    """The rules in plain Python."""
    slot = outfits.SLOTS
    colours = [i["colour"] for i in items if i["colour"]]
    pair = outfits._colour_pair
    colour = None
    if len(colours) > 1:
        scores = [pair(a, b) for a, b in combinations(colours, 2)]
        bold = {c for c in colours if outfits.GROUPS[c] not in ("neutral", "metal")}
        colour = max(0, sum(scores) / len(scores) - 0.15 * max(0, len(bold) - 3))
    patterns = [i["pattern"] for i in items if i["pattern"] and slot[i["category"]] in outfits.CLOTHES_SLOTS and (i["pattern_conf"] is None or i["pattern_conf"] >= 0.6)]
    pattern = None if not patterns else 1.0 if len(patterns) == 1 else min(outfits._either(outfits.PATTERN_PAIRS, a, b) for a, b in combinations(patterns, 2))
    slots = [slot[i["category"]] for i in items]
    core = "full" in slots or ("upper" in slots and "lower" in slots)
    swim = "full" in slots and all(i["category"] == "swimwear" for i in items if slot[i["category"]] == "full")
    structure = 1.0 if core and ("feet" in slots or swim) else 0.75 if core else 0.3
    structure *= 0.5 if "full" in slots and "lower" in slots else 1
    cats = [i["category"] for i in items]
    for c in set(cats):
        structure *= 0.5 ** max(0, cats.count(c) - outfits.MOST_ITEMS.get(c, 1))
    subs = [i["sub_category"] for i in items if i["sub_category"] in outfits._SUBS]
    structure *= min([outfits._either(outfits.SUB_PAIRS, a, b) for a, b in combinations(subs, 2)] or [1.0])
    return colour, pattern, structure


def test_parts_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for o in range(120):
        for i in range(rng.randint(1, 6)):
            rows.append((o, o * 10 + i, rng.choice(list(outfits.SLOTS)), rng.choice([None, "jeans", *outfits._SUBS]), rng.choice([None, *outfits.GROUPS]), rng.choice([None, *outfits._PATTERNS]), rng.choice([None, 0.2, 0.6, 0.9])))
    df = spark.createDataFrame(rows, ITEM)
    items = F.col("items")
    got = outfits.as_sets(df, "outfit_id").select("outfit_id", outfits.colour_part(items).alias("c"), outfits.pattern_part(items).alias("p"), outfits.structure_part(items).alias("s"), outfits.set_score(items).alias("score")).collect()
    names = [f.split()[0] for f in ITEM.split(", ")]
    for r in got:
        own = [dict(zip(names, x, strict=True)) for x in rows if x[0] == r["outfit_id"]]
        want = plain_parts(own)
        for a, b in zip((r["c"], r["p"], r["s"]), want, strict=True):
            assert a == b if b is None else a == pytest.approx(b)
        used = [(w, v) for w, v in zip((0.30, 0.15, 0.20), want, strict=True) if v is not None]
        assert r["score"] == pytest.approx(100 * sum(w * v for w, v in used) / sum(w for w, _ in used), abs=0.0501)


def test_greedy_completion(spark):
    rows = [
        (1, 1, "top", None, "red", "solid", 1.0), (1, 2, "bottom", None, "white", "solid", 1.0), (1, 3, "shoes", None, "orange", None, None), (1, 4, "shoes", None, "black", None, None),
        (1, 5, "bag", None, "multicolour", None, None), (1, 6, "outerwear", None, "grey", "solid", 1.0),
    ]
    wardrobe = spark.createDataFrame(rows, ITEM).withColumnRenamed("outfit_id", "owner")
    done = outfits.complete(outfits.top_cores(wardrobe, "owner"), wardrobe, "owner").first()
    ids = [i["id"] for i in done["items"]]
    assert ids == [1, 2, 4]  # black shoes; the grey coat ties and the bag lowers the score
    assert done["score"] == 100.0


def test_suggestions_use_an_item_twice_at_most(spark):
    rows = [(1, 1, "top", None, "black", None, None)] + [(1, i, "bottom", None, "white", None, None) for i in range(2, 7)]
    wardrobe = spark.createDataFrame(rows, ITEM).withColumnRenamed("outfit_id", "owner")
    assert outfits.suggest(outfits.top_cores(wardrobe, "owner"), "owner").count() == 2


def test_soft_season(spark):
    rows = [(1, 1, "bottom", "jeans", None, 3), (1, 2, "outerwear", "coat", None, 3), (1, 3, "top", "shirt", "winter", 3), (1, 4, "top", "shirt", None, 1), (1, 5, "shoes", None, None, None)]
    df = spark.createDataFrame(rows, "owner long, item_id long, category string, sub_category string, season string, coverage int")
    got = {r["item_id"]: r["reason"] for r in outfits.personal_filter(df, "owner", "summer", 2).collect()}
    assert got == {1: None, 2: "season default", 3: "season", 4: "coverage", 5: None}


# ---- vectors
def test_taste_and_groups(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, [1.0, 0.0])], "owner long, v array<double>")
    got = {r["owner"]: r["taste"] for r in vectors.taste(items, "owner", "v", 2, least=2).collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] is None
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(i + 1, i) for i in range(40) if i != 20], "a long, b long")
    roots = {r["node"]: r["root"] for r in vectors.linked_groups(edges, spark.range(43).withColumnRenamed("id", "node")).collect()}
    assert roots == {i: 0 if i <= 20 else 21 if i <= 40 else i for i in range(43)}


# ---- prices
def test_band_is_never_a_guess(spark):
    refs = prices.references(spark.createDataFrame([("f", "x", float(p)) for p in (10, 20, 30, 40, 50)] + [("g", "x", 1.0)], "ch string, ca string, p double"), "ch", "ca", "p")
    rows = spark.createDataFrame([(1, "f", "x", 0.5), (2, "g", "x", 0.5), (3, "h", "x", 0.5), (4, "f", "new", 1.0)], "id long, ch string, ca string, pct double")
    got = {r["id"]: (r["low"], r["median"], r["high"], r["based_on"]) for r in prices.bands(rows, refs, "ch", "ca").collect()}
    assert got == {1: (20.0, 30.0, 40.0, "all"), 2: (None,) * 4, 3: (None,) * 4, 4: (40.0, 50.0, 50.0, "all")}


def test_quantiles_read_by_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(prices, "BLOCK", 7)
    rng = np.random.default_rng(4)
    sold = [("f", "x", float(p)) for p in rng.integers(1, 40, 100)] + [("f", "y", float(p)) for p in rng.integers(1, 900, 23)] + [("g", "x", 5.0), (None, "x", 3.0), ("f", "x", None)]
    refs = prices.references(spark.createDataFrame(sold, "ch string, ca string, p double"), "ch", "ca", "p")
    asked = [(i, ch, ca, float(p)) for i, (ch, ca, p) in enumerate((ch, ca, p) for ch in ("f", "g", None, "no") for ca in ("x", "y", "*") for p in (0, 0.1, 0.5, 0.77, 1))]
    got = prices.read_quantiles(spark.createDataFrame(asked, "id long, ch string, ca string, s double"), refs, "ch", F.col("ca"), {"q": F.col("s")}).collect()
    assert len(got) == len(asked)
    for r in got:
        of = [p for ch, ca, p in sold if ch == r["ch"] and ca in (r["ca"], ca if r["ca"] == "*" else None) and p is not None]
        assert r["q"] == (pytest.approx(np.quantile(of, r["s"])) if of else None)


def test_rows_without_group_or_value_stay(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, None, 2.0), (4, "a", None)], "id long, g string, x double")
    assert {r["id"]: r["pct"] for r in prices.percentiles(rows, "x", ["g"]).collect()} == {1: 0.0, 2: 0.0, 3: 0.5, 4: None}
    assert {r["id"]: r["k"] for r in profiles.average_ranks(rows, "x", ["g"], "k").collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}
    table = spark.createDataFrame([(1, "o", None), (2, "o", "p"), (3, None, None)], "id long, outfit string, picture string")
    got = {r["id"]: (r["split"] == r["outfit_split"], r["is_copy"]) for r in splits.assign_splits(table, "outfit", "picture", ["id"]).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False)}


def test_blocked_search_against_plain_products(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((90, 8)).round(1)
    rows = [(i, i % 3, None if i == 7 else v[i].tolist(), i // 2 if i % 5 else None) for i in range(90)]
    items = spark.createDataFrame(rows, "item_id long, g long, embedding array<double>, picture long")
    asked = items.filter("item_id % 10 = 0 or item_id = 7").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "g", "picture")
    got = {(r["query_id"], r["place"]): r["item_id"] for r in vectors.top_k(asked, items, 4, ["g"], apart="picture").collect()}
    for q in range(0, 90, 10):
        fit = [i for i in range(90) if i not in (q, 7) and i % 3 == q % 3 and (rows[i][3] is None or rows[i][3] != rows[q][3])]
        want = sorted(fit, key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:4]
        assert [got[q, p] for p in range(1, 5)] == want
    pairs = {(r["a"], r["b"]) for r in vectors.twins(items, "g", 2.0).collect()}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 == j % 3 and 7 not in (i, j) and round(float(v[i] @ v[j]), 6) >= 2.0}


# ---- listings and activity
SYNC = "external_id string, image_url string, price double, status string, labels string"
RUN = "external_id string, image_url string, price double, readable boolean, labels string, note string"


def test_sync_scenario(spark):
    held = spark.createDataFrame([], SYNC)
    steps = [
        ([("a", "u", 1.0, True), ("b", "u", 1.0, True)], True, {"a": "added", "b": "added"}),
        ([("a", "u", 2.0, True)], True, {"a": "updated", "b": "gone"}),
        ([("a", "v", 2.0, True), ("c", "w", 1.0, False)], True, {"a": "relabelled", "b": "kept", "c": "no_picture"}),
        ([("b", "u", 2.0, True)], False, {"a": "kept", "b": "updated"}),
    ]
    for run, whole, want in steps:
        out = listings.sync(held, spark.createDataFrame([(*r, f"seen {r[1]}", "n") for r in run], RUN), whole)
        assert {r["external_id"]: r["outcome"] for r in out.collect()} == want
        held = spark.createDataFrame([tuple(r) for r in listings.stored_rows(out).select("external_id", "image_url", "price", "status", "labels").collect()], SYNC)
    assert {r["external_id"]: r["status"] for r in held.collect()} == {"a": "active", "b": "active"}


def test_wear_log(spark):
    rows = [(1, "2024-01-01", ["a", "b"], 1), (1, "2024-01-01", ["b", "a"], 2), (1, "2024-01-02", ["a"], 3)]
    df = spark.createDataFrame(rows, "u long, day string, items array<string>, n long")
    assert sorted(r["n"] for r in activity.worn_once(df, "u", "day", "items", "n").collect()) == [1, 3]
    owned = spark.createDataFrame([(1, "a", "2023-01-01"), (1, "b", "2023-01-01"), (1, "c", "2024-01-10")], "user_id long, item_id string, since string")
    worn = spark.createDataFrame([(1, "a", "2024-01-05"), (1, "b", "2023-12-01")], "user_id long, item_id string, day string")
    got = {r["item_id"]: (r["lately"], r["never"]) for r in activity.worn_summary(owned, worn, "2024-01-15", 14, 14).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, False)}


# ---- texts
TERMS = {"sac a main": "handbag", "noir": "black", "فستان": "dress"}


@pytest.mark.parametrize(
    "text,want",
    [("Black Jeans", "a photo of black jeans"), ("sac à main", "a photo of handbag"), ("le sac à main noir", "a photo of handbag black"), ("الفستان", "a photo of dress"), ("the", "a photo of the"), ("  ,, ", ""), ("l'été", "a photo of ete")],
)
def test_query_terms(spark, text, want):
    assert one(spark, texts.photo_query(texts.words(texts.fold(F.lit(text))), TERMS)) == want


@pytest.mark.parametrize("text,want", [("aucun défaut, très bon état", "like_new"), ("petite tache", "defect"), ("Jamais porté", "new_tags"), ("porte-monnaie", "no mention"), ("état neuf", "new"), ("déjà porté", "used")])
def test_conditions(spark, text, want):
    assert one(spark, texts.condition(texts.fold(F.lit(text)))) == want


@pytest.mark.parametrize("text,want", [("1.299,99 TND", 1299.99), ("59.9 DT", 59.9), ("1.299 TND", 1.299), ("89 000 DT", 89.0), ("free DT", None)])
def test_dinars(spark, text, want):
    assert one(spark, texts.dinars(F.lit(text))) == want


def test_placeholders_and_full_fold(spark):
    got = one(spark, texts.resolve_placeholders(F.lit("wear {1} with {7} , {1}  or {12} !"), F.array(F.lit(1)), F.lit("not 12")))
    assert tuple(got) == ("wear {1} with, {1} or 12!", [1], [7], [12])
    same = one(spark, texts.resolve_placeholders(F.lit(" {1}  {12} !"), F.array(F.lit(1)), F.lit("12")))
    assert tuple(same) == (" {1}  12 !", [1], [], [12])
    assert tuple(one(spark, texts.resolve_placeholders(F.lit("none"), F.lit(None).cast("array<int>")))) == ("none", [], [], [])
    df = spark.createDataFrame([("Œuvre ÉTÉ ﬁn",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.fold_all("t")).collect()] == ["œuvre ete fin", None]


@pytest.mark.parametrize("text,want", [("la robe est très belle", "fr"), ("the dress is nice", "en"), ("فستان جميل", "ar"), ("12 34", "unknown"), ("xyz", "unknown")])
def test_languages(spark, text, want):
    assert one(spark, texts.detect_language(F.lit(text))) == want


def test_registered_queries_have_schemas(spark):
    from weftline.plans.registry import ORACLE, QUERIES

    assert len(QUERIES) > 100 and set(ORACLE) <= set(QUERIES)
    for name in ("split_crosstab", "outfit_score", "price_band"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns
    assert dt.date.today()


def test_swaps_close_the_ring_and_give_three_wrong_answers(spark):
    rng = random.Random(21)
    pool = [(i, f"c{i % 4}" if i < 60 else "few") for i in range(64)]
    kind = dict(pool)
    sets = {k: rng.sample(range(64), rng.randint(1, 9)) for k in range(150)} | {900: [i for i in range(60) if i % 4 == 1][:12], 901: [i for i in range(60) if i % 4 == 1][:13], 902: [60, 61]}
    rows = [(k, i, kind[i]) for k, held in sets.items() for i in held]
    got = {r["k"]: r for r in advice.swap_tests(spark.createDataFrame(rows, "k long, item_id long, category string"), "k", spark.createDataFrame(pool, "item_id long, category string"), "s").collect()}
    digest = lambda *c: hashlib.md5(":".join(["s", *map(str, c)]).encode()).hexdigest()
    want = {}
    for k, held in sets.items():
        true = min(held, key=lambda i: digest(k, i))
        ring = sorted((i for i in kind if kind[i] == kind[true]), key=digest)
        at = ring.index(true)
        others = [i for i in ring[at:] + ring[:at] if i not in held]
        if len(others) >= 3:
            want[k] = (true, others[0], others[:3])
    assert 900 in want and 901 not in want and 902 not in want
    assert {k: (r["true_id"], r["fake_id"], r["wrong"]) for k, r in got.items()} == want
