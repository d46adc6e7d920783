import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import ITEM, plain_parts
from weftline.functions import texts
from weftline.functions.vectors16 import packed16, unpacked16
from weftline.operators import insights, outfits, profiles
from weftline.sources import shops

FIELDS = [f.split()[0] for f in ITEM.split(", ")]
WARDROBE = ITEM.replace("outfit_id", "owner")


def plain_score(items):
    used = [(w, v) for w, v in zip((0.30, 0.15, 0.20), plain_parts(items), strict=True) if v is not None]
    return round(round(100 * sum(w * v for w, v in used) / sum(w for w, _ in used), 9), 1)


def item(owner, number, category, sub=None, colour=None, pattern=None, conf=None):
    return (owner, number, category, sub, colour, pattern, conf)


def named(rows):
    return [dict(zip(FIELDS, r, strict=True)) for r in rows]


def test_insights_of_small_and_lacking_wardrobes(spark):
    rows = [
        item(1, 1, "top", None, "white", "solid", 1.0), item(1, 2, "bottom", None, "navy", "solid", 1.0), item(1, 3, "shoes", None, "black"), item(1, 4, "bottom", "track-pants", "orange", "checked", 1.0),
        item(2, 5, "top"), item(3, 6, "bottom"), item(3, 7, "shoes"), item(4, 8, "bag"), item(5, 9, "top"),
    ]
    told = insights.insights(spark.createDataFrame(rows, WARDROBE), "owner", F.col("item_id") == 9)
    got = {r["owner"]: r for r in told.collect()}
    assert got[1]["good_outfits"] >= 1 and 1 in got[1]["versatile"] and got[1]["complete"] and got[1]["missing"] == []
    assert (got[1]["new_tops"], got[1]["new_bottoms"]) == (2, 1)
    assert got[2]["missing"] == ["bottom", "shoes"] and got[2]["unmatched"] == [5]
    assert got[3]["missing"] == ["top"] and got[4]["missing"] == ["main", "shoes"]
    assert got[5]["hidden"] == [9] and got[5]["missing"] == ["main", "shoes"] and got[5]["good_outfits"] == 0
    assert insights.insights(spark.createDataFrame([], WARDROBE), "owner").count() == 0


def test_strengths_and_reasons(spark):
    rows = [item(1, 1, "top", None, "navy", "floral", 1.0), item(1, 2, "bottom", None, "white", "solid", 1.0), item(1, 3, "shoes"), item(2, 4, "top", None, "red"), item(2, 5, "bottom", None, "green"), item(3, 6, "bag")]
    sets = outfits.as_sets(spark.createDataFrame(rows, ITEM), "outfit_id")
    got = {r[0]: r[1] for r in sets.select("outfit_id", insights.strengths(F.col("items"), F.lit(0.7))).collect()}
    assert got == {1: ["style_coherent", "colour_pair:navy:white", "pattern_one_bold:floral", "structure_complete"], 2: ["style_coherent"], 3: ["style_coherent"]}
    reasons = insights.part_reasons({"style": F.lit(None).cast("double"), "colour": F.lit(0.5), "pattern": F.lit(1.0), "structure": F.lit(1.0)}, {**outfits.WEIGHTS, "pattern": 0.0})
    assert [(r["part"], r["why_not"]) for r in spark.range(1).select(reasons.alias("r")).first()["r"]] == [("style", "no_vectors"), ("colour", None), ("pattern", "weight_zero"), ("structure", None)]


def test_labels_and_confidence(spark):
    rows = [(1, k, s) for k, s in (("a", 0.95), ("b", 0.95), ("c", 0.94), ("d", None))] + [(2, "e", 0.9), (2, "f", 0.5), (3, "g", None)]
    got = {r["k"]: r["label"] for r in insights.shown_labels(spark.createDataFrame(rows, "owner long, k string, s double"), "owner", "k", "s").collect()}
    assert got == {"a": "safe", "b": "bolder", "c": "experimental", "d": None, "e": "safe", "f": "experimental", "g": None}
    members = spark.createDataFrame([(1, 1, 9, ["colour"], None), (1, 2, 9, None, None), (2, 3, 4, ["colour", "pattern"], ["colour"]), (3, 4, 9, [], [])], "o long, item_id long, usable long, unsure array<string>, corrected array<string>")
    told = {r["o"]: (r["reasons"], r["confidence"]) for r in insights.confidence(members, "o", "usable", "unsure", "corrected").collect()}
    assert told == {1: (["guessed_field:1:colour"], "medium"), 2: (["small_wardrobe", "guessed_field:3:pattern"], "low"), 3: ([], "high")}


def test_intruders_against_plain_python(spark):
    rng = random.Random(11)
    pieces = [item(0, n, rng.choice(["top", "bottom", "shoes", "bag"]), None, rng.choice([None, *outfits.GROUPS]), rng.choice([None, *outfits._PATTERNS]), 1.0) for n in range(60)]
    by_id = {p["item_id"]: p for p in named(pieces)}
    members, tests = [], []
    for o in range(20):
        ids = []
        for c in ("top", "bottom", "shoes"):
            ids.append(rng.choice([i for i in by_id if by_id[i]["category"] == c]))
        true = rng.choice(ids)
        fake = rng.choice([i for i in by_id if by_id[i]["category"] == by_id[true]["category"] and i not in ids])
        members += [(o, *pieces[i][1:]) for i in ids]
        tests.append((o, true, fake))
    catalogue = spark.createDataFrame(pieces, ITEM).drop("outfit_id")
    got = {r["outfit_id"]: r["weakest"] for r in insights.intruders(spark.createDataFrame(members, ITEM), spark.createDataFrame(tests, "outfit_id long, true_id long, fake_id long"), catalogue, "outfit_id", "s").collect()}
    for o, true, fake in tests:
        ids = sorted([m[1] for m in members if m[0] == o and m[1] != true] + [fake])
        base, gains = plain_score([by_id[i] for i in ids]), {}
        for i in ids:
            others = [j for j in by_id if by_id[j]["category"] == by_id[i]["category"] and j not in ids and j != true]
            gains[i] = max([0.0] + [round(plain_score([by_id[x] for x in ids if x != i] + [by_id[j]]) - base, 1) for j in others])
        best = max(gains.values())
        assert gains[got[o]] == pytest.approx(best, abs=0.11)


def test_built_outfits_are_complete_or_stuck(spark):
    rows = [item(1, 1, "top", None, "white"), item(1, 2, "bottom", None, "navy"), item(1, 3, "shoes", None, "black"), item(1, 4, "top", None, "red"), item(2, 5, "top"), item(3, 6, "bag"), item(3, 7, "accessory")]
    owned = spark.createDataFrame(rows, WARDROBE)
    chosen = owned.groupBy("owner").agg(F.array(F.min_by(outfits.as_items(), F.col("item_id"))).alias("items"))
    got = {(r["owner"], r["first"]): sorted(i["id"] for i in r["items"]) for r in insights.build(chosen, owned, "owner").collect()}
    assert got == {(1, 2): [1, 2, 3], (1, 3): [1, 2, 3], (3, 7): [6, 7]}


def test_rates_and_routing_with_nulls(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", None, True), ("a", False, None), ("b", True, None)], "field string, u boolean, c boolean")
    got = {r["field"]: (r["items"], r["unsure"], r["unsure_corrected_rate"], r["sure_corrected_rate"]) for r in profiles.correction_rates(rows, "field", F.col("u"), F.col("c")).collect()}
    assert got == {"a": (3, 1, 1.0, 0.5), "b": (1, 1, 0.0, None)}
    errors = profiles.range_errors({"x": (1, 5)}, {"y": ["m"]})
    told = spark.createDataFrame([(0, "m"), (6, "z"), (None, None), (5, "m")], "x int, y string").select(errors.alias("e")).collect()
    assert [r["e"] for r in told] == [["x"], ["x", "y"], [], []]


def test_stock_sizes_and_scraped_rows(spark):
    of = lambda stock: spark.range(1).select(shops.stock_summary(F.from_json(F.lit(json.dumps(stock)), "map<string,string>"), F.from_json(F.lit('{"1": "S"}'), "map<string,string>")).alias("s")).first()["s"]
    assert tuple(of({"1": "low_on_stock", "2": "sold"})) == ("low_on_stock", ["S"], 1)
    assert tuple(of({"1": "in_stock", "2": "LOW_ON_STOCK"})) == ("in_stock", ["S", "2"], 2)
    assert tuple(of({})) == ("out_of_stock", [], 0)
    assert spark.range(1).select(shops.unpacked_sizes(F.lit("1:S|bad|2:a:b|1:M")).alias("m")).first()["m"] == {"2": "a:b", "1": "M"}
    names = ["id", "url", "name", "image_url", "brand", "colour_name", "gender", "price", "sizes", "sizes_in_stock", "availability", "availability_from", "sku_sizes"]
    rows = [("1", "u", "n", None, "b", "red", None, "9.5", "S||M", "S", "in_stock", "stock_api", "1:S"), ("2", None, None, None, None, None, None, "x", None, "7", "out_of_stock", "stock_api", ""), ("3", *[None] * 12)]
    got = {r["external_id"]: r for r in shops.scraped_listings(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()}
    assert (got["1"]["price_tnd"], got["1"]["sizes"], got["1"]["sizes_in_stock"], got["1"]["in_stock"], got["1"]["availability_level"]) == (9.5, ["S", "M"], ["S"], True, "colour")
    assert (got["2"]["price_tnd"], got["2"]["sizes_in_stock"], got["2"]["in_stock"], got["2"]["availability_level"]) == (None, [], False, "product")
    assert (got["3"]["in_stock"], got["3"]["availability_level"], got["3"]["url"]) == (None, "", "")


def test_category_trees_and_maps(spark):
    tree = [{"name": "FEMME", "subcategories": [{"name": "Robes", "id": 1}, {"name": "Hauts", "subcategories": [{"name": " T-shirts ", "id": 2, "subcategories": []}]}]}, {"name": "Other", "key": "x"}]
    answers = spark.createDataFrame([("z", json.dumps(tree)), ("y", None), ("x", "[]")], "shop string, json string")
    got = {r["path"]: r["gender"] for r in shops.category_leaves(answers, "shop").collect()}
    assert got == {"FEMME > Robes": "women", "FEMME > Hauts > T-shirts": "women", "Other": None}
    with pytest.raises(Exception, match="deeper than 2"):
        shops.category_leaves(answers, "shop", most_depth=2).collect()
    found = spark.createDataFrame([("https://a.b/img.xml", True), ("https://a.b/Products-1.xml", True), ("https://a.b/c.xml", True)], "url string, is_index boolean")
    seen = spark.createDataFrame([("https://a.b/c.xml",)], "url string")
    assert [r["url"] for r in shops.next_maps(found, seen).collect()] == ["https://a.b/Products-1.xml", "https://a.b/img.xml"]
    assert [r["url"] for r in shops.next_maps(found, seen, 2).collect()] == ["https://a.b/Products-1.xml"]


def test_codec_cells_and_sections(spark):
    rows = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<float>")
    assert [r["v"] for r in rows.select(unpacked16(packed16("v")).alias("v")).collect()] == [[0.5, -1.25], None]
    assert spark.range(1).select(texts.cell(F.lit(" a\n| b  c "), 5).alias("x")).first()["x"] == "a \\|…"
    assert [r["g"] for r in spark.createDataFrame([("Collection Homme", None), (None, "FEMMES"), ("womenswear", "")], "a string, b string").select(texts.section_gender(F.col("a"), F.col("b")).alias("g")).collect()] == ["men", "women", None]
