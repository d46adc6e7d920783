"""Learned checks: brands told from photos, photos that look worn, and the part weights that true outfits prefer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import texts
from weftline.functions.exprs import softmax
from weftline.operators import fits, outfits
from weftline.operators.prices import percentiles

#: The least ads of a brand that is learned, how many photo brands count as seen, below which share of the estimate a
#: price is unusually low, whether photo and price must both speak against a claim, and the share of photos that look worn.
LEAST_ADS, PHOTO_TOP, LOW_RATIO, BOTH, WORN_SHARE = 8, 3, 0.5, True, 0.10
#: A part that can't be computed counts as this when weights are learned.
UNKNOWN_PART = 0.5


def brand_probe(ads: DataFrame, features: str, brand: str, least_ads: int = LEAST_ADS, penalty: float = 0.1) -> fits.Logits:
    """A model of the brands that have at least least_ads ads with features, each brand of the same weight."""
    known = ads.filter(F.col(brand).isNotNull() & F.col(features).isNotNull()).select(F.col(brand).alias("_brand"), F.col(features).alias("_x"))
    often = known.groupBy("_brand").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_ads).select("_brand")
    return fits.softmax(known.join(often, "_brand", "left_semi"), "_x", "_brand", penalty)


def chances(logits: Column, classes: list[str]) -> Column:
    """(brand, p) of all classes, the likeliest first, from a column of their logits; equal ones in order of name."""
    order = F.array(*[F.lit(c) for c in classes])
    ranked = F.array_sort(F.zip_with(order, softmax(logits), lambda b, x: F.struct((-x).alias("low"), b.alias("brand"))))
    return F.transform(ranked, lambda s: F.struct(s["brand"].alias("brand"), (-s["low"]).alias("p")))


def label_check(ads: DataFrame, probe: fits.Logits, features: str, title: str, description: str, asking: str, estimate: str,
                top: int = PHOTO_TOP, low: float = LOW_RATIO, both: bool = BOTH) -> DataFrame:
    """ads (without features) with claimed_brand, claims_original, photo_brands, photo_supports_claim, price_ratio, unusually_cheap, action and message.

    A label photo is asked for when the claimed brand is not among the photo's `top` brands and (or, unless both) the asking price is below
    `low` of the estimate. What can't be told is null and speaks against nobody: no claim, a brand that the probe has not learned, no
    photo, no price or estimate over 0. An ad without a claim has only the two first columns.
    """
    words = lambda c: F.coalesce(F.col(c), F.lit(""))
    folded = texts.fold(F.concat(words(title), F.lit(" . "), words(description)))
    told = ads.withColumns({"claimed_brand": texts.claimed_brand(folded), "claims_original": texts.claims_original(folded), "_z": fits.told(F.col(features), probe.weights, probe.intercepts)})
    told = told.withColumn("_all", F.when(F.col("_z").isNotNull(), chances(F.col("_z"), probe.classes))).drop("_z")
    claim = F.col("claimed_brand")
    seen = F.slice("_all", 1, top)
    learned = claim.isin(*probe.classes) & F.col("_all").isNotNull()
    priced = claim.isNotNull() & (F.col(asking) > 0) & (F.col(estimate) > 0)
    ratio = F.when(priced, F.col(asking).cast("double") / F.col(estimate))
    rounded = F.transform(seen, lambda s: F.struct(s["brand"].alias("brand"), F.round(s["p"], 3).alias("p")))
    out = told.withColumns({
        "photo_brands": F.when(learned, rounded), "photo_supports_claim": F.when(learned, F.exists(seen, lambda s: s["brand"] == claim)),
        "price_ratio": F.round(ratio, 2), "unusually_cheap": ratio < low,
    })
    off, cheap = F.coalesce(~F.col("photo_supports_claim"), F.lit(False)), F.coalesce(F.col("unusually_cheap"), F.lit(False))
    fires = off & cheap if both else off | cheap
    message = F.concat(F.lit("This ad names "), F.initcap(claim), F.lit(". A photo that shows the label or logo clearly helps buyers trust it."))
    return out.withColumns({"action": F.when(fires, "ask_label_photo"), "message": F.when(fires, message)}).drop("_all", features)


def worn_hints(photos: DataFrame, features: str, looks_new: str, by: list[str] = (), share: float = WORN_SHARE, penalty: float = 0.1) -> DataFrame:
    """photos (without features) with score, pct and worn_hint: whether a photo's score for looking new is in the lowest share of its group.

    The score is the logit of a yes-or-no model fitted where looks_new is known; photos without features have none and no hint.
    """
    model = fits.logistic(photos.select(F.col(features).alias("_x"), F.col(looks_new).cast("double").alias("_y")), "_x", "_y", penalty, balanced=True)
    scored = photos.withColumn("score", F.round(fits.told(F.col(features), model.weights, model.intercepts)[0], 9)).drop(features)
    return percentiles(scored, "score", list(by)).withColumn("worn_hint", F.col("pct") < share)


def part_differences(tests: DataFrame, members: DataFrame, pool: DataFrame, key: str, vector: str, size: int, looks: DataFrame | None = None) -> DataFrame:
    """(key, differences): for each test (key, true_id, fake_id) what the true set's parts have over those of the set with the fake in, in order of
    outfits.WEIGHTS; a part that can't be computed counts as UNKNOWN_PART. members are (key, item), pool the items that stand in; both name their
    vector by a column `look` and looks has (look, vector), or, without looks, both have the vector itself.

    A set's vectors are summed once: the set with the fake in has the same sum but for two of them, so no set is built twice.
    """
    name = vector if looks is None else "look"
    item = outfits.as_items()
    fakes = tests.select(key, "true_id", "fake_id").join(pool.select(F.col("item_id").alias("fake_id"), item.alias("_fake"), F.col(name).alias("_new")), "fake_id").drop("fake_id")
    rows = members.join(fakes, key).select(key, item.alias("_i"), "true_id", "_fake", "_new", F.when(F.col("item_id") == F.col("true_id"), F.col(name)).alias("_old"))
    one = [F.first(c, ignorenulls=True).alias(c) for c in ("true_id", "_fake", "_new", "_old")]
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_real"), *one)
    looked = members if looks is None else members.select(key, name).join(looks.select(name, vector), name)
    sets = sets.join(outfits._vector_sums(looked, key, vector, size), key, "left")
    for side in () if looks is None else ("_old", "_new"):
        sets = sets.join(looks.select(F.col(name).alias(side), F.col(vector).alias(f"{side}v")), side, "left").drop(side).withColumnRenamed(f"{side}v", side)
    swapped = F.array_sort(F.concat(F.filter("_real", lambda i: i["id"] != F.col("true_id")), F.array("_fake")))
    styles = (outfits._coherence(), outfits.swapped_coherence(F.col("_old"), F.col("_new"), size))
    told = sets.select(key, F.col("_real"), swapped.alias("_swapped"), *[s.alias(f"_style{i}") for i, s in enumerate(styles)])
    parts = [F.struct(F.col(f"_style{i}").alias("style"), outfits.parts_of(F.col(c)).alias("of")) for i, c in enumerate(("_real", "_swapped"))]
    of = lambda side, part: F.coalesce(side["style"] if part == "style" else side["of"][part], F.lit(UNKNOWN_PART))
    return told.select(key, *[p.alias(f"_p{i}") for i, p in enumerate(parts)]).select(key, F.array(*[of(F.col("_p0"), p) - of(F.col("_p1"), p) for p in outfits.WEIGHTS]).alias("differences"))


def part_weights(differences: DataFrame, column: str = "differences") -> dict[str, float]:
    """The weights that tell true sets from fakes best: a model without intercept on the differences and their negatives, its weights
    cut at 0, scaled to sum to 1 and rounded to cents; all 0 where none is above 0."""
    told = differences.select(F.col(column).alias("x"), F.lit(1.0).alias("y"))
    found = np.clip(fits.logistic(told, "x", "y", intercept=False, mirrored=True).weights[0], 0, None)
    total = found.sum()
    return {p: round(float(w / total), 2) if total else 0.0 for p, w in zip(outfits.WEIGHTS, found, strict=True)}
