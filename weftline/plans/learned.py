"""Learned queries: prices out of fold, brands and wear from vectors, and part weights from swap tests."""

from pyspark.sql import functions as F

from weftline.functions import texts
from weftline.operators import fits, learned, parts, price_model
from weftline.operators import advice as tests_of
from weftline.plans.advice import grouped_folds
from weftline.plans.bind import items, vector_looks, vectors, worn
from weftline.plans.prices import _banded
from weftline.plans.registry import query
from weftline.session import table
from weftline.session_dirs import ensure_checkpoint_dir


def _priced(spark, d):
    """Parts with a vector: their type is the channel, their brand the category, and near copies share a fold."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("channel"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"))
    folds = grouped_folds(spark, d).select(F.col("node").alias("item_id"), "fold")
    rows = part.join(vectors(spark, d).select("item_id", "embedding"), "item_id").join(folds, "item_id")
    return price_model.with_target(rows, "channel", "price").checkpoint()


@query()
def price_fold_models(spark, d):
    """For each fold the penalty that the other folds choose among themselves, and the error on the fold itself."""
    found = fits.grams(_priced(spark, d), "embedding", "target", "fold")
    rows = [(f, m.alpha, int(found[f][0, 0]), fits.squared_error(found[f], m.weights, m.intercept)) for f, m in fits.nested_ridge(found).items()]  # a row a fold
    return spark.createDataFrame(rows, "fold long, alpha double, n long, error double").select("fold", F.round("alpha", 6).alias("alpha"), "n", F.round("error", 6).alias("error"))


@query()
def served_errors(spark, d):
    """How far the served price is off by channel, each item priced by a model and prices that lack its fold."""
    rows = _priced(spark, d)
    models = fits.nested_ridge(fits.grams(rows, "embedding", "target", "fold"))
    told = price_model.served_errors(rows, models, "embedding", "fold", "channel", "category", "price")
    return price_model.typical_errors(told, "channel").select("channel", "n", F.round("factor", 6).alias("factor"))


def _ads(spark, d):
    """Parts with a vector as ads: the least unit price that a part was ordered at is asked, its band's median is the estimate."""
    part = table(spark, d, "part")
    asked = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("asking"))
    names = F.array(*[F.lit(b) for b in texts.BRANDS])
    brand = F.get(names, F.pmod(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), F.lit(len(texts.BRANDS))))
    titled = part.select("p_partkey", F.concat_ws(" ", "p_name", brand, F.when(F.col("p_type") == "PROMO", "original")).alias("title"), F.col("p_type").alias("description"))
    estimated = titled.join(asked, "p_partkey", "left").join(_banded(spark, d).select("p_partkey", F.col("median").alias("estimate")), "p_partkey", "left")
    return estimated.join(vectors(spark, d).select(F.col("item_id").alias("p_partkey"), "embedding"), "p_partkey")


@query()
def label_check_probe(spark, d):
    """Ads whose photo and price both speak against the brand that the title claims, by a probe fitted on all ads."""
    ads = _ads(spark, d)
    probe = learned.brand_probe(ads.withColumn("brand", texts.claimed_brand(texts.fold(F.col("title")))), "embedding", "brand")
    out = learned.label_check(ads, probe, "embedding", "title", "description", "asking", "estimate")
    return out.select("p_partkey", "claimed_brand", "claims_original", F.to_json("photo_brands").alias("photo_brands"), "photo_supports_claim", "price_ratio", "unusually_cheap", "action")


@query()
def worn_hint_probe(spark, d):
    """Photos that look most worn of their label: parts under 15 in size are known as new, those over 35 as worn, the rest unknown."""
    size = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") < 15, 1.0).when(F.col("p_size") > 35, 0.0).alias("looks_new"))
    photos = vectors(spark, d).join(size, "item_id", "left")
    return learned.worn_hints(photos, "embedding", "looks_new", ["category"]).select("item_id", "category", F.round("pct", 6).alias("pct"), "worn_hint")


@query()
def learned_weights(spark, d):
    """What the parts of true outfits weigh against those of outfits with one item swapped."""
    ensure_checkpoint_dir(spark)
    pool, (members, kinds) = items(spark, d), worn(spark, d)
    tests = tests_of.swap_tests(members, "outfit_id", kinds, "s1").drop("wrong").checkpoint()  # three numbers an outfit
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id"))
    rows = parts.with_tests(lines, tests, "outfit_id").join(pool.select("item_id", parts.packed().alias("code")), "item_id")
    looks, top = vector_looks(spark, d)
    differences = parts.differences(rows, "outfit_id", lines.count(), looks, learned.UNKNOWN_PART, top)
    found = learned.part_weights(differences)
    return spark.createDataFrame(list(found.items()), "part string, weight double")  # four rows
