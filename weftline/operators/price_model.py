"""The price ranker out of fold: models that haven't seen an item, its rank among their training scores, and the price read there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import matches, to_step
from weftline.operators import fits, prices
from weftline.operators.timeline import running_sums
from weftline.session_dirs import ensure_checkpoint_dir


def with_target(rows: DataFrame, channel: str, price: str) -> DataFrame:
    """rows of a known price over 0, with target: the logged price less the mean of its channel's."""
    known = rows.filter(F.col(price) > 0)
    offsets = known.groupBy(channel).agg(F.avg(F.log(price)).alias("_offset"))
    joined = known.alias("_a").join(offsets.alias("_b"), matches("_a", "_b", [channel]))
    return joined.select("_a.*", (F.log(F.col(f"_a.{price}")) - F.col("_b._offset")).alias("target"))


def all_scores(rows: DataFrame, models: dict[int, fits.Linear], features: str) -> DataFrame:
    """rows (without features) once for each model, with of (the fold that the model has not seen) and score, what it says."""
    order = sorted(models)
    weights, intercepts = np.stack([models[f].weights for f in order]), np.array([models[f].intercept for f in order])
    scored = rows.withColumn("_scores", fits.told(F.col(features), weights, intercepts)).drop(features)
    names = F.array(*[F.lit(f).cast("long") for f in order])
    both = F.explode(F.arrays_zip(names.alias("of"), F.col("_scores").alias("score")))
    return scored.withColumn("_s", both).select(*[c for c in scored.columns if c != "_scores"], F.col("_s.of").alias("of"), F.col("_s.score").alias("score"))


def served_errors(rows: DataFrame, models: dict[int, fits.Linear], features: str, fold: str, channel: str, category: str, price: str, step: float = 1.0) -> DataFrame:
    """rows (without features) with score, pct, served and error: what the app would have said of each item, had it never seen it.

    pct is the share of its model's training items that score less. served is the price at that share of the training prices of the item's
    channel and category, or of its channel where the category has under prices.LEAST_ITEMS of them, to a step; error is the
    distance of the logged prices. Items without features, price or fold are left out.
    """
    known = rows.filter(F.col(features).isNotNull() & (F.col(price) > 0) & F.col(fold).isNotNull())
    ensure_checkpoint_dir(rows.sparkSession)
    scored = all_scores(known, models, features).withColumn("score", F.round("score", 9)).checkpoint()  # told once: products may differ in their last digit
    held_out = F.col("of") == F.col(fold)
    sums = running_sums(scored.withColumn("_trained", F.when(held_out, 0).otherwise(1)), ["of"], "score", "_trained")
    own = scored.filter(held_out).alias("_a").join(sums.alias("_b"), ["of", "score"]).select("_a.*", (F.col("_b.below") / F.col("_b.total")).alias("pct"))
    read_at = F.concat_ws("|", F.col("of").cast("string"), F.coalesce(F.col(channel).cast("string"), F.lit("")))
    curve = F.coalesce(F.col(category).cast("string"), F.lit(""))
    trained = scored.filter(~held_out).select(read_at.alias("_curve"), curve.alias("_kind"), F.col(price).alias("_price"))
    refs = prices.references(trained, "_curve", "_kind", "_price")
    sizes = refs.filter("block = 0").select(F.col("_curve"), F.col("_kind"), F.col("n").alias("_own"))
    asked = own.withColumns({"_curve": read_at, "_kind": curve}).join(sizes, ["_curve", "_kind"], "left")
    use = F.when(F.col("_own") >= prices.LEAST_ITEMS, F.col("_kind")).otherwise("*")
    read = prices.read_quantiles(asked, refs, "_curve", use, {"_read": F.col("pct")})
    served = to_step(F.round("_read", 6), step)
    error = F.abs(F.log(F.greatest("served", F.lit(1.0))) - F.log(price))
    return read.withColumn("served", served).withColumn("error", error).drop("_curve", "_kind", "_own", "_read", "of")


def typical_errors(rows: DataFrame, channel: str) -> DataFrame:
    """(channel, n, factor): exp of the mean error by channel, and of all under "All"."""
    by = rows.groupBy(channel).agg(F.count("error").alias("n"), F.sum("error").alias("_e"))
    every = by.agg(F.sum("n").alias("n"), F.sum("_e").alias("_e")).select(F.lit("All").alias(channel), "n", "_e")
    return by.unionByName(every).filter("n > 0").select(channel, "n", F.exp(F.col("_e") / F.col("n")).alias("factor"))
