"""Price bands by rank: where an item stands among scored items, read off the prices of its channel and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import matches, to_step
from weftline.operators.timeline import running_sums

#: The band's percentiles, the least prices of a category and of any reference, and the tag's factor.
LOW_PCT, HIGH_PCT, LEAST_ITEMS, LEAST_PRICES, TAG_FACTOR = 25, 75, 8, 4, 2.0
#: Prices of a reference that one row holds.
BLOCK = 1024
CONDITION = {"new_tags": 1.43, "like_new": 1.20, "good": 1.00, "stained": 0.55, "torn": 0.21}


def percentiles(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """rows with pct: the share of the group's scores that lie below; null for a null score. Every row comes back.

    Scores are counted by value first and the running sum is over different values only, in ranges. Null groups are groups.
    """
    placed = running_sums(rows.withColumn("_one", F.lit(1)), by, score, "_one").withColumn("_pct", F.col("below") / F.col("total"))
    return rows.alias("_a").join(placed.alias("_b"), matches("_a", "_b", [*by, score]), "left").select("_a.*", F.col("_b._pct").alias("pct"))


def references(prices: DataFrame, channel: str, category: str, price: str) -> DataFrame:
    """(channel, category, block, prices, n): the sorted reference prices of each category, and of all under "*", by blocks.

    A block has the BLOCK prices from place BLOCK * block on and the one after them. Prices are counted by value first and numbered by
    running sums over ranges; a value fills the stretch of each block that its places meet, so it has a row a block, not one a listing.
    """
    known = prices.filter(F.col(price).isNotNull()).select(F.col(channel).alias(channel), F.col(category).cast("string").alias(category), F.col(price).alias("_p"))
    tallied = known.groupBy(channel, category, "_p").agg(F.count(F.lit(1)).alias("_k"))
    tallied = tallied.unionByName(tallied.groupBy(channel, "_p").agg(F.sum("_k").alias("_k")).withColumn(category, F.lit("*")))
    placed = running_sums(tallied, [channel, category], "_p", "_k").withColumn("_to", F.col("below") + F.col("amount") - 1)
    first, last = F.greatest(F.ceil(F.col("below") / BLOCK) - 1, F.lit(0)).cast("long"), F.floor(F.col("_to") / BLOCK).cast("long")
    met = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("below", F.col("block") * BLOCK)
    end = F.least("_to", (F.col("block") + 1) * BLOCK)
    filled = met.select(channel, category, "block", F.col("total").alias("n"), F.struct("_p", (end - begin + 1).cast("int").alias("k")).alias("run"))
    runs = filled.groupBy(channel, category, "block").agg(F.array_sort(F.collect_list("run")).alias("_runs"), F.max("n").alias("n"))
    return runs.select(channel, category, "block", F.flatten(F.transform("_runs", lambda r: F.array_repeat(r["_p"], r["k"]))).alias("prices"), "n")


def read_quantiles(rows: DataFrame, refs: DataFrame, channel: str, category: Column, shares: dict[str, Column]) -> DataFrame:
    """rows with the quantile of their reference at each share, by linear interpolation between the two prices around it; null
    without a reference. category says which reference a row reads."""
    sizes = refs.filter("block = 0").select(F.col(channel).alias("_ch"), F.col(category_of(refs, channel)).alias("_ca"), F.col("n").alias("_n"))
    out = rows.withColumn("_use", category)
    on = lambda: F.col(channel).eqNullSafe(F.col("_ch")) & F.col("_use").eqNullSafe(F.col("_ca"))
    out = out.join(sizes, on(), "left").drop("_ch", "_ca")
    for name, share in shares.items():
        blocks = refs.select(F.col(channel).alias("_ch"), F.col(category_of(refs, channel)).alias("_ca"), F.col("block").alias("_b"), F.col("prices").alias("_prices"))
        out = out.withColumn("_at", share * (F.col("_n") - 1)).withColumn("_low", F.floor("_at").cast("long"))
        out = out.join(blocks, on() & (F.floor(F.col("_low") / BLOCK).cast("long") == F.col("_b")), "left")
        first = F.get("_prices", (F.col("_low") % BLOCK).cast("int"))
        then = F.coalesce(F.get("_prices", (F.col("_low") % BLOCK).cast("int") + 1), first)
        out = out.withColumn(name, first + (then - first) * (F.col("_at") - F.col("_low"))).drop("_ch", "_ca", "_b", "_prices", "_at", "_low")
    return out.drop("_use", "_n")


def category_of(refs: DataFrame, channel: str) -> str:
    """The name of a reference table's category column."""
    return next(c for c in refs.columns if c not in (channel, "block", "prices", "n"))


def bands(rows: DataFrame, refs: DataFrame, channel: str, category: str, error: float | None = None, step: float = 1.0) -> DataFrame:
    """rows (with pct) and low, median, high, based_on. No reference of at least LEAST_PRICES prices: null, never a guess.

    The category counts from LEAST_ITEMS prices on, else the channel. The median lies inside, and the band is at least
    median / error to median * error wide.
    """
    first = refs.filter("block = 0")
    own = first.filter(F.col(category) != "*").select(F.col(channel).alias("_ch"), F.col(category).alias("_ca"), F.col("n").alias("_own"))
    every = first.filter(F.col(category) == "*").select(F.col(channel).alias("_ch2"), F.col("n").alias("_all"))
    joined = rows.join(own, F.col(channel).eqNullSafe(F.col("_ch")) & F.col(category).eqNullSafe(F.col("_ca")), "left").drop("_ch", "_ca").join(every, F.col(channel).eqNullSafe(F.col("_ch2")), "left")
    use = F.coalesce(F.col("_own") >= LEAST_ITEMS, F.lit(False))
    half = (HIGH_PCT - LOW_PCT) / 200
    shares = {"_mid": F.col("pct"), "_from": F.greatest(F.col("pct") - half, F.lit(0.0)), "_upto": F.least(F.col("pct") + half, F.lit(1.0))}
    read = read_quantiles(joined, refs, channel, F.when(use, F.col(category)).otherwise("*"), shares)
    stepped = lambda c: to_step(F.round(F.col(c), 6), step)
    count = F.when(use, F.col("_own")).otherwise(F.col("_all"))
    out = read.withColumn("median", F.when(count >= LEAST_PRICES, stepped("_mid")))
    low, high = F.least(stepped("_from"), F.col("median")), F.greatest(stepped("_upto"), F.col("median"))
    if error and error > 1:
        low, high = F.least(low, to_step(F.col("median") / error, step)), F.greatest(high, to_step(F.col("median") * error, step))
    known = F.col("median").isNotNull()
    out = out.withColumns({"low": F.when(known, low), "high": F.when(known, high), "based_on": F.when(known, F.when(use, "category").otherwise("all"))})
    return out.drop("_own", "_ch2", "_all", *shares)


def tag(price: Column, median: Column, factor: float = TAG_FACTOR, show_high: bool = True) -> Column:
    """good_deal, priced_high or null against a known median."""
    fit = (price > 0) & (median > 0)
    high = F.when(fit & F.lit(show_high) & (price > median * factor), "priced_high")
    return F.when(fit & (price < median / factor), "good_deal").otherwise(high)
