"""Price queries: parts are items, their brand's number the channel, their type the category."""

from pyspark.sql import functions as F

from weftline.functions.exprs import looked_up, to_step
from weftline.operators import prices as op
from weftline.plans.registry import query
from weftline.session import table

_SQL = """WITH s AS (SELECT p_partkey, p_brand AS channel, p_type AS category, p_retailprice AS price, (p_partkey * 7919) % 1009 AS score FROM part),
p AS (SELECT *, (rank() OVER (PARTITION BY channel ORDER BY score) - 1)::DOUBLE / count(*) OVER (PARTITION BY channel) AS pct FROM s)"""


def _scored(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("channel"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), ((F.col("p_partkey") * 7919) % 1009).alias("score"))


@query(_SQL + " SELECT p_partkey, round(pct, 6) AS pct FROM p")
def price_rank_percentile(spark, d):
    return op.percentiles(_scored(spark, d), "score", ["channel"]).select("p_partkey", F.round("pct", 6).alias("pct"))


_BAND_SQL = _SQL + """,
own AS (SELECT channel, category, count(*) AS n, list_sort(list(price)) AS l FROM s GROUP BY ALL), every AS (SELECT channel, count(*) AS n, list_sort(list(price)) AS l FROM s GROUP BY 1),
j AS (SELECT p.*, CASE WHEN o.n >= 8 THEN o.l ELSE e.l END AS l, CASE WHEN o.n >= 8 THEN o.n ELSE e.n END AS n, CASE WHEN o.n >= 8 THEN 'category' ELSE 'all' END AS based FROM p JOIN own o USING (channel, category) JOIN every e USING (channel)),
h AS (SELECT *, pct AS a, greatest(pct - 0.25, 0) AS b, least(pct + 0.25, 1) AS c FROM j)"""


def quantile_sql(x: str) -> str:
    """The quantile of the sorted list l, of length n, at share x, between the two places around it."""
    low = f"floor(({x}) * (n - 1))"
    return f"(l[{low}::INTEGER + 1] + (l[least({low}::INTEGER + 2, n)] - l[{low}::INTEGER + 1]) * (({x}) * (n - 1) - {low}))"


def _read_sql(x: str) -> str:
    return f"round_even(round({quantile_sql(x)}, 6), 0)"


_BANDED_SQL = _BAND_SQL + f""", r AS (SELECT *, {_read_sql("a")} AS median, {_read_sql("b")} AS lo, {_read_sql("c")} AS hi FROM h),
banded AS (SELECT p_partkey, channel, category, price, pct, based AS based_on, median, least(least(lo, median), round_even(median / 1.5, 0)) AS low, greatest(greatest(hi, median), round_even(median * 1.5, 0)) AS high FROM r WHERE n >= 4)"""


def _banded(spark, d):
    scored = _scored(spark, d)
    return op.bands(op.percentiles(scored, "score", ["channel"]), op.references(scored, "channel", "category", "price"), "channel", "category", error=1.5)


@query(_BANDED_SQL + " SELECT p_partkey, low, median, high, based_on FROM banded")
def price_band(spark, d):
    return _banded(spark, d).filter("median is not null").select("p_partkey", "low", "median", "high", "based_on")


@query(_BANDED_SQL + " SELECT p_partkey, CASE WHEN price * 1.4 < median / 1.2 THEN 'good_deal' WHEN price * 1.4 > median * 1.2 THEN 'priced_high' END AS tag FROM banded")
def price_tag(spark, d):
    return _banded(spark, d).filter("median is not null").select("p_partkey", op.tag(F.col("price") * 1.4, F.col("median"), 1.2).alias("tag"))


@query(_BANDED_SQL + """, c AS (SELECT *, ['new_tags', 'like_new', 'good', 'stained', 'torn'][p_partkey % 5 + 1] AS condition FROM banded)
SELECT p_partkey, condition, round_even(median * CASE condition WHEN 'new_tags' THEN 1.43 WHEN 'like_new' THEN 1.20 WHEN 'good' THEN 1.00 WHEN 'stained' THEN 0.55 ELSE 0.21 END::DOUBLE, 0) AS median FROM c""")
def price_condition(spark, d):
    names = F.array(*[F.lit(c) for c in op.CONDITION])
    rows = _banded(spark, d).filter("median is not null").withColumn("condition", F.get(names, (F.col("p_partkey") % 5).cast("int")))
    return rows.select("p_partkey", "condition", to_step(F.col("median") * looked_up(F.col("condition"), op.CONDITION), 1.0).alias("median"))


@query(_BANDED_SQL + " SELECT channel, count(*) AS n, round(avg(CASE WHEN price < median / 1.05 THEN 1.0 ELSE 0.0 END), 6) AS deals, round(avg(CASE WHEN price > median * 1.05 THEN 1.0 ELSE 0.0 END), 6) AS high, round(exp(avg(abs(ln(median / price)))), 6) AS error FROM banded GROUP BY 1")
def price_tag_rates(spark, d):
    """How often an item's own price would be tagged, and the typical factor between band and price."""
    told = _banded(spark, d).filter("median is not null").withColumn("tag", op.tag(F.col("price"), F.col("median"), 1.05))
    share = lambda t: F.round(F.avg(F.when(F.col("tag") == t, 1.0).otherwise(0.0)), 6)
    return told.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), share("good_deal").alias("deals"), share("priced_high").alias("high"), F.round(F.exp(F.avg(F.abs(F.log(F.col("median") / F.col("price"))))), 6).alias("error"))


@query(_BANDED_SQL + """, w AS (SELECT channel, category, exp(avg(abs(ln(median / price)))) AS error FROM banded GROUP BY ALL), low AS (SELECT channel, category FROM w WHERE error > 1.03)
SELECT p_partkey, l.channel IS NULL AS reliable FROM banded b LEFT JOIN low l USING (channel, category)""")
def price_low_confidence(spark, d):
    """Items of groups whose typical error is over the limit are marked unreliable."""
    rows = _banded(spark, d).filter("median is not null")
    low = rows.groupBy("channel", "category").agg(F.exp(F.avg(F.abs(F.log(F.col("median") / F.col("price"))))).alias("e")).filter("e > 1.03").select("channel", "category", F.lit(False).alias("_r"))
    return rows.join(low, ["channel", "category"], "left").select("p_partkey", F.col("_r").isNull().alias("reliable"))
