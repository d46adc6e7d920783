"""Profiling and evaluation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.exprs import lab_of
from weftline.operators import profiles as op
from weftline.plans.bind import ITEMS_SQL, WEARS_SQL, items, wears
from weftline.plans.registry import query
from weftline.session import table


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, d):
    counted = table(spark, d, "events").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {ITEMS_SQL} SELECT coalesce(category, 'All') AS category, round(avg(CASE WHEN coalesce(colour, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS colour, round(avg(CASE WHEN coalesce(pattern, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS pattern, round(avg(CASE WHEN coalesce(sub_category, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS sub_category FROM items GROUP BY ROLLUP (category)")
def fill_rate_all(spark, d):
    return op.fill_rates(items(spark, d), ["colour", "pattern", "sub_category"], "category")


@query("SELECT coalesce(l_returnflag, 'All') AS l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(*) FILTER (l_discount > 0.05) AS usable, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS share FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def coverage_totals(spark, d):
    usable = F.count_if(F.col("l_discount") > 0.05)
    n = F.count(F.lit(1))
    return op.with_total(table(spark, d, "lineitem"), "l_returnflag", [n.alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), usable.alias("usable"), F.round(usable / n, 6).alias("share")])


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS outfits, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round(avg(CASE WHEN n >= 4 THEN 1.0 ELSE 0.0 END), 6) AS share_4 FROM s""")
def outfit_sizes(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("outfits"), F.percentile("n", 0.5).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.round(F.avg(F.when(F.col("n") >= 4, 1.0).otherwise(0.0)), 6).alias("share_4"),
    )


@query("SELECT least(n, 6) AS size, count(*) AS outfits FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def outfit_size_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").count().groupBy(F.least("count", F.lit(6).cast("long")).alias("size")).agg(F.count(F.lit(1)).alias("outfits"))


@query(f"WITH {WEARS_SQL}, o AS (SELECT outfit_id, bool_or(category = 'top') AND bool_or(category = 'bottom') OR bool_or(category = 'dress') AS complete, count(*) > count(DISTINCT category) AS repeats FROM wears GROUP BY 1) SELECT complete, repeats, count(*) AS outfits FROM o GROUP BY ALL")
def repeat_category_share(spark, d):
    has = lambda c: F.bool_or(F.col("category") == c)
    seen = wears(spark, d).groupBy("outfit_id").agg(((has("top") & has("bottom")) | has("dress")).alias("complete"), (F.count(F.lit(1)) > F.size(F.collect_set("category"))).alias("repeats"))
    return seen.groupBy("complete", "repeats").agg(F.count(F.lit(1)).alias("outfits"))


@query(f"""WITH {WEARS_SQL}, o AS (SELECT DISTINCT outfit_id, category FROM wears)
SELECT a.category AS a, b.category AS b, count(*) AS groups, round(count(*) / (SELECT count(DISTINCT outfit_id) FROM o), 6) AS share FROM o a JOIN o b ON a.outfit_id = b.outfit_id AND a.category < b.category GROUP BY 1, 2""")
def cooccurrence(spark, d):
    return op.cooccurrence(wears(spark, d), "outfit_id", "category")


@query(f"WITH {WEARS_SQL} SELECT outfit_id, array_to_string(list_sort(list(item_id)), '|') AS items, array_to_string(list_sort(list_distinct(list(category))), '|') AS categories FROM wears GROUP BY 1")
def outfit_members(spark, d):
    return wears(spark, d).groupBy("outfit_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), "|").alias("items"), F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


@query("SELECT count(*) FILTER (o_custkey IS NULL) AS no_customer, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS no_lines, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lost_lines, count(*) - count(DISTINCT o_orderkey) AS copies FROM orders")
def null_audit(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    both = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "full")
    return both.agg(
        F.count_if(F.col("o_orderkey").isNotNull() & F.col("o_custkey").isNull()).alias("no_customer"), F.count_if(F.col("l_orderkey").isNull()).alias("no_lines"),
        F.coalesce(F.sum(F.when(F.col("o_orderkey").isNull(), F.col("n"))), F.lit(0)).alias("lost_lines"), (F.count("o_orderkey") - F.countDistinct("o_orderkey")).alias("copies"),
    )


@query("""WITH c AS (SELECT c_mktsegment, o_orderpriority, count(DISTINCT c_custkey) AS people FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY people DESC, o_orderpriority) AS turn FROM c) WHERE turn <= 3""")
def distinct_top_per_group(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    counted = joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.countDistinct("c_custkey").alias("people"))
    turn = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("people").desc(), "o_orderpriority"))
    return counted.withColumn("turn", turn).filter("turn <= 3")


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY 1")
def mean_predicate(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 6).alias("share"))


#: Predictions to evaluate: an item's category against that of the next number, right two times in three.
_PRED_SQL = f"WITH {ITEMS_SQL}, p AS (SELECT item_id, category, pattern_conf AS conf, CASE WHEN item_id % 3 = 0 THEN sub_category ELSE category END AS guess FROM items)"


def _guesses(spark, d):
    return items(spark, d).select("item_id", "category", F.col("pattern_conf").alias("conf"), F.when(F.col("item_id") % 3 == 0, F.col("sub_category")).otherwise(F.col("category")).alias("guess"))


@query(_PRED_SQL + """, c AS (SELECT category, cut, count(*) FILTER (conf >= cut) AS n, count(*) FILTER (conf >= cut AND guess IS NOT NULL AND guess = category) AS k FROM p, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) t(cut) GROUP BY 1, 2)
SELECT *, CASE WHEN n > 0 THEN round(greatest((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 6) END AS low,
  CASE WHEN n > 0 THEN round(least((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 6) END AS high FROM c""")
def wilson_by_cut(spark, d):
    return op.accuracy_at_cuts(_guesses(spark, d), "category", F.coalesce(F.col("guess") == F.col("category"), F.lit(False)), F.col("conf"), [0.0, 0.5, 0.7])


@query(_PRED_SQL + "SELECT category || ' -> ' || guess AS pair, count(*) AS n FROM p WHERE guess <> category GROUP BY 1 ORDER BY n DESC, pair LIMIT 10")
def confusion_top(spark, d):
    wrong = _guesses(spark, d).filter("guess <> category")
    return wrong.groupBy(F.concat_ws(" -> ", "category", "guess").alias("pair")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pair").limit(10)


@query(_PRED_SQL + "SELECT coalesce(category, 'All') AS category, count(*) AS n, round(avg(CASE WHEN guess = category THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY ROLLUP (category) HAVING count(*) >= 20")
def accuracy_by_group(spark, d):
    right = F.avg(F.when(F.col("guess") == F.col("category"), 1.0).otherwise(0.0))
    return op.with_total(_guesses(spark, d), "category", [F.count(F.lit(1)).alias("n"), F.round(right, 6).alias("accuracy")]).filter("n >= 20")


@query(_PRED_SQL + "SELECT round(avg(a), 6) AS balanced, count(*) AS classes FROM (SELECT avg(CASE WHEN guess = category THEN 1.0 ELSE 0.0 END) AS a FROM p GROUP BY category HAVING count(*) >= 5)")
def balanced_accuracy(spark, d):
    by_class = _guesses(spark, d).groupBy("category").agg(F.avg(F.when(F.col("guess") == F.col("category"), 1.0).otherwise(0.0)).alias("a"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return by_class.agg(F.round(F.avg("a"), 6).alias("balanced"), F.count(F.lit(1)).alias("classes"))


@query(_PRED_SQL + """SELECT CASE WHEN conf < 0.5 THEN 0.0 WHEN conf < 0.6 THEN 0.5 WHEN conf < 0.7 THEN 0.6 WHEN conf < 0.8 THEN 0.7 WHEN conf < 0.9 THEN 0.8 ELSE 0.9 END::DOUBLE AS bucket, conf < 0.6 AS unsure,
  count(*) AS n, round(avg(CASE WHEN guess = category THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(conf), 6) AS mean_conf FROM p GROUP BY 1, 2""")
def calibration_buckets(spark, d):
    conf = F.col("conf")
    bucket = F.when(conf < 0.5, 0.0)
    for low, high in ((0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9)):
        bucket = bucket.when(conf < high, low)
    right = F.avg(F.when(F.col("guess") == F.col("category"), 1.0).otherwise(0.0))
    return _guesses(spark, d).groupBy(bucket.otherwise(0.9).alias("bucket"), (conf < 0.6).alias("unsure")).agg(F.count(F.lit(1)).alias("n"), F.round(right, 6).alias("accuracy"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@query("""SELECT o_orderpriority, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) AS win_rate, count(*) AS tests
FROM (SELECT o_orderkey AS k, o_orderpriority, floor(o_totalprice / 1000) AS p FROM orders) a JOIN (SELECT o_orderkey - 1 AS k, floor(o_totalprice / 1000) AS p FROM orders) b USING (k) GROUP BY 1""")
def win_rate(spark, d):
    """A true case against its altered one: 1 for a win, a half for a tie."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("a"))
    b = table(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("k"), F.floor(F.col("o_totalprice") / 1000).alias("b"))
    points = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    return a.join(b, "k").groupBy("o_orderpriority").agg(F.round(F.avg(points), 6).alias("win_rate"), F.count(F.lit(1)).alias("tests"))


@query("""WITH r AS (SELECT o_orderpriority, o_orderstatus = 'F' AS pos, floor(o_totalprice / 500) AS s FROM orders),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, s) - 1) / 2 AS rk FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY s)),
g AS (SELECT o_orderpriority, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(rk) FILTER (pos) AS sr FROM k GROUP BY 1)
SELECT o_orderpriority, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM g WHERE n_pos >= 10 AND n_neg >= 10""")
def auc_by_concept(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.floor(F.col("o_totalprice") / 500).alias("s"))
    return op.roc_auc(rows, "s", F.col("o_orderstatus") == "F", ["o_orderpriority"])


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS a, floor(l_extendedprice / 100) AS b FROM lineitem),
k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2 AS rb FROM r)
SELECT l_returnflag, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM k GROUP BY 1""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), F.floor(F.col("l_extendedprice") / 100).alias("b"))
    return op.spearman(rows, "a", "b", ["l_returnflag"])


@query("SELECT l_linestatus, round(exp(avg(abs(ln(l_extendedprice / (l_quantity * 1000))))), 6) AS factor, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def typical_error(spark, d):
    ratio = F.abs(F.log(F.col("l_extendedprice") / (F.col("l_quantity") * 1000)))
    return table(spark, d, "lineitem").filter("l_quantity > 0 and l_extendedprice > 0").groupBy("l_linestatus").agg(F.round(F.exp(F.avg(ratio)), 6).alias("factor"), F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT floor(value * 10) / 1000 AS cut, event_type = 'purchase' OR value > 60 AS ok FROM events WHERE value IS NOT NULL AND value BETWEEN 0 AND 100),
g AS (SELECT floor(cut * 1000) / 1000 AS cut, count(*) AS n, count(*) FILTER (ok) AS k FROM b GROUP BY 1), r AS (SELECT cut, sum(n) OVER w AS shown, sum(k) OVER w AS hits FROM g WINDOW w AS (ORDER BY cut DESC))
SELECT cut, shown::BIGINT AS shown, round(hits / shown, 6) AS precision FROM r WHERE hits >= 0.5 * shown AND shown >= 20 ORDER BY cut LIMIT 1""")
def search_calibration(spark, d):
    rows = table(spark, d, "events").filter("value is not null and value between 0 and 100").select((F.floor(F.col("value") * 10) / 1000).alias("score"), ((F.col("event_type") == "purchase") | (F.col("value") > 60)).alias("ok"))
    return op.lowest_cut(rows, "score", "ok", 0.5, 20)


@query(f"WITH {ITEMS_SQL}, w AS (SELECT category, 1 / sqrt(count(*)) AS w FROM items GROUP BY 1) SELECT category, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights(spark, d):
    counted = items(spark, d).groupBy("category").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("w"))
    return counted.select("category", F.round(F.col("w") / F.avg("w").over(Window.partitionBy()), 6).alias("weight"))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT brand, category, count(*) AS n, quantile_cont(price, 0.5) AS m FROM items GROUP BY ALL), b AS (SELECT brand, quantile_cont(price, 0.5) AS bm FROM items GROUP BY 1)
SELECT brand, category, n, round(CASE WHEN n < 8 THEN bm ELSE m END, 6) AS baseline FROM g JOIN b USING (brand)""")
def baseline_fallback(spark, d):
    """The median of a group, or of its channel where the group has under eight items."""
    of = items(spark, d)
    groups = of.groupBy("brand", "category").agg(F.count(F.lit(1)).alias("n"), F.percentile("price", 0.5).alias("m"))
    return groups.join(of.groupBy("brand").agg(F.percentile("price", 0.5).alias("bm")), "brand").select("brand", "category", "n", F.round(F.when(F.col("n") < 8, F.col("bm")).otherwise(F.col("m")), 6).alias("baseline"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = greatest(1, ceil(0.5 * n))) AS p50, max(value) FILTER (i = greatest(1, ceil(0.95 * n))) AS p95, max(n) AS n FROM r GROUP BY 1""")
def latency_percentiles(spark, d):
    """Nearest-rank percentiles."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return table(spark, d, "events").filter("value is not null").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, bool_and(value >= 5) AS every_run, avg(CASE WHEN value >= 5 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1")
def right_in_every_run(spark, d):
    ok = F.col("value") >= 5
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(ok).alias("every_run"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("share"))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 / 255.0 AS r, (p_partkey * 91) % 256 / 255.0 AS g, (p_partkey * 53) % 256 / 255.0 AS b FROM part),
l AS (SELECT p_partkey, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS r, CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS g, CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS b FROM c),
x AS (SELECT p_partkey, (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047 AS x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883 AS z FROM l),
f AS (SELECT p_partkey, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116 END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116 END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116 END AS z FROM x)
SELECT p_partkey, round(116 * y - 16, 4) AS l, round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b FROM f""")
def colour_to_lab(spark, d):
    part = F.col("p_partkey")
    channel = lambda k: (part * k % 256).cast("double")
    lab = lab_of(channel(37), channel(91), channel(53))
    return table(spark, d, "part").select("p_partkey", *[F.round(v, 4).alias(n) for v, n in zip(lab, "lab", strict=True)])


@query("SELECT label, hist, n FROM (SELECT label, least(5, greatest(0, floor((embedding[1] + 0.5) * 6)))::BIGINT AS hist, count(*) AS n FROM embeddings GROUP BY ALL)")
def bucket_histogram(spark, d):
    place = F.least(F.lit(5), F.greatest(F.lit(0), F.floor((F.col("embedding")[0] + 0.5) * 6))).cast("long")
    return table(spark, d, "embeddings").groupBy("label", place.alias("hist")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents) WHERE turn <= 5")
def sample_per_class(spark, d):
    """A seeded sample of five of each class, by the order of a hash."""
    order = F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", "lang").withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).filter("turn <= 5").drop("turn")


_GUESSES_SQL = """g AS (SELECT event_type AS field, value < 30 AS unsure, event_id % 4 <> user_id % 3 AS changed FROM events)"""


@query(f"""WITH {_GUESSES_SQL}, s AS (SELECT field, count(*) AS items, count(*) FILTER (unsure) AS unsure, count(*) FILTER (unsure AND changed) AS unsure_corrected, count(*) FILTER (NOT unsure AND changed) AS sure_corrected FROM g GROUP BY 1)
SELECT *, CASE WHEN unsure > 0 THEN round(unsure_corrected / unsure, 3) END AS unsure_corrected_rate, CASE WHEN items > unsure THEN round(sure_corrected / (items - unsure), 3) END AS sure_corrected_rate FROM s""")
def correction_rates(spark, d):
    """How often guesses were changed, flagged ones and others."""
    changed = F.col("event_id") % 4 != F.col("user_id") % 3
    return op.correction_rates(table(spark, d, "events").withColumnRenamed("event_type", "field"), "field", F.col("value") < 30, changed)


_ANSWERS_SQL = """a AS (SELECT event_id % 200 AS id, ['click', 'login', 'view'][event_id % 200 % 3 + 1] AS expected, event_type AS chosen, event_id % 200 % 11 <> 0 AS scored FROM events), ans AS (SELECT *, scored AND expected = chosen AS ok FROM a)"""


def _answers(spark, d):
    case = F.col("event_id") % 200
    told = table(spark, d, "events").select(case.alias("id"), F.get(F.array(F.lit("click"), F.lit("login"), F.lit("view")), (case % 3).cast("int")).alias("expected"), F.col("event_type").alias("chosen"), (case % 11 != 0).alias("scored"))
    return told.withColumn("ok", F.col("scored") & (F.col("expected") == F.col("chosen")))


@query(f"""WITH {_ANSWERS_SQL} SELECT CASE WHEN grouping(expected) = 1 THEN 'All' ELSE expected END AS expected, count(DISTINCT id) AS cases, count(*) AS answers, count(*) FILTER (ok) AS n_right, round(count(*) FILTER (ok) / count(*), 6) AS rate
FROM ans WHERE scored GROUP BY ROLLUP (expected)""")
def router_accuracy(spark, d):
    return op.router_accuracy(_answers(spark, d))


@query(f"WITH {_ANSWERS_SQL} SELECT expected, chosen, count(*) AS answers FROM ans WHERE scored AND NOT ok GROUP BY ALL ORDER BY answers DESC, expected, chosen LIMIT 12")
def router_mix_ups(spark, d):
    return op.mix_ups(_answers(spark, d))


@query(f"""WITH {_ANSWERS_SQL}, c AS (SELECT id, expected, chosen, count(*) AS n, count(*) FILTER (ok) AS k FROM ans WHERE scored GROUP BY ALL),
s AS (SELECT id, expected, sum(k)::BIGINT AS n_right, sum(n)::BIGINT AS answers, string_agg(chosen || ' ' || n, ', ' ORDER BY n DESC, chosen) AS chosen FROM c GROUP BY ALL) SELECT * FROM s WHERE n_right < answers""")
def router_unsteady_cases(spark, d):
    """Cases that weren't right in every answer, with what was chosen."""
    return op.unsteady_cases(_answers(spark, d))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 OR p_size > 45 THEN 'p_size' END, CASE WHEN p_retailprice > 1500 THEN 'p_retailprice' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'p_brand' END) AS errors FROM part""")
def range_errors(spark, d):
    """What of each part is out of its range or domain."""
    errors = op.range_errors({"p_size": (5, 45), "p_retailprice": (None, 1500)}, {"p_brand": ["Brand#11", "Brand#12", "Brand#13"]})
    return table(spark, d, "part").select("p_partkey", F.array_join(errors, ",").alias("errors"))
