"""Advice, evaluation-set and checking queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.exprs import hash_percent, split_of
from weftline.operators import advice as op
from weftline.operators import outfits as sets
from weftline.operators import vectors as vec
from weftline.operators.mapping import coverage
from weftline.operators.prices import percentiles, read_quantiles, references
from weftline.operators.profiles import average_ranks
from weftline.plans.bind import ITEMS_SQL, WEARS_SQL, items, vectors, wears
from weftline.plans.outfits import _OWN_SQL, parts_sql, score_sql, wardrobe
from weftline.plans.prices import quantile_sql
from weftline.plans.registry import query
from weftline.session import table
from weftline.session_dirs import ensure_checkpoint_dir


def _orders(spark, d):
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("outfit_id"), F.col("o_custkey").alias("owner"))
    return sets.as_sets(wears(spark, d).join(owners, "outfit_id"), "owner", "outfit_id")


@query("WITH " + WEARS_SQL + ", " + _OWN_SQL + f""", s AS (SELECT o_custkey AS owner, w.* FROM wears w JOIN orders ON o_orderkey = outfit_id), own AS (SELECT DISTINCT owner, outfit_id FROM s),
tries AS (SELECT o.outfit_id || ':' || w.item_id AS k, o.outfit_id, w.item_id AS candidate FROM own o JOIN wardrobe w ON w.owner = o.owner WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.outfit_id = o.outfit_id AND x.item_id = w.item_id)),
cols AS (SELECT t.k, x.item_id, x.category, x.sub_category, x.colour, x.pattern, x.pattern_conf FROM tries t JOIN s x ON x.outfit_id = t.outfit_id UNION ALL SELECT t.k, i.item_id, i.category, i.sub_category, i.colour, i.pattern, i.pattern_conf FROM tries t JOIN items i ON i.item_id = t.candidate),
lim AS (SELECT k FROM cols WHERE sub_category IS NOT NULL GROUP BY k, sub_category HAVING count(*) > 1 UNION SELECT k FROM cols GROUP BY k, category HAVING count(*) > CASE category WHEN 'accessory' THEN 4 ELSE 1 END),
members AS (SELECT * FROM cols WHERE k NOT IN (SELECT k FROM lim)), {parts_sql()},
r AS (SELECT t.outfit_id, t.candidate, {score_sql()} AS score FROM parts JOIN tries t USING (k)), q AS (SELECT *, row_number() OVER (PARTITION BY outfit_id ORDER BY score DESC, candidate) AS place FROM r) SELECT outfit_id, candidate, score, place FROM q WHERE place <= 5""")
def complete_topk(spark, d):
    return op.complete_with(_orders(spark, d), wardrobe(spark, d), "outfit_id", "owner")


@query()
def buy_good_counts(spark, d):
    """Each customer is offered the first item by number that they lack; tests hold the counts against plain Python."""
    owned = wardrobe(spark, d)
    wanted = owned.groupBy("owner").agg(F.collect_set("item_id").alias("ids")).select("owner", F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.pmod(F.col("owner") * 7 + i, F.lit(200)).cast("long")), lambda i: ~F.array_contains("ids", i)), F.lit(0)).alias("item_id"))
    return op.buy_advice(owned, wanted.join(items(spark, d), "item_id"), "owner")


@query("""WITH r AS (SELECT c_custkey, count(DISTINCT l_partkey) AS wardrobe, c_custkey % 4 AS pairing, c_custkey % 3 = 0 AS guessed, c_nationkey < 6 AS fills, c_custkey % 10 / 10.0 AS style, c_acctbal AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_custkey, concat_ws('|', CASE WHEN wardrobe < 8 THEN 'small_wardrobe' END, CASE WHEN pairing = 0 THEN 'no_pairing_piece' END, CASE WHEN guessed THEN 'guessed_field' END, CASE WHEN fills THEN 'fills_gap' END, CASE WHEN style < 0.5 THEN 'far_from_style' END, CASE WHEN price > 0.3 * 9000 THEN 'over_budget' END) AS codes,
CASE (wardrobe < 8)::INT + (pairing = 0)::INT + guessed::INT WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM r""")
def verdict_assess(spark, d):
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("n"))
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").join(lines, key == F.col("o_custkey"), "left").select(
        key, F.coalesce("n", F.lit(0)).alias("wardrobe"), (key % 4).alias("pairing"), (key % 3 == 0).alias("guessed"), (F.col("c_nationkey") < 6).alias("fills_gap"),
        (key % 10 / 10.0).alias("style"), F.col("c_acctbal").alias("price"), F.lit(9000.0).alias("budget"),
    )
    return op.assess(rows).select("c_custkey", F.array_join("codes", "|").alias("codes"), "confidence")


@query()
def pick_three(spark, d):
    """A draw by hash within a fold; tests state its rules."""
    scored = _orders(spark, d).withColumn("score", sets.scored(F.col("items"))).withColumn("outfit_key", op.key_of(F.col("items")))
    best = scored.dropDuplicates(["owner", "outfit_key"])
    band = F.ntile(3).over(Window.partitionBy("owner").orderBy(F.desc("score"), "outfit_key"))
    label = F.when(band == 1, "safe").when(band == 2, "bolder").otherwise("experimental")
    return op.pick_three(best.withColumn("label", label), "owner", "today")


@query()
def resolve_clashes(spark, d):
    """The order of pieces decides, which is a fold; tests state its rules."""
    told = _orders(spark, d).withColumn("told", op.resolved_with_notes(F.col("items")))
    return told.select("outfit_id", op.key_of(F.col("told.kept")).alias("outfit_key"), F.size("told.notes").alias("dropped"))


@query(f"WITH {ITEMS_SQL} SELECT item_id, pattern_conf < 0.6 OR pattern_conf - (item_id % 6) / 10.0 < 0.15 AS unsure_pattern, pattern_conf < 0.7 OR pattern_conf - (item_id % 6) / 10.0 < 0.15 AS unsure_colour FROM items")
def unsure_flags(spark, d):
    best, second = F.col("pattern_conf"), F.col("item_id") % 6 / 10.0
    return items(spark, d).select("item_id", op.is_unsure("pattern", best, second).alias("unsure_pattern"), op.is_unsure("colour", best, second).alias("unsure_colour"))


@query("WITH p AS (SELECT c_nationkey AS key, n_regionkey AS parent, n_nationkey AS child, count(*)::DOUBLE AS prob FROM customer, nation WHERE (c_custkey + n_nationkey) % 7 = 0 GROUP BY ALL), f AS (SELECT * FROM p WHERE parent = key % 5) SELECT key, child, round(prob / sum(prob) OVER (PARTITION BY key), 6) AS prob FROM f")
def within_parent(spark, d):
    pairs = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation"))).filter((F.col("c_custkey") + F.col("n_nationkey")) % 7 == 0)
    probs = pairs.groupBy(F.col("c_nationkey").alias("key"), F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child")).agg(F.count(F.lit(1)).cast("double").alias("prob"))
    return op.within_parent(probs.withColumn("chosen", F.col("key") % 5), "key", "child", "parent", "chosen").select("key", "child", F.round("prob", 6).alias("prob"))


_BOX = "SELECT DISTINCT l_orderkey AS image, l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE l_partkey % 9 END)::DOUBLE AS w, (CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE l_suppkey % 7 END)::DOUBLE AS h, l_linenumber % 2 = 1 AS part FROM lineitem"


@query(f"""WITH b AS ({_BOX}), j AS (SELECT p.image, p.id AS part, o.id AS owner, greatest(least(p.x + p.w, o.x + o.w) - greatest(p.x, o.x), 0) * greatest(least(p.y + p.h, o.y + o.h) - greatest(p.y, o.y), 0) / (p.w * p.h) AS share FROM b p JOIN b o ON p.image = o.image AND p.part AND NOT o.part AND p.w * p.h > 0),
f AS (SELECT *, count(*) OVER (PARTITION BY image, part) AS n FROM j WHERE share >= 0.8) SELECT image, part, owner, round(share, 6) AS share FROM f WHERE n = 1""")
def spatial_unique_owner(spark, d):
    """Small boxes of an order that lie in exactly one large one."""
    small = F.col("l_linenumber") % 2 == 1
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("id"), (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"),
        F.when(small, F.col("l_partkey") % 9).otherwise(40).cast("double").alias("w"), F.when(small, F.col("l_suppkey") % 7).otherwise(50).cast("double").alias("h"), small.alias("part"),
    ).distinct()
    return op.unique_owner(boxes.filter("part").drop("part"), boxes.filter("not part").drop("part"), "image")


@query("WITH " + WEARS_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY outfit_id ORDER BY md5('s1:' || outfit_id || ':' || item_id), item_id) AS t FROM wears),
r AS (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY md5('s1:' || item_id), item_id) AS place, count(*) OVER (PARTITION BY category) AS size FROM items),
o AS (SELECT c.outfit_id, c.item_id AS true_id, b.item_id AS other, (b.place - a.place + a.size) % a.size AS step FROM c JOIN r a USING (category, item_id) JOIN r b ON b.category = c.category ANTI JOIN wears w ON w.outfit_id = c.outfit_id AND w.item_id = b.item_id WHERE t = 1),
l AS (SELECT outfit_id, true_id, list(other ORDER BY step) AS others FROM o GROUP BY ALL) SELECT outfit_id, true_id, others[1] AS fake_id FROM l WHERE len(others) >= 3""")
def swap_tests(spark, d):
    return op.swap_tests(wears(spark, d), "outfit_id", items(spark, d), "s1").drop("wrong")


_TIMES = " + ".join(f"(u >= {c})::INT" for c in op.POISSON)


@query("""WITH e AS (SELECT o_orderpriority AS p, o_totalprice AS v, i, md5('b:' || i || ':' || o_orderkey) AS h FROM orders, range(1, 501) t(i)),
u AS (SELECT p, v, i * 4 + j AS i, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e, range(4) t(j)),
m AS (SELECT p, i, sum(v * n) / sum(n) AS m FROM (SELECT *, """ + _TIMES + """ AS n FROM u) GROUP BY ALL),
q AS (SELECT p, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM orders JOIN q ON p = o_orderpriority GROUP BY 1""")
def bootstrap_mean(spark, d):
    out = op.bootstrap(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", "o_totalprice", ["o_orderpriority"], "b")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3)
SELECT t.a, t.b, concat_ws('|', CASE WHEN x.category = y.category THEN 'category' END, CASE WHEN x.colour = y.colour THEN 'colour' END, CASE WHEN x.pattern = y.pattern THEN 'pattern' END) AS shared,
concat_ws('|', CASE WHEN x.category <> y.category THEN 'category' END, CASE WHEN x.colour <> y.colour THEN 'colour' END, CASE WHEN x.pattern <> y.pattern THEN 'pattern' END) AS differing FROM t JOIN items x ON x.item_id = t.a JOIN items y ON y.item_id = t.b""")
def shared_attributes(spark, d):
    pairs = vec.twins(vectors(spark, d), "category", 0.3).select("a", "b")
    out = op.shared_fields(pairs, items(spark, d), ["category", "colour", "pattern"])
    return out.select("a", "b", F.array_join("shared", "|").alias("shared"), F.array_join("differing", "|").alias("differing"))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a), c AS (SELECT n AS node, min(m) AS root FROM reach GROUP BY n) SELECT node, root, ('0x' || substr(md5('fold:' || root), 1, 8))::BIGINT % 100 % 5 AS fold FROM c""")
def grouped_folds(spark, d):
    """Near copies share a fold: it comes from their group."""
    ensure_checkpoint_dir(spark)
    rows = vectors(spark, d)
    groups = vec.linked_groups(vec.twins(rows, "category", 0.3), rows.select(F.col("item_id").alias("node")))
    return groups.withColumn("fold", hash_percent(F.col("root"), "fold") % 5)


@query("""WITH s AS (SELECT p_partkey, p_brand AS channel, (p_partkey * 31) % 97 AS score, p_retailprice AS price FROM part), k AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY score) + (count(*) OVER (PARTITION BY channel, score) - 1) / 2 AS rk, count(*) OVER (PARTITION BY channel) AS n FROM s),
q AS (SELECT channel, list_sort(list(price)) AS l FROM s GROUP BY 1), p AS (SELECT *, (rk - 0.5) / n AS x FROM k JOIN q USING (channel)) SELECT p_partkey, round(""" + quantile_sql("x") + """, 4) AS served FROM p""")
def served_median(spark, d):
    """A score's average rank within its channel, read off the channel's own prices."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("channel"), F.lit("x").alias("category"), (F.col("p_partkey") * 31 % 97).alias("score"), F.col("p_retailprice").alias("price"))
    ranked = average_ranks(rows, "score", ["channel"], "rk").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("channel")))
    read = read_quantiles(ranked, references(rows, "channel", "category", "price"), "channel", F.lit("*"), {"served": (F.col("rk") - 0.5) / F.col("n")})
    return read.select("p_partkey", F.round(F.round("served", 9), 4).alias("served"))


@query("""WITH a AS (SELECT vec_id, label, embedding[1] AS x FROM embeddings), r AS (SELECT *, (rank() OVER (PARTITION BY label ORDER BY x) - 1)::DOUBLE / count(*) OVER (PARTITION BY label) AS pct FROM a) SELECT vec_id, round(pct, 6) AS pct, pct < 0.1 AS worn_hint FROM r""")
def condition_hint(spark, d):
    """Photos whose score is in the lowest tenth of their group's."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"))
    out = percentiles(rows, "x", ["label"])
    return out.select("vec_id", F.round("pct", 6).alias("pct"), (F.col("pct") < 0.1).alias("worn_hint"))


@query("""WITH c AS (SELECT p_brand, count(*) AS ads FROM part GROUP BY 1), r AS (SELECT p_partkey, p.p_brand, ads, p_size % 6 + 1 AS photo_rank, p_retailprice AS asked, 900 + p_partkey % 700 AS usual FROM part p JOIN c USING (p_brand))
SELECT p_partkey, CASE WHEN ads < 8 THEN 'unknown_brand' WHEN photo_rank > 3 AND asked < 0.9 * usual THEN 'ask_photo' WHEN photo_rank > 3 THEN 'not_seen' ELSE 'ok' END AS result FROM r""")
def label_check(spark, d):
    """A claimed brand against what the photo shows and the price: both must speak against it before a photo is asked for."""
    part = table(spark, d, "part")
    rows = part.join(part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("ads")), "p_brand")
    unseen, cheap = F.col("p_size") % 6 + 1 > 3, F.col("p_retailprice") < 0.9 * (900 + F.col("p_partkey") % 700)
    return rows.select("p_partkey", F.when(F.col("ads") < 8, "unknown_brand").when(unseen & cheap, "ask_photo").when(unseen, "not_seen").otherwise("ok").alias("result"))


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT unnest(string_split(name, ' ')) AS word, item_id FROM items), r AS (SELECT * FROM (VALUES ('red', 3, 'colour'), ('blue', 2, 'colour'), ('small', 1, 'size'), ('large', 5, 'size'), ('widget', 4, 'type')) t(word, score, source))
SELECT item_id, min(score)::INTEGER AS coverage, array_to_string(list_sort(list_distinct(list(source))), '|') AS coverage_from FROM w JOIN r USING (word) GROUP BY 1""")
def coverage_min(spark, d):
    """The least score that any of an item's words gives, and the sorted kinds of words that gave one."""
    rules = spark.createDataFrame([("word", "red", 3, "colour"), ("word", "blue", 2, "colour"), ("word", "small", 1, "size"), ("word", "large", 5, "size"), ("word", "widget", 4, "type")], "kind string, name string, score int, source string")
    told = items(spark, d).select("item_id", F.lit("word").alias("kind"), F.explode(F.split("name", " ")).alias("name"))
    return coverage(told, rules, "item_id")


@query("WITH p AS (SELECT p_partkey, [p_partkey % 5 + 1, p_size % 7 + 1, p_partkey % 3 + 1]::DOUBLE[] AS x, p_type = 'STANDARD' AS metal_ok FROM part), z AS (SELECT p_partkey, CASE WHEN metal_ok THEN x ELSE [x[1], x[2], 0.0] END AS x FROM p) SELECT p_partkey, list_transform(x, lambda v: round(v / list_sum(x), 6)) AS probs FROM z")
def metal_zeroed(spark, d):
    """Chances of metal colours count for some categories only; the rest are scaled to sum to 1."""
    x = [(F.col("p_partkey") % 5 + 1).cast("double"), (F.col("p_size") % 7 + 1).cast("double"), F.when(F.col("p_type") == "STANDARD", (F.col("p_partkey") % 3 + 1).cast("double")).otherwise(0.0)]
    return table(spark, d, "part").select("p_partkey", F.array(*[F.round(v / (x[0] + x[1] + x[2]), 6) for v in x]).alias("probs"))


@query("WITH " + WEARS_SQL + ", members AS (SELECT outfit_id AS k, * FROM wears), " + parts_sql() + """, w AS (SELECT * FROM (VALUES ('style', 0.35::DOUBLE), ('colour', 0.30::DOUBLE), ('pattern', 0.15::DOUBLE), ('structure', 0.20::DOUBLE)) t(part, weight)),
n AS (SELECT 'colour' AS part, count(colour) AS counted FROM parts UNION ALL SELECT 'pattern', count(pattern) FROM parts UNION ALL SELECT 'structure', count(structure) FROM parts)
SELECT part, weight, round(weight / sum(weight) OVER (), 6) AS share, coalesce(counted, 0) AS counted FROM w LEFT JOIN n USING (part)""")
def scoring_weights(spark, d):
    """What each part weighs, its share, and in how many outfits it counts (style needs vectors, which these have not)."""
    of = {"colour": sets.colour_part, "pattern": sets.pattern_part, "structure": sets.structure_part}
    told = sets.as_sets(wears(spark, d), "outfit_id").agg(*[F.count(f(F.col("items"))).alias(p) for p, f in of.items()])
    total = sum(sets.WEIGHTS.values())
    row = lambda p, w: F.struct(F.lit(p).alias("part"), F.lit(w).alias("weight"), F.round(F.lit(w / total), 6).alias("share"), (F.col(p) if p in of else F.lit(0)).cast("long").alias("counted"))
    return told.select(F.inline(F.array(*[row(p, w) for p, w in sets.WEIGHTS.items()])))


@query("SELECT p_partkey, CASE WHEN sub IS NOT NULL AND parent <> category THEN NULL ELSE sub END AS sub, list_sort(list_distinct(list_concat(['colour'], CASE WHEN p_size % 2 = 0 THEN ['pattern'] ELSE ['colour'] END))) AS corrected FROM (SELECT p_partkey, p_size, p_type AS category, p_brand AS sub, ['ECONOMY', 'PROMO', 'STANDARD'][p_partkey % 3 + 1] AS parent FROM part)")
def apply_corrections(spark, d):
    """A sub-category that isn't of the category is cleared; what was corrected before and now is one set."""
    parent = F.get(F.array(F.lit("ECONOMY"), F.lit("PROMO"), F.lit("STANDARD")), (F.col("p_partkey") % 3).cast("int"))
    sub = F.when(~(F.col("p_brand").isNotNull() & (parent != F.col("p_type"))), F.col("p_brand"))
    new = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("pattern"))).otherwise(F.array(F.lit("colour")))
    return table(spark, d, "part").select("p_partkey", sub.alias("sub"), F.array_sort(F.array_union(F.array(F.lit("colour")), new)).alias("corrected"))


@query(f"WITH {ITEMS_SQL} SELECT category, coalesce(sum(n), 0)::BIGINT AS n, ordinal FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(sets.SLOTS)) + ") v(category, ordinal) LEFT JOIN (SELECT category, count(*) AS n FROM items WHERE colour IN ('black', 'white', 'grey') GROUP BY 1) USING (category) GROUP BY ALL")
def wardrobe_counts(spark, d):
    """Counts in the vocabulary's own order, 0 for what one lacks."""
    order = F.broadcast(spark.createDataFrame(list(zip(sets.SLOTS, range(len(sets.SLOTS)), strict=True)), "category string, ordinal int"))
    counted = items(spark, d).filter(F.col("colour").isin("black", "white", "grey")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return order.join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "ordinal")


@query(f"WITH {ITEMS_SQL}, k AS (SELECT item_id, CASE WHEN category = 'bag' THEN 'i' || item_id ELSE 'p' || item_id // 2 END AS picture FROM items), d AS (SELECT picture, min(item_id) AS prediction FROM k GROUP BY 1) SELECT item_id, prediction FROM k JOIN d USING (picture)")
def fan_out_predictions(spark, d):
    """What is computed once for each picture goes back to all its rows."""
    key = F.when(F.col("category") == "bag", F.concat(F.lit("i"), "item_id")).otherwise(F.concat(F.lit("p"), F.floor(F.col("item_id") / 2)))
    rows = items(spark, d).select("item_id", key.alias("picture"))
    return rows.join(rows.groupBy("picture").agg(F.min("item_id").alias("prediction")), "picture").select("item_id", "prediction")


@query()
def linear_probe(spark, d):
    """Softmax regression on the vectors, trained where the hash says train and told for all."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, d).select("item_id", F.col("category").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), split_of(F.col("item_id")).alias("split"))
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=0.01).fit(rows.filter("split = 'train'"))
    return model.transform(rows).select("item_id", "split", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


@query()
def ridge_price(spark, d):
    """Ridge regression of the logged price on an item's numbers, told as a score for the rank map."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = table(spark, d, "part").select("p_partkey", F.log("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 100).cast("double").alias("mod"), (F.col("p_partkey") / 1000).alias("row"))
    ready = VectorAssembler(inputCols=["size", "mod", "row"], outputCol="features").transform(rows)
    model = LinearRegression(elasticNetParam=0.0, regParam=0.1).fit(ready)
    return model.transform(ready).select("p_partkey", F.round("prediction", 6).alias("score"))
