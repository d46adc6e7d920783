"""Wardrobe insights, explanations of outfits, labels and outfits built round a piece."""

from pyspark.sql import functions as F

from weftline.operators import advice
from weftline.operators import insights as op
from weftline.operators import outfits as sets
from weftline.plans.bind import ITEMS_SQL, WEARS_SQL, items, wears, worn
from weftline.plans.outfits import _ORDER_SQL, _OWN_SQL, COMPLETE_SQL, complete_sql, grown_sql, parts_sql, score_sql, wardrobe
from weftline.plans.registry import query
from weftline.session import table

_USE_SQL = complete_sql(("dress", "traditional", "swimwear")) + f""", used AS (SELECT owner, unnest(ids) AS item_id FROM done WHERE score >= {sets.GOOD_OUTFIT}), n AS (SELECT owner, item_id, count(*) AS n FROM used GROUP BY ALL),
u AS (SELECT w.owner, w.item_id, s.slot, coalesce(n, 0) AS outfits, CASE WHEN s.slot IN ('upper', 'lower', 'full') THEN CASE WHEN n > 0 THEN 'versatile' ELSE 'unmatched' END END AS standing
  FROM wardrobe w JOIN slots s USING (category) LEFT JOIN n USING (owner, item_id))"""


@query(_USE_SQL + " SELECT owner, item_id, slot, outfits, standing FROM u")
def wardrobe_use(spark, d):
    """In how many good completed outfits each owned item is; main pieces in none are unmatched."""
    return op.outfit_use(wardrobe(spark, d), "owner").drop("firsts")


@query(_USE_SQL + f""", g AS (SELECT owner, count(*) AS good FROM done WHERE score >= {sets.GOOD_OUTFIT} GROUP BY 1),
a AS (SELECT owner, count(*) FILTER (slot = 'upper') AS u, count(*) FILTER (slot = 'lower') AS l, count(*) FILTER (slot = 'full') AS f, count(*) FILTER (slot = 'feet') AS s,
  coalesce(string_agg(item_id, ',' ORDER BY outfits DESC, item_id) FILTER (standing = 'versatile'), '') AS versatile, coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (standing = 'unmatched'), '') AS unmatched FROM u GROUP BY 1)
SELECT a.owner, coalesce(good, 0) AS good_outfits, versatile, unmatched, u * l + f <= {sets.TOP_CORES} AS complete, l AS new_tops, u AS new_bottoms,
  concat_ws(',', CASE WHEN u + l + f = 0 THEN 'main' WHEN u > 0 AND l + f = 0 THEN 'bottom' WHEN l > 0 AND u + f = 0 THEN 'top' END, CASE WHEN s = 0 THEN 'shoes' END) AS missing FROM a LEFT JOIN g USING (owner)""")
def wardrobe_insights(spark, d):
    told = op.insights(wardrobe(spark, d), "owner")
    return told.select("owner", "good_outfits", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("versatile", "unmatched", "missing")], "complete", "new_tops", "new_bottoms")


@query(_ORDER_SQL + f""", ks AS (SELECT k, item_id, colour, grp FROM m WHERE colour IS NOT NULL),
prs AS (SELECT a.k, a.item_id AS i, b.item_id AS j, a.colour AS a, b.colour AS b, CASE WHEN a.colour = b.colour THEN CASE WHEN a.grp = 'neutral' THEN 1.0 ELSE {sets.SAME_COLOUR} END ELSE coalesce(cp.s, gp.s) END::DOUBLE AS s FROM ks a JOIN ks b ON a.k = b.k AND a.item_id < b.item_id
  LEFT JOIN cp ON cp.a = least(a.colour, b.colour) AND cp.b = greatest(a.colour, b.colour) LEFT JOIN gp ON gp.a = least(a.grp, b.grp) AND gp.b = greatest(a.grp, b.grp)),
best AS (SELECT k, min(s) AS low, arg_min(a || ':' || b, (-s, i, j)) FILTER (a <> b) AS pair, max(s) FILTER (a <> b) AS top FROM prs GROUP BY k),
calm AS (SELECT k, count(*) FILTER (grp = 'neutral') AS n FROM ks GROUP BY k),
pats AS (SELECT k, count(*) AS n, count(*) FILTER (pattern <> 'solid') AS bold, max(pattern) FILTER (pattern <> 'solid') AS name FROM pat GROUP BY k)
SELECT p.k AS outfit_id, concat_ws(';', CASE WHEN low >= {op.NO_CLASH} THEN CASE WHEN top >= {op.STRENGTH_COLOUR_PAIR} THEN 'colour_pair:' || pair WHEN calm.n >= 2 THEN 'colour_neutral_base:' || calm.n END END,
  CASE WHEN bold = 1 THEN 'pattern_one_bold:' || name WHEN pats.n >= 2 AND bold = 0 THEN 'pattern_calm' END, CASE WHEN structure = 1 THEN 'structure_complete' END) AS strengths
FROM parts p LEFT JOIN best USING (k) LEFT JOIN calm USING (k) LEFT JOIN pats USING (k)""")
def outfit_strengths(spark, d):
    return sets.as_sets(wears(spark, d), "outfit_id").select("outfit_id", F.array_join(op.strengths(F.col("items")), ";").alias("strengths"))


@query(_ORDER_SQL + f""", ks AS (SELECT k, item_id, colour, grp FROM m WHERE colour IS NOT NULL), prs AS (SELECT a.k, a.item_id AS i, b.item_id AS j, a.colour || ':' || b.colour AS pair, CASE WHEN a.colour = b.colour THEN CASE WHEN a.grp = 'neutral' THEN 1.0 ELSE {sets.SAME_COLOUR} END ELSE coalesce(cp.s, gp.s) END::DOUBLE AS s
  FROM ks a JOIN ks b ON a.k = b.k AND a.item_id < b.item_id LEFT JOIN cp ON cp.a = least(a.colour, b.colour) AND cp.b = greatest(a.colour, b.colour) LEFT JOIN gp ON gp.a = least(a.grp, b.grp) AND gp.b = greatest(a.grp, b.grp)),
cl AS (SELECT k, 'colour_clash:' || arg_min(pair, (s, i, j)) AS line FROM prs GROUP BY k HAVING min(s) < {op.NO_CLASH}),
bo AS (SELECT k, 'colour_too_bold:' || string_agg(DISTINCT colour, ',' ORDER BY colour) FILTER (grp NOT IN ('neutral', 'metal')) AS line FROM ks GROUP BY k HAVING count(DISTINCT colour) FILTER (grp NOT IN ('neutral', 'metal')) > {sets.MOST_BOLD}),
pw AS (SELECT p.k, p.pattern || ':' || q.pattern AS pair, s, p.item_id AS i, q.item_id AS j FROM pat p JOIN pat q ON p.k = q.k AND p.item_id < q.item_id JOIN pp ON pp.a = least(p.pattern, q.pattern) AND pp.b = greatest(p.pattern, q.pattern)),
pc AS (SELECT k, 'pattern_clash:' || arg_min(pair, (s, i, j)) AS line FROM pw GROUP BY k HAVING min(s) < {op.NO_CLASH}),
sw AS (SELECT a.k, a.sub_category || ':' || b.sub_category AS pair, sp.s, a.item_id AS i, b.item_id AS j FROM m a JOIN m b ON a.k = b.k AND a.item_id < b.item_id JOIN sp ON sp.a = least(a.sub_category, b.sub_category) AND sp.b = greatest(a.sub_category, b.sub_category)),
sc AS (SELECT k, 'structure_pair:' || arg_min(pair, (s, i, j)) AS line FROM sw GROUP BY k HAVING min(s) < {op.NO_CLASH}),
ov AS (SELECT k, string_agg('structure_over_limit:' || category || ':' || n, ';' ORDER BY n DESC, category) AS line FROM (SELECT k, category, count(*) AS n FROM m GROUP BY k, category HAVING count(*) > any_value(most)) GROUP BY k)
SELECT st.k AS outfit_id, concat_ws(';', cl.line, bo.line, pc.line, CASE WHEN (fl OR up AND lo) AND (ft OR fl AND sw) THEN NULL WHEN fl OR up AND lo THEN 'structure_no_shoes' WHEN up OR lo THEN 'structure_incomplete:top_or_bottom' ELSE 'structure_incomplete:main_piece' END,
  CASE WHEN fl AND lo THEN 'structure_full_and_bottom' END, ov.line, sc.line) AS problems FROM st LEFT JOIN cl USING (k) LEFT JOIN bo USING (k) LEFT JOIN pc USING (k) LEFT JOIN ov USING (k) LEFT JOIN sc USING (k)""")
def outfit_problems(spark, d):
    """What is wrong in each outfit, its style aside."""
    return sets.as_sets(wears(spark, d), "outfit_id").select("outfit_id", F.array_join(op.problems(F.col("items")), ";").alias("problems"))


@query(_ORDER_SQL + """, w AS (SELECT k, CASE WHEN colour IS NULL THEN 0 ELSE 30 END + CASE WHEN pattern IS NULL THEN 0 ELSE 15 END + 20 AS w, colour, pattern FROM parts)
SELECT k AS outfit_id, 'style' AS part, false AS counted, 0.0::DOUBLE AS max_points, 'no_vectors' AS why_not FROM w
UNION ALL SELECT k, 'colour', colour IS NOT NULL, CASE WHEN colour IS NULL THEN 0 ELSE round_even(round(3000.0::DOUBLE / w, 9), 1) END, CASE WHEN colour IS NULL THEN 'no_colours' END FROM w
UNION ALL SELECT k, 'pattern', pattern IS NOT NULL, CASE WHEN pattern IS NULL THEN 0 ELSE round_even(round(1500.0::DOUBLE / w, 9), 1) END, CASE WHEN pattern IS NULL THEN 'no_patterns' END FROM w
UNION ALL SELECT k, 'structure', true, round_even(round(2000.0::DOUBLE / w, 9), 1), NULL FROM w""")
def part_reasons(spark, d):
    """What each part of a score can give at most, and why it gives nothing."""
    items_ = F.col("items")
    parts = {"style": F.lit(None).cast("double"), "colour": sets.colour_part(items_), "pattern": sets.pattern_part(items_), "structure": sets.structure_part(items_)}
    whole = sets.as_sets(wears(spark, d), "outfit_id").withColumn("_p", F.struct(*[c.alias(p) for p, c in parts.items()]))
    return whole.select("outfit_id", F.explode(op.part_reasons({p: F.col(f"_p.{p}") for p in parts})).alias("r")).select("outfit_id", "r.*")


@query(f"""WITH s AS (SELECT o_custkey AS owner, o_orderkey AS outfit_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 37) % 100 / 100.0 END::DOUBLE AS similarity FROM orders WHERE o_orderkey % 4 < 2),
r AS (SELECT *, count(similarity) OVER (PARTITION BY owner) AS n, row_number() OVER (PARTITION BY owner, similarity IS NULL ORDER BY similarity DESC, outfit_id) - 1 AS place FROM s)
SELECT owner, outfit_id, CASE WHEN similarity IS NULL THEN NULL WHEN n >= 3 THEN ['safe', 'bolder', 'experimental'][place * 3 // n + 1] WHEN similarity >= {op.SAFE_CUT} THEN 'safe' WHEN similarity >= {op.BOLDER_CUT} THEN 'bolder' ELSE 'experimental' END AS label FROM r""")
def label_shown(spark, d):
    """Labels of shown outfits relative to each other; under three of an owner the cuts hold."""
    key = F.col("o_orderkey")
    shown = table(spark, d, "orders").filter(key % 4 < 2).select(F.col("o_custkey").alias("owner"), key.alias("outfit_id"), F.when(key % 5 != 0, (key * 37) % 100 / 100.0).alias("similarity"))
    return op.shown_labels(shown, "owner", "outfit_id", "similarity").select("owner", "outfit_id", "label")


@query("WITH " + WEARS_SQL + f""", n AS (SELECT o_custkey AS owner, count(DISTINCT l_partkey) AS usable FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
g AS (SELECT outfit_id, 'guessed_field:' || item_id || ':' || unnest(list_concat(CASE WHEN pattern_conf < 0.3 THEN ['pattern'] ELSE [] END, CASE WHEN item_id % 11 = 0 AND item_id % 2 = 1 THEN ['sub_category'] ELSE [] END)) AS why FROM wears),
r AS (SELECT outfit_id, count(*) AS n, string_agg(why, ';' ORDER BY why) AS why FROM g GROUP BY 1)
SELECT o_orderkey AS outfit_id, concat_ws(';', CASE WHEN usable < {op.LEAST_WARDROBE} THEN 'small_wardrobe' END, why) AS reasons, CASE coalesce(r.n, 0) + (usable < {op.LEAST_WARDROBE})::INT WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM orders JOIN n ON owner = o_custkey LEFT JOIN r ON outfit_id = o_orderkey WHERE o_orderkey IN (SELECT outfit_id FROM wears)""")
def outfit_confidence(spark, d):
    """What lowers the confidence of an outfit: a small wardrobe and guessed fields that nobody corrected."""
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("outfit_id"), F.col("o_custkey").alias("owner"))
    usable = owners.join(table(spark, d, "lineitem"), F.col("outfit_id") == F.col("l_orderkey")).groupBy("owner").agg(F.countDistinct("l_partkey").alias("usable"))
    unsure = F.array_compact(F.array(F.when(F.col("pattern_conf") < 0.3, "pattern"), F.when(F.col("item_id") % 11 == 0, "sub_category")))
    members = wears(spark, d).join(owners.join(usable, "owner"), "outfit_id").select("outfit_id", "item_id", "usable", unsure.alias("unsure"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("sub_category"))).alias("corrected"))
    return op.confidence(members, "outfit_id", "usable", "unsure", "corrected").select("outfit_id", F.array_join("reasons", ";").alias("reasons"), "confidence")


_BUILD_FROM = "WITH " + ITEMS_SQL + ", " + _OWN_SQL + f""", s0 AS (SELECT owner, owner::VARCHAR AS k, [min(item_id)] AS ids, NULL::DOUBLE AS score FROM wardrobe GROUP BY owner),
{grown_sql("t1", "s0", None, tries=True)}, r1 AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY score DESC, new) AS place FROM t1), b1 AS (SELECT owner, k, ids, score, new AS first FROM r1 WHERE place <= {op.FIRST_ADDITIONS})"""
_BUILD_SQL = _BUILD_FROM + "".join(f", {grown_sql(f'b{i + 1}', f'b{i}', None, open_only=True)}" for i in range(1, op.MOST_ADDITIONS))


@query(_BUILD_SQL + f" SELECT s.owner, b1.first, array_to_string(list_sort(list_transform(s.ids, lambda x: x::VARCHAR)), '|') AS outfit_key, s.score FROM b{op.MOST_ADDITIONS} s JOIN b1 USING (k)")
def build_outfits(spark, d):
    """Outfits built round each customer's least item."""
    owned = wardrobe(spark, d)
    chosen = owned.groupBy("owner").agg(F.array(F.min_by(sets.as_items(), F.col("item_id"))).alias("items"))
    return op.build(chosen, owned, "owner").select("owner", "first", advice.key_of(F.col("items")).alias("outfit_key"), "score")


@query(COMPLETE_SQL + """, lists AS (SELECT owner, ids, score FROM done UNION ALL SELECT owner, ids, score - 1 FROM s0 UNION ALL SELECT owner, ids, score - owner % 3 FROM done)
SELECT owner, array_to_string(list_sort(list_transform(ids, lambda x: x::VARCHAR)), '|') AS outfit_key, max(score) AS score FROM lists GROUP BY 1, 2""")
def merged_lists(spark, d):
    """Three candidate lists as one: bare cores at one point less, completed ones, and these with some points off."""
    rows = sets.with_completed(sets.with_cores(sets.held_by(wardrobe(spark, d), "owner")))
    less = lambda of, points: F.transform(of, lambda s: F.struct(s["at"].alias("at"), (s["score"] - points).alias("score")))
    lists = rows.select("owner", "held", F.explode(F.concat(less("cores", F.lit(1)), "done", less("done", F.col("owner") % 3))).alias("s"))
    return op.merged(lists.select("owner", sets.picked(F.col("s.at")).alias("items"), "s.score"), "owner").select("owner", "outfit_key", "score")


@query()
def intruder_test(spark, d):
    """An item of each outfit gives way to a fake one; is it found as the weakest? Held against plain Python by a test."""
    pool, lines = items(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id"))
    worn_by, kinds = worn(spark, d)
    tests = advice.swap_tests(worn_by, "outfit_id", kinds, "swap-v1")
    return op.intruders(lines, tests, pool, "outfit_id", n_rows=lines.count())
