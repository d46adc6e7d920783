"""Queries on made-up wardrobes, as-of facts, colour features and concept rankings."""

from pyspark.sql import functions as F

from weftline.functions.exprs import signed_round, split_of
from weftline.operators import boosting, calibration, colours
from weftline.operators import vectors as vec
from weftline.operators.timeline import as_of
from weftline.plans.bind import ITEMS_SQL, items, vectors
from weftline.plans.registry import query
from weftline.plans.vectors import _DOT, _Q, queries_of
from weftline.session import table

SEED, SIZE, TARGET = "w1", 30, 0.5


def _u(*parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _stretch(j: str, among: str, count: str) -> str:
    return f"floor(({j}) * ({among}) / {count})::BIGINT"


_WARDROBES_SQL = f"""WITH {ITEMS_SQL}, pool AS (SELECT vec_id AS item_id, label AS kind, pattern AS colour, embedding, {_u("vec_id")} AS u FROM embeddings JOIN items ON item_id = vec_id WHERE pattern IS NOT NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY kind, colour, u, item_id) - 1 AS place FROM pool), labels AS (SELECT kind, colour, min(place) AS start, count(*) AS n FROM placed GROUP BY ALL),
often AS (SELECT *, row_number() OVER (ORDER BY kind, colour) - 1 AS turn FROM labels WHERE n >= {calibration.LEAST_PIECES}),
q AS (SELECT vec_id AS query, (SELECT count(*) FROM placed) AS total, floor({_u("vec_id", "'label'")} * (SELECT count(*) FROM often)) AS turn FROM embeddings WHERE vec_id % 5 = 0),
asked AS (SELECT q.query, q.total, o.*, floor({_u("query", "'picture'")} * n)::BIGINT AS picture,
  CASE WHEN {_u("query", "'absent'")} < {calibration.ABSENT_SHARE}::DOUBLE THEN 0 ELSE least(floor({_u("query", "'right'")} * {calibration.MOST_RIGHT}) + 1, n - 1) END::BIGINT AS k FROM q JOIN often o USING (turn) WHERE total - n >= {SIZE}),
rs AS (SELECT *, unnest(range(k)) AS j FROM asked), r AS (SELECT *, {_stretch("j", "n - 1", "k")} + floor({_u("query", "'r'", "j")} * ({_stretch("j + 1", "n - 1", "k")} - {_stretch("j", "n - 1", "k")}))::BIGINT AS pos FROM rs),
os AS (SELECT *, {SIZE} - k AS m, unnest(range({SIZE} - k)) AS j FROM asked), o AS (SELECT *, {_stretch("j", "total - n", "m")} + floor({_u("query", "'o'", "j")} * ({_stretch("j + 1", "total - n", "m")} - {_stretch("j", "total - n", "m")}))::BIGINT AS pos FROM os),
both_sides AS (SELECT query, kind, colour, start + pos + CASE WHEN pos >= picture THEN 1 ELSE 0 END AS place, true AS "right" FROM r UNION ALL SELECT query, kind, colour, pos + CASE WHEN pos >= start THEN n ELSE 0 END, false FROM o),
pics AS (SELECT query, p.embedding AS q FROM asked JOIN placed p ON p.place = start + picture),
pieces AS (SELECT query, p.item_id AS piece, "right", round(list_inner_product(q::DOUBLE[], p.embedding::DOUBLE[]), 6) AS similarity, b.colour || ' ' || b.kind AS asked, p.colour || ' ' || p.kind AS label
  FROM both_sides b JOIN placed p USING (place) JOIN pics USING (query)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, piece) AS place FROM pieces),
found AS (SELECT query, bool_or("right") AS has_right, max(similarity) FILTER (place = 1) AS top1_sim, bool_or("right") FILTER (place = 1) AS top1_right, bool_or("right" AND place <= {calibration.TOP}) AS top5_right,
  max(asked) AS asked, max(label) FILTER (place = 1) AS got FROM ranked GROUP BY query)"""


def _pieces(spark, d):
    looks = items(spark, d).select("item_id", F.col("pattern").alias("colour"))
    pool = vectors(spark, d).withColumnRenamed("category", "kind").join(looks, "item_id")
    asked = vectors(spark, d).filter("item_id % 5 = 0").select(F.col("item_id").alias("query"))
    return calibration.wardrobes(pool, asked, SIZE, SEED)


@query(_WARDROBES_SQL + ' SELECT query, piece, "right", similarity, asked, label FROM pieces')
def synthetic_wardrobes(spark, d):
    """A made-up wardrobe for every fifth vector's number, and how near its pieces are to the picture asked with."""
    return _pieces(spark, d)


@query(_WARDROBES_SQL + " SELECT * FROM found")
def wardrobe_answers(spark, d):
    return calibration.answers(_pieces(spark, d))


_HALF = "CASE WHEN query % 2 = 0 THEN 'val' ELSE 'test' END"


@query(_WARDROBES_SQL + f""", halves AS (SELECT *, {_HALF} AS half FROM found), b AS (SELECT floor(round(top1_sim * 1000, 3))::BIGINT AS b, count(*) AS n, count(*) FILTER (top1_right) AS k FROM halves WHERE half = 'val' GROUP BY 1),
run AS (SELECT b, sum(n) OVER (ORDER BY b DESC) AS shown, sum(k) OVER (ORDER BY b DESC) AS hits, sum(n) OVER () AS every, lag(b) OVER (ORDER BY b) AS under FROM b),
fit AS (SELECT coalesce(under + 1, b) / 1000 AS cut, hits / shown >= {TARGET} AS reached, hits / shown AS p FROM run WHERE shown >= greatest({calibration.LEAST_SHOWN}, floor(every / 10))),
cut AS (SELECT cut, reached FROM fit ORDER BY NOT reached, CASE WHEN reached THEN 0 ELSE -p END, cut LIMIT 1)
SELECT half, cut, reached, count(*) AS n_queries, round(avg(CASE WHEN top1_sim >= cut THEN top1_right::INT END), 6) AS precision, round(avg(CASE WHEN has_right THEN top5_right::INT END), 6) AS top5_hit_rate,
round(avg(CASE WHEN NOT has_right THEN (top1_sim < cut)::INT END), 6) AS honest_nothing_rate FROM halves, cut GROUP BY ALL""")
def wardrobe_cut(spark, d):
    """The cut that one half of the queries chooses, and how it does on either half."""
    found = calibration.answers(_pieces(spark, d)).checkpoint()
    even = F.col("query") % 2 == 0
    cut = calibration.chosen_cut(found.filter(even), TARGET)
    halves = [calibration.measured(found.filter(half), cut).withColumn("half", F.lit(name)) for name, half in (("val", even), ("test", ~even))]
    rates = [F.round(c, 6).alias(c) for c in ("precision", "top5_hit_rate", "honest_nothing_rate")]
    return halves[0].unionByName(halves[1]).select("half", "cut", "reached", "n_queries", *rates)


@query("""WITH f AS (SELECT user_id, ts, value AS seen_value, event_id AS seen_id FROM events WHERE event_type = 'view') SELECT a.event_id, a.user_id, seen_value, seen_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.ts >= f.ts""")
def stock_as_of(spark, d):
    """What the last view at or before each purchase said: facts are only ever appended and read as of a time."""
    events = table(spark, d, "events")
    facts = events.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen_value"), F.col("event_id").alias("seen_id"))
    asks = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return as_of(asks, facts, ["user_id"], "ts", ["seen_value", "seen_id"], "seen_id").drop("ts")


_LINEAR = "CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END AS {c}"
_CURVE = "CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16 / 116 END AS {c}"


@query(f"""WITH p AS (SELECT l_partkey AS k, (l_quantity * 5)::BIGINT % 256 / 255.0::DOUBLE AS r, floor(l_extendedprice)::BIGINT % 256 / 255.0::DOUBLE AS g, (l_suppkey * 7 + l_linenumber * 29) % 256 / 255.0::DOUBLE AS b FROM lineitem),
n AS (SELECT k, {", ".join(_LINEAR.format(c=c) for c in "rgb")} FROM p), x AS (SELECT k, (0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y, (0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b) / 1.08883::DOUBLE AS z FROM n),
f AS (SELECT k, {", ".join(_CURVE.format(c=c) for c in "xyz")} FROM x), lab AS (SELECT k, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f),
c AS (SELECT k, CASE WHEN l BETWEEN 0 AND 100 AND a BETWEEN -80 AND 80 AND b BETWEEN -80 AND 80 THEN least(floor(l / 100 * 6), 5) * 36 + least(floor((a + 80) / 160 * 6), 5) * 6 + least(floor((b + 80) / 160 * 6), 5) END::BIGINT AS cell FROM lab),
h AS (SELECT k, cell, count(*) AS n FROM c WHERE cell IS NOT NULL GROUP BY ALL), s AS (SELECT k, count(*) AS n_pixels, {", ".join(f"quantile_cont({c}, {q / 100}) AS {c}{q}" for q in colours.PERCENTILES for c in "lab")},
  {", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS d{c}" for c in "lab")} FROM lab GROUP BY k), cells AS (SELECT k, string_agg(cell || ':' || n, '|' ORDER BY cell) AS cells FROM h GROUP BY k)
SELECT k AS item_id, n_pixels, coalesce(cells, '') AS cells, [{", ".join(f"round({c}{q}, 4)" for q in colours.PERCENTILES for c in "lab")}] AS percentiles, [{", ".join(f"round(m{c}, 4)" for c in "lab")}] AS means,
[{", ".join(f"round(d{c}, 4)" for c in "lab")}] AS deviations FROM s LEFT JOIN cells USING (k)""")
def colour_features(spark, d):
    """Each part's lines as its picture's pixels."""
    pixel = F.struct((F.col("l_quantity") * 5 % 256).cast("int").alias("r"), (F.floor("l_extendedprice") % 256).cast("int").alias("g"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 29) % 256).cast("int").alias("b"))
    pictures = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.collect_list(pixel).alias("pixels"))
    told = colours.colour_features(pictures, "pixels")
    counted = F.transform("cells", lambda c: F.concat_ws(":", c["cell"].cast("string"), F.round(c["share"] * F.col("n_pixels")).cast("long").cast("string")))
    rounded = [F.transform(c, lambda x: signed_round(x, 4)).alias(c) for c in ("percentiles", "means", "deviations")]
    return told.select("item_id", "n_pixels", F.array_join(counted, "|").alias("cells"), *rounded)


@query()
def boosted_top3(spark, d):
    """The three likeliest labels of each vector by trees boosted on the training split; near copies aside, the rest is held out."""
    rows = vectors(spark, d).withColumn("split", split_of(F.col("item_id")))
    model = boosting.fit(rows.filter("split = 'train'"), "embedding", "category", rounds=12, rate=0.3)
    best = boosting.top(boosting.chances(F.col("embedding"), model), model.classes)
    return rows.select("item_id", "split", F.col("category").cast("string").alias("label"), F.transform(best, lambda s: s["value"]).alias("top3"), best[0]["conf"].alias("conf"))


@query(f"""WITH c AS (SELECT vec_id AS concept, embedding FROM embeddings WHERE vec_id < 8), s AS (SELECT a.vec_id AS item_id, concept, list_inner_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x FROM embeddings a, c),
base AS (SELECT concept, avg(x) AS base FROM s GROUP BY 1), r AS (SELECT item_id, list(concept ORDER BY round(x - base, 6) DESC, concept) AS r FROM s JOIN base USING (concept) GROUP BY 1),
n AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS place FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id),
j AS (SELECT n.a, n.b, x.r AS ra, y.r AS rb, list_filter(x.r[1:3], lambda v: list_contains(y.r[1:3], v)) AS shared FROM n JOIN r x ON x.item_id = n.a JOIN r y ON y.item_id = n.b WHERE place <= 10)
SELECT a, b, array_to_string(shared, '|') AS both, CASE WHEN len(shared) = 0 AND list_position(rb, ra[1]) > 4 AND list_position(ra, rb[1]) > 4 THEN ra[1] || '|' || rb[1] END AS contrast FROM j""")
def concept_overlap(spark, d):
    """What the ten look-alikes of each query have in common with it, by eight vectors that stand for concepts, or how they differ."""
    rows = vectors(spark, d)
    concepts = rows.filter("item_id < 8").select(F.col("item_id").alias("concept"), F.col("embedding").alias("c"))
    mean = rows.agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("m"))
    base = concepts.join(F.broadcast(mean)).select("concept", vec.dot(F.col("c"), F.col("m")).alias("base"))
    pairs = vec.top_k(queries_of(spark, d), rows, 10).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))
    told = vec.concept_overlap(pairs, rows, concepts, base)
    return told.select("a", "b", F.array_join(F.col("both").cast("array<string>"), "|").alias("both"), F.concat_ws("|", "contrast.a", "contrast.b").alias("contrast")).withColumn("contrast", F.nullif("contrast", F.lit("")))
