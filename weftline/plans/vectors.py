"""Vector queries over the embeddings table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.exprs import dot, norm
from weftline.operators import vectors as op
from weftline.plans.bind import vectors
from weftline.plans.registry import query
from weftline.session import table
from weftline.session_dirs import ensure_checkpoint_dir

CUT = 0.3
_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: The stated query set of a search: every item whose number is divisible by 50.
_Q = "SELECT * FROM embeddings WHERE vec_id % 50 = 0"


def queries_of(spark, d):
    return vectors(spark, d).filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"), "category")


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s) SELECT * FROM r WHERE place <= 10")
def knn_topk(spark, d):
    return op.top_k(queries_of(spark, d), vectors(spark, d), 10).select("query_id", "item_id", "score", "place")


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.vec_id // 3 AS picture, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS p FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, picture ORDER BY p) AS t FROM r WHERE p <= 25) SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place FROM o WHERE t = 1 QUALIFY place <= 5")
def similar_capped(spark, d):
    """Of the 25 best of the same category, one hit a picture, then five."""
    items = vectors(spark, d).withColumn("picture", F.floor(F.col("item_id") / 3))
    hits = op.top_k(queries_of(spark, d), items, 25, ["category"]).join(items.select("item_id", "picture"), "item_id")
    return op.one_per_picture(hits, "picture").filter("place <= 5").select("query_id", "item_id", "score", "place")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({_DOT}, 6) >= {CUT}")
def near_twins(spark, d):
    return op.twins(vectors(spark, d), "category", CUT)


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round({_DOT}, 6) >= {CUT}),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a) SELECT n AS node, min(m) AS root FROM reach GROUP BY n""")
def dup_components(spark, d):
    ensure_checkpoint_dir(spark)
    items = vectors(spark, d)
    return op.linked_groups(op.twins(items, "category", CUT), items.select(F.col("item_id").alias("node")))


@query("""WITH s AS (SELECT label AS owner, i, sum(embedding[i]::DOUBLE) / count(*) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT owner, sqrt(sum(x * x)) AS n FROM s GROUP BY owner)
SELECT owner, list(round(x / n, 6) ORDER BY i) AS taste FROM s JOIN n USING (owner) GROUP BY owner""")
def taste_vector(spark, d):
    rows = op.taste(vectors(spark, d), "category", "embedding", 64)
    return rows.select(F.col("category").alias("owner"), F.transform("taste", lambda x: F.round(x, 6)).alias("taste"))


@query("""WITH f AS (SELECT label AS owner, embedding, CASE WHEN vec_id % 7 = 0 THEN 1 WHEN vec_id % 7 = 1 THEN -1 ELSE 0 END AS rating FROM embeddings),
s AS (SELECT owner, i, sum(embedding[i]::DOUBLE) / count(*) + coalesce(sum(rating * embedding[i]::DOUBLE) FILTER (rating <> 0), 0) AS x FROM f, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT owner, sqrt(sum(x * x)) AS n FROM s GROUP BY owner)
SELECT owner, list(round(x / n, 6) ORDER BY i) AS taste FROM s JOIN n USING (owner) GROUP BY owner""")
def taste_with_feedback(spark, d):
    items = vectors(spark, d)
    rating = F.when(F.col("item_id") % 7 == 0, 1).when(F.col("item_id") % 7 == 1, -1).otherwise(0)
    rows = op.taste(items, "category", "embedding", 64, feedback=items.withColumn("rating", rating))
    return rows.select(F.col("category").alias("owner"), F.transform("taste", lambda x: F.round(x, 6)).alias("taste"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label),
r AS (SELECT *, score >= {CUT} AS close, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s), m AS (SELECT *, bool_or(close) OVER (PARTITION BY query_id) AS any_close FROM r WHERE place <= 8)
SELECT query_id, item_id, score, place, close, NOT any_close AS nothing_close FROM m WHERE any_close OR place <= 3""")
def owned_search(spark, d):
    """The eight best of what one owns, each close or not; where none is close, the three nearest anyway."""
    hits = op.top_k(queries_of(spark, d), vectors(spark, d), 8, ["category"]).withColumn("close", F.col("score") >= CUT)
    told = hits.withColumn("nothing_close", ~F.bool_or("close").over(Window.partitionBy("query_id")))
    return told.filter("not nothing_close or place <= 3").select("query_id", "item_id", "score", "place", "close", "nothing_close")


@query("""WITH c AS (SELECT vec_id AS concept, embedding FROM embeddings WHERE vec_id < 8), s AS (SELECT a.vec_id AS item_id, concept, list_inner_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x FROM embeddings a, c),
b AS (SELECT concept, avg(x) AS base FROM s GROUP BY 1), l AS (SELECT item_id, concept, round(x - base, 6) AS lift FROM s JOIN b USING (concept)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lift DESC, concept) AS place FROM l) SELECT * FROM r WHERE place <= 3""")
def concept_top3(spark, d):
    """Eight vectors stand for concepts; each item's three that it exceeds most."""
    items = vectors(spark, d)
    concepts = items.filter("item_id < 8").select(F.col("item_id").alias("concept"), F.col("embedding").alias("c"))
    base = items.join(F.broadcast(concepts)).groupBy("concept").agg(F.avg(dot(F.col("embedding"), F.col("c"))).alias("base"))
    return op.concept_ranks(items, concepts, base, 3).select("item_id", "concept", "lift", "place")


@query("SELECT count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS bad_size, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS not_unit, count(*) - count(DISTINCT vec_id) AS copies FROM embeddings")
def vector_checks(spark, d):
    return table(spark, d, "embeddings").agg(
        F.count_if(F.col("embedding").isNull() | (F.size("embedding") != 64)).alias("bad_size"), F.count_if(F.abs(norm(F.col("embedding")) - 1) > 0.01).alias("not_unit"),
        (F.count(F.lit(1)) - F.countDistinct("vec_id")).alias("copies"),
    )


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, CASE WHEN b.vec_id % 3 = 0 THEN 'shop' WHEN b.vec_id % 3 = 1 THEN 'dataset' ELSE 'wardrobe' END AS catalogue, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, catalogue ORDER BY score DESC, item_id) AS place FROM s WHERE catalogue <> 'dataset' OR score < 0.99) SELECT * FROM r WHERE place <= 2""")
def similar_by_catalogue(spark, d):
    """The two best of each catalogue, the data set's own picture aside."""
    parts = []
    for number, catalogue in enumerate(("shop", "dataset", "wardrobe")):
        own = vectors(spark, d).filter(F.col("item_id") % 3 == number)
        parts.append(op.top_k(queries_of(spark, d), own, 2, ["category"], below=0.99 if catalogue == "dataset" else None).withColumn("catalogue", F.lit(catalogue)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("query_id", "item_id", "catalogue", "score", "place")


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id // 3 <> b.vec_id // 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s) SELECT * FROM r WHERE place <= 5""")
def knn_other_pictures(spark, d):
    """The five nearest of other pictures than the query's own."""
    picture = F.floor(F.col("item_id") / 3)
    asked = queries_of(spark, d).withColumn("picture", F.floor(F.col("query_id") / 3))
    return op.top_k(asked, vectors(spark, d).withColumn("picture", picture), 5, apart="picture").select("query_id", "item_id", "score", "place")


@query(f"""WITH l AS (SELECT vec_id, label, embedding, p_retailprice AS price, p_partkey % 7 AS seller, CASE WHEN p_partkey % 4 = 0 THEN 'men' WHEN p_partkey % 4 = 1 THEN 'unisex' ELSE 'women' END AS gender, p_size > 10 AS in_stock FROM embeddings JOIN part ON p_partkey = vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT}, 6) AS score FROM ({_Q}) a JOIN l b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE in_stock AND seller <> 3 AND gender IN ('women', 'unisex') AND price > 0 AND price <= 1500),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM s) SELECT * FROM r WHERE place <= 6""")
def knn_in_stock(spark, d):
    """The six nearest listings in stock, not the seller's own, for an audience, with a known price up to a limit."""
    key = F.col("p_partkey")
    gender = F.when(key % 4 == 0, "men").when(key % 4 == 1, "unisex").otherwise("women")
    listed = table(spark, d, "part").select(key.alias("item_id"), F.col("p_retailprice").alias("price"), (key % 7).alias("seller"), gender.alias("gender"), (F.col("p_size") > 10).alias("in_stock"))
    items = vectors(spark, d).join(listed, "item_id")
    fit = items.filter(F.col("in_stock") & op.listing_fits(F.col("price"), F.col("seller"), F.col("gender"), 1500.0, 3, ["women", "unisex"]))
    return op.top_k(queries_of(spark, d), fit, 6, ["category"]).select("query_id", "item_id", "score", "place")
