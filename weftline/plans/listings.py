"""Listing queries: suppliers as sources, parts as their listings, orders as runs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import listings as op
from weftline.plans.registry import query
from weftline.session import table

_LISTINGS = """listings AS (SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS brand, round(p_retailprice / 10, 2) AS price, p_size % 3 > 0 AS in_stock,
  CASE WHEN p_partkey % 11 = 0 THEN 'gone' WHEN p_partkey % 13 = 0 THEN 'pending' ELSE 'active' END AS status, p_partkey % 10 AS source_id, p_partkey % 17 AS seller FROM part)"""


def listings(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.round(F.col("p_retailprice") / 10, 2).alias("price"),
        (F.col("p_size") % 3 > 0).alias("in_stock"), F.when(key % 11 == 0, "gone").when(key % 13 == 0, "pending").otherwise("active").alias("status"), (key % 10).alias("source_id"), (key % 17).alias("seller"),
    )


@query(f"WITH {_LISTINGS}, f AS (SELECT * FROM listings WHERE status = 'active' AND in_stock AND price <= 130 AND category IN ('STANDARD', 'PROMO')) SELECT id, title, price, (SELECT count(*) FROM f) AS total FROM f ORDER BY price, id LIMIT 20 OFFSET 20")
def listing_filter_page(spark, d):
    fit = listings(spark, d).filter("status = 'active' and in_stock and price <= 130 and category in ('STANDARD', 'PROMO')")
    return op.page(fit, [F.col("price"), F.col("id")], 20, 1).select("id", "title", "price", "total")


@query(f"WITH {_LISTINGS} SELECT seller, id, status FROM listings WHERE status = 'active' OR seller = 3")
def listing_visibility(spark, d):
    """Active listings to all; what is pending or gone to its seller only."""
    return listings(spark, d).filter("status = 'active' or seller = 3").select("seller", "id", "status")


@query("SELECT o_custkey AS source_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, strftime(max(o_orderdate), '%Y-%m-%d') AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_run(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    last = op.latest(done, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))


@query("WITH l AS (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1), n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT c_custkey AS source_id, last IS NULL OR last < now - INTERVAL 60 DAY AS due FROM l, n")
def sources_due(spark, d):
    orders = table(spark, d, "orders")
    last = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    now = orders.agg(F.max("o_orderdate").alias("now"))
    joined = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(now))
    return joined.select(F.col("c_custkey").alias("source_id"), (F.col("last").isNull() | (F.col("last") < F.col("now") - F.expr("interval 60 days"))).alias("due"))


_SYNC = """WITH s AS (SELECT p_partkey AS external_id, 'u' || p_partkey % 5 AS image_url, p_retailprice AS price, CASE WHEN p_partkey % 19 = 0 THEN 'gone' ELSE 'active' END AS status, 'old' AS labels FROM part WHERE p_size <= 35),
r AS (SELECT p_partkey AS external_id, 'u' || (p_partkey + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END) % 5 AS image_url, p_retailprice + 1 AS price, p_size % 7 <> 0 AS readable FROM part WHERE p_size >= 15),
j AS (SELECT coalesce(s.external_id, r.external_id) AS external_id, s.image_url AS si, s.price AS sp, s.status AS st, s.labels AS sl, r.image_url AS ri, r.price AS rp, r.readable AS rr FROM s FULL JOIN r ON s.external_id = r.external_id),
o AS (SELECT *, CASE WHEN rr IS NOT NULL AND st IS NULL AND NOT rr THEN 'no_picture' WHEN rr IS NOT NULL AND st IS NULL THEN 'added' WHEN rr IS NOT NULL AND ri <> si AND rr THEN 'relabelled'
  WHEN rr IS NOT NULL AND ri <> si THEN 'kept_picture' WHEN rr IS NOT NULL THEN 'updated' WHEN st = 'active' THEN 'gone' ELSE 'kept' END AS outcome FROM j)"""


def _synced(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    url = lambda k: F.concat(F.lit("u"), (k % 5).cast("string"))
    stored = part.filter("p_size <= 35").select(key.alias("external_id"), url(key).alias("image_url"), F.col("p_retailprice").alias("price"), F.when(key % 19 == 0, "gone").otherwise("active").alias("status"), F.lit("old").alias("labels"))
    moved = key + F.when(F.col("p_size") % 4 == 0, 1).otherwise(0)
    run = part.filter("p_size >= 15").select(key.alias("external_id"), url(moved).alias("image_url"), (F.col("p_retailprice") + 1).alias("price"), (F.col("p_size") % 7 != 0).alias("readable"), F.concat(F.lit("label of "), url(moved)).alias("labels"))
    return op.sync(stored, run)


@query(_SYNC + """ SELECT external_id, outcome, CASE WHEN outcome IN ('added', 'relabelled') THEN ri ELSE si END AS image_url, round(CASE WHEN rr IS NOT NULL THEN rp ELSE sp END, 2) AS price,
CASE WHEN outcome = 'gone' THEN 'gone' WHEN outcome = 'no_picture' THEN NULL WHEN rr IS NOT NULL THEN 'active' ELSE st END AS status, CASE WHEN outcome IN ('added', 'relabelled') THEN 'label of ' || ri ELSE sl END AS labels FROM o""")
def sync_snapshot(spark, d):
    return _synced(spark, d).withColumn("price", F.round("price", 2))


@query(_SYNC + " SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def sync_counts(spark, d):
    return _synced(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(_SYNC + " SELECT external_id FROM o WHERE outcome = 'gone'")
def tombstones(spark, d):
    return _synced(spark, d).filter("outcome = 'gone'").select("external_id")


@query(f"WITH {_LISTINGS} SELECT source_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(brand))), '|') AS brands FROM listings WHERE status = 'active' GROUP BY 1")
def brands_per_source(spark, d):
    return listings(spark, d).filter("status = 'active'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("brand")), "|").alias("brands"))


@query(f"WITH {_LISTINGS} SELECT source_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND in_stock) AS in_stock, count(*) FILTER (status = 'gone') AS gone, count(*) AS n FROM listings GROUP BY 1")
def listings_overview(spark, d):
    active = F.col("status") == "active"
    return listings(spark, d).groupBy("source_id").agg(F.count_if(active).alias("active"), F.count_if(active & F.col("in_stock")).alias("in_stock"), F.count_if(F.col("status") == "gone").alias("gone"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LISTINGS}, s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier) SELECT l.id, coalesce(s.s_name, n.n_name, 'shop ' || l.source_id) AS shop FROM listings l LEFT JOIN s ON s.s_suppkey = l.source_id + 5 LEFT JOIN nation n ON n.n_nationkey = l.source_id")
def shop_name(spark, d):
    """A listing's shop by its source's name, else by the brand's, else the bare number."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    of = listings(spark, d).join(s, F.col("s_suppkey") == F.col("source_id") + 5, "left").join(n, F.col("n_nationkey") == F.col("source_id"), "left")
    return of.select("id", F.coalesce("s_name", "n_name", F.concat(F.lit("shop "), F.col("source_id").cast("string"))).alias("shop"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey AS user_id, o_orderkey % 50 AS candidate, o_orderstatus AS answer FROM orders), f AS (SELECT *, row_number() OVER w AS turn, first_value(answer) OVER w AS first FROM a WINDOW w AS (PARTITION BY user_id, candidate ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN turn = 1 THEN 'inserted' WHEN answer = first THEN 'repeated' ELSE 'refused' END AS result FROM f""")
def decide_once(spark, d):
    """The first answer on a candidate stands; the same again changes nothing, another is refused."""
    asked = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("candidate"), F.col("o_orderstatus").alias("answer"))
    return op.insert_once(asked.limit(0).select("user_id", "candidate", "answer"), asked, ["user_id", "candidate"], "answer", [F.col("o_orderkey")]).select("o_orderkey", "result")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey NOT BETWEEN 0 AND 19 THEN 'unknown kind' WHEN s_suppkey % 7 = 0 THEN 'no address' WHEN s_acctbal < 0 THEN 'disabled' WHEN s_suppkey % 5 = 0 THEN 'no approval date' ELSE '' END AS reason FROM supplier""")
def source_gate(spark, d):
    key = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    reason = op.source_gate(F.col("s_nationkey").cast("string"), F.when(key % 7 == 0, "").otherwise("https://x"), F.col("s_acctbal") >= 0, F.when(key % 5 == 0, "soon").otherwise("2024-03-01"), [str(i) for i in range(20)])
    return s.select("s_suppkey", reason.alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN p_type ELSE 'unisex' END AS gender FROM part")
def backfill_domain(spark, d):
    """A value outside its domain is set anew."""
    kind = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(kind.isin("STANDARD", "SMALL"), kind).otherwise("unisex").alias("gender"))


@query("SELECT l_partkey, arg_max(l_linestatus, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS state, count(*) AS facts FROM lineitem GROUP BY 1")
def stock_latest(spark, d):
    """The last of each item's stock facts, which are only ever appended."""
    place = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_linestatus", place).alias("state"), F.count(F.lit(1)).alias("facts"))


@query(f"WITH {_LISTINGS} SELECT id, CASE WHEN source_id = 4 THEN concat_ws(' ', brand, category) ELSE title END AS title FROM listings")
def mask_seller_text(spark, d):
    """What sellers wrote is not passed on: their listings are named by what is known of them."""
    return listings(spark, d).select("id", F.when(F.col("source_id") == 4, F.concat_ws(" ", "brand", "category")).otherwise(F.col("title")).alias("title"))


@query("""WITH r AS (SELECT seen, row_number() OVER (ORDER BY seen IS NOT NULL, seen, k) AS place, k FROM (SELECT c_custkey AS k, max(o_orderdate) AS seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1))
SELECT k AS url_id, place FROM r WHERE place <= 30""")
def pick_pages(spark, d):
    """New pages first, then those seen longest ago; thirty of them."""
    seen = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("url_id")).agg(F.max("o_orderdate").alias("seen"))
    order = [F.col("seen").isNotNull(), F.col("seen"), F.col("url_id")]
    return seen.orderBy(*order).limit(30).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("url_id", "place")
