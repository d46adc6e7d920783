"""Event, wear and account queries over the events table and orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import activity as op
from weftline.operators import listings
from weftline.plans.registry import query
from weftline.session import table

KINDS = ["click", "login", "logout", "purchase", "view"]


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def events_per_day(spark, d):
    return op.per_day(table(spark, d, "events"), "ts", "event_type", KINDS)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1")
def active_users(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, n WHERE ts > now - INTERVAL 24 HOUR")
def retention_24h(spark, d):
    events = table(spark, d, "events")
    return events.join(F.broadcast(events.agg(F.max("ts").alias("now")))).filter(F.col("ts") > F.col("now") - F.expr("interval 24 hours")).select("event_id")


_WORN = "w AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, [user_id % 7, event_id % 3, (event_id + 1) % 3] AS items FROM events)"


def _entries(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.array(F.col("user_id") % 7, n % 3, (n + 1) % 3).alias("items"))


@query(f"WITH {_WORN} SELECT min(event_id) AS event_id, user_id, day FROM w GROUP BY user_id, day, list_sort(items)")
def wear_once(spark, d):
    return op.worn_once(_entries(spark, d), "user_id", "day", "items", "event_id").select("event_id", "user_id", "day")


@query("""WITH owned AS (SELECT o_custkey AS user_id, l_partkey AS item_id, strftime(min(o_orderdate), '%Y-%m-%d') AS since FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
worn AS (SELECT o_custkey AS user_id, l_partkey AS item_id, strftime(l_shipdate, '%Y-%m-%d') AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
t AS (SELECT strftime(max(l_shipdate) - INTERVAL 30 DAY, '%Y-%m-%d') AS today, strftime(max(l_shipdate) - INTERVAL 74 DAY, '%Y-%m-%d') AS win, strftime(max(l_shipdate) - INTERVAL 130 DAY, '%Y-%m-%d') AS grace FROM lineitem),
l AS (SELECT user_id, item_id, max(day) AS last_worn FROM worn, t WHERE day <= today GROUP BY ALL)
SELECT o.user_id, o.item_id, o.since, last_worn, coalesce(last_worn >= win, false) AS lately, last_worn IS NULL AND since < grace AS never FROM owned o LEFT JOIN l USING (user_id, item_id), t""")
def worn_summary(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "o_orderdate", "l_shipdate", "l_returnflag")
    today = table(spark, d, "lineitem").agg(F.date_format(F.date_sub(F.max("l_shipdate").cast("date"), 30), "yyyy-MM-dd")).first()[0] or "1970-01-01"
    owned = lines.groupBy("user_id", "item_id").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("since"))
    worn = lines.filter("l_returnflag = 'R'").select("user_id", "item_id", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return op.worn_summary(owned, worn, today, 44, 100)


@query("SELECT user_id, arg_max(event_type, event_id) AS rating, max(event_id) AS event_id FROM events GROUP BY 1")
def feedback_upsert(spark, d):
    """The last word of each user stands."""
    return listings.latest(table(spark, d, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", F.col("event_type").alias("rating"), "event_id")


@query("WITH p AS (SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50) SELECT c_custkey, count(o_orderkey) AS items FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def items_per_user_page(spark, d):
    """A page of users with how many items each has: only the page's keys are counted."""
    users = table(spark, d, "customer").orderBy("c_name", "c_custkey").offset(50).limit(25).select("c_custkey")
    return users.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("items"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS blocked, count(*) FILTER (o_orderstatus = 'P') AS stopped FROM orders GROUP BY 1")
def runs_by_day(spark, d):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(is_("F").alias("ok"), is_("O").alias("blocked"), is_("P").alias("stopped"))


@query("WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'orders' AS name, count(*) AS left_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM g)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    left = op.without_user({"orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id")}, gone)
    parts = [rows.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("name"), "left_rows") for name, rows in left.items()]
    return parts[0].unionByName(parts[1])


@query("WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, last < now - INTERVAL 7200 SECOND AS lost FROM l, n")
def heartbeat_lost(spark, d):
    return op.silent(table(spark, d, "events"), "user_id", "ts", 7200).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH k AS (SELECT event_type AS field, (props::JSON->>'k')::BIGINT % 5 AS predicted, event_id % 4 AS corrected, value / 100 AS conf FROM events),
r AS (SELECT field, count(*) AS n, round(avg(CASE WHEN predicted <> corrected THEN 1.0 ELSE 0.0 END), 6) AS corrected_rate, round(avg(conf), 6) AS mean_conf, round(avg(CASE WHEN conf < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS below_cut FROM k GROUP BY 1),
p AS (SELECT field, predicted || ' -> ' || corrected AS pair, count(*) AS c FROM k WHERE predicted <> corrected GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY c DESC, pair) AS turn FROM p)
SELECT r.*, string_agg(pair || ' (' || c || ')', ', ' ORDER BY turn) AS top_pairs FROM r LEFT JOIN t ON t.field = r.field AND turn <= 5 GROUP BY ALL""")
def model_quality(spark, d):
    """Of each field how often it was corrected, how sure it was, and the five most common corrections."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("field"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("predicted"), (F.col("event_id") % 4).alias("corrected"), (F.col("value") / 100).alias("conf"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    rates = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), share(F.col("predicted") != F.col("corrected")).alias("corrected_rate"), F.round(F.avg("conf"), 6).alias("mean_conf"), share(F.col("conf") < 0.5).alias("below_cut"))
    pairs = rows.filter("predicted <> corrected").groupBy("field", F.concat_ws(" -> ", "predicted", "corrected").alias("pair")).agg(F.count(F.lit(1)).alias("c"))
    turn = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("c"), "pair"))
    top = pairs.withColumn("turn", turn).filter("turn <= 5").groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pair", "c"))), lambda x: F.format_string("%s (%d)", x["pair"], x["c"])), ", ").alias("top_pairs"))
    return rates.join(top, "field", "left")


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, list_sort(list_distinct(list(event_type))) AS types FROM events, n WHERE ts::DATE > now::DATE - 7 GROUP BY 1""")
def recently_worn(spark, d):
    """What each user had within seven days, today included."""
    events = table(spark, d, "events")
    near = events.join(F.broadcast(events.agg(F.max("ts").alias("now")))).filter(F.col("ts").cast("date") > F.date_sub(F.col("now").cast("date"), 7))
    return near.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
