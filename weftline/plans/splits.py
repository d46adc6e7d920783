"""Split queries over order lines."""

from pyspark.sql import functions as F

from weftline.operators import splits as op
from weftline.plans.bind import LINES_SQL, item_lines
from weftline.plans.registry import query
from weftline.session import table, tasks

_PCT = "(('0x' || substr(md5('split-v1:' || {k}), 1, 8))::BIGINT % 100)"
_SPLIT = "CASE WHEN " + _PCT + " < 80 THEN 'train' WHEN " + _PCT + " < 90 THEN 'val' ELSE 'test' END"
SPLIT_SQL = f"""WITH {LINES_SQL},
ours AS (SELECT DISTINCT outfit_id FROM lines WHERE local),
owned AS (SELECT l.*, CASE WHEN o.outfit_id IS NOT NULL THEN 'test' ELSE {_SPLIT.format(k="l.outfit_id")} END AS outfit_split FROM lines l LEFT JOIN ours o ON o.outfit_id = l.outfit_id),
strict AS (SELECT picture, max(CASE outfit_split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END) AS r, count(DISTINCT outfit_split) AS n_splits FROM owned GROUP BY picture),
dirty AS (SELECT DISTINCT outfit_id FROM owned JOIN strict USING (picture) WHERE n_splits > 1),
rows AS (SELECT o.*, CASE WHEN local THEN 'test' ELSE CASE r WHEN 2 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END END AS split, d.outfit_id IS NULL AS outfit_clean,
  row_number() OVER (PARTITION BY picture ORDER BY row_id) > 1 AND is_file AS is_copy FROM owned o JOIN strict USING (picture) LEFT JOIN dirty d ON d.outfit_id = o.outfit_id)
"""


def split_rows(spark, d):
    return op.assign_splits(item_lines(spark, d), "outfit_id", "picture", ["row_id"], F.col("local"), F.col("is_file"), tasks(table(spark, d, "lineitem")))


@query(SPLIT_SQL + "SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM rows GROUP BY source")
def split_crosstab(spark, d):
    return split_rows(spark, d).groupBy("source").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")], F.count(F.lit(1)).alias("total"))


@query(SPLIT_SQL + "SELECT row_id, picture, split, outfit_split, outfit_clean, is_copy FROM rows")
def split_pictures(spark, d):
    return split_rows(spark, d).select("row_id", "picture", "split", "outfit_split", "outfit_clean", "is_copy")


@query(SPLIT_SQL + "SELECT outfit_split, outfit_clean, count(DISTINCT outfit_id) AS outfits, count(*) AS n FROM rows GROUP BY ALL")
def split_outfits(spark, d):
    return split_rows(spark, d).groupBy("outfit_split", "outfit_clean").agg(F.countDistinct("outfit_id").alias("outfits"), F.count(F.lit(1)).alias("n"))


@query(
    SPLIT_SQL
    + """SELECT 'duplicate_ids' AS check_name, count(*) AS violations FROM (SELECT row_id FROM rows GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'picture_in_two_splits', count(*) FROM (SELECT picture FROM rows GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'outfit_in_two_splits', count(*) FROM (SELECT outfit_id FROM rows GROUP BY 1 HAVING count(DISTINCT outfit_split) > 1)
UNION ALL SELECT 'unknown_split', count(*) FROM rows WHERE split NOT IN ('train', 'val', 'test')
UNION ALL SELECT 'test_outfit_outside_test', count(*) FROM rows WHERE outfit_split = 'test' AND split <> 'test'
UNION ALL SELECT 'first_copy_marked', count(*) FROM (SELECT picture FROM rows GROUP BY 1 HAVING count(*) FILTER (NOT is_copy) < 1)
UNION ALL SELECT 'unknown_category', count(*) FROM (SELECT DISTINCT status FROM rows WHERE status NOT IN ('F', 'O'))
UNION ALL SELECT 'local_outside_test', count(*) FROM rows WHERE local AND split <> 'test' UNION ALL SELECT 'local_outfit_outside_test', count(*) FROM rows WHERE local AND outfit_split <> 'test'"""
)
def split_checks(spark, d):
    return op.split_violations(split_rows(spark, d), "outfit_id", "picture", "row_id", "status", ["F", "O"], F.col("local"), tasks(table(spark, d, "lineitem")))


@query(SPLIT_SQL + "SELECT source, split, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM rows GROUP BY source, split")
def split_share_index(spark, d):
    from pyspark.sql import Window

    counted = split_rows(spark, d).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(SPLIT_SQL + "SELECT coalesce(source, 'All') AS source, coalesce(split, 'All') AS split, count(*) AS n, count(*) FILTER (is_copy) AS copies FROM rows GROUP BY ROLLUP (source, split)")
def split_rollup(spark, d):
    counted = split_rows(spark, d).rollup("source", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_copy").alias("copies"))
    return counted.withColumns({c: F.coalesce(c, F.lit("All")) for c in ("source", "split")})
