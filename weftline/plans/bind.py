"""How the generated tables stand for catalogue, outfits and users: the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table, tasks

#: Vocabularies, dealt to parts by number.
CATEGORIES = ("top", "bottom", "shoes", "dress", "outerwear", "bag", "accessory", "traditional", "swimwear")
COLOURS = (
    "black", "white", "cream", "grey", "beige", "navy", "khaki", "brown", "olive", "red", "burgundy",
    "pink", "orange", "yellow", "green", "teal", "blue", "purple", "gold", "silver", "multicolour",
)
PATTERNS = ("solid", "striped", "checked", "floral", "printed")
SUB_CATEGORIES = ("track-pants", "blazer", "shorts", "coat", "formal-shoes", "shirt", "heels", "tie", "clutch", "waistcoat", "jeans", "t-shirt")
SEASONS = ("summer", "winter", "mid-season")


def _nth(index, values: tuple[str, ...]):
    """The value of that number from 0; null beyond the last."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue items: now and then a colour, pattern or sub-category is unknown."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("item_id"), _nth(p % 9, CATEGORIES).alias("category"), _nth(F.col("p_size") % 23, COLOURS).alias("colour"),
        _nth(F.floor(p / 3) % 6, PATTERNS).alias("pattern"), _nth((p * 5) % 13, SUB_CATEGORIES).alias("sub_category"),
        ((p % 10) / 10.0).alias("pattern_conf"), _nth(p % 4, SEASONS).alias("season"), (F.col("p_size") % 5 + 1).cast("int").alias("coverage"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ITEMS_SQL = f"""items AS (SELECT p_partkey AS item_id, {_list(CATEGORIES)}[p_partkey % 9 + 1] AS category, {_list(COLOURS)}[p_size % 23 + 1] AS colour,
  {_list(PATTERNS)}[(p_partkey // 3) % 6 + 1] AS pattern, {_list(SUB_CATEGORIES)}[(p_partkey * 5) % 13 + 1] AS sub_category,
  (p_partkey % 10) / 10.0::DOUBLE AS pattern_conf, {_list(SEASONS)}[p_partkey % 4 + 1] AS season, (p_size % 5 + 1)::INTEGER AS coverage,
  p_name AS name, p_brand AS brand, p_retailprice AS price FROM part)"""


def wears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different item of each order: orders are outfits, customers their users. Rows are dealt by outfit last, over as many tasks as their number
    asks for, so what is told by outfit needs no other shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id"))
    return lines.join(items(spark, sf_dir), "item_id").repartition(tasks(lines), "outfit_id").dropDuplicates(["outfit_id", "item_id"])


def worn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """wears and items with the category alone, as a number, so that rows are short and equal ones are found by hash, without a sort."""
    kinds = items(spark, sf_dir).select("item_id", (F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")) - 1).alias("category"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id"))
    return lines.join(kinds, "item_id").repartition(tasks(lines), "outfit_id").distinct(), kinds


WEARS_SQL = ITEMS_SQL + """, wears AS (SELECT * FROM (SELECT DISTINCT l_orderkey AS outfit_id, l_partkey AS item_id FROM lineitem) JOIN items USING (item_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("category"), "embedding")


def vector_looks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    """(look, embedding), and the number by which an item's own leaves that of its look."""
    looks = vectors(spark, sf_dir).select(F.col("item_id").alias("look"), "embedding")
    return looks, looks.agg((F.max("look") + 1).alias("top")).first()["top"]


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as catalogue rows: a line is a row, a part of one supplier a picture, an order an outfit. Every 97th supplier is a local source, and
    what was not returned comes from photos with several items."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, sf_dir, "lineitem").select(
        key.alias("row_id"), F.col("l_orderkey").alias("outfit_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("picture"),
        F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("status"), "l_linenumber",
        (F.col("l_suppkey") % 97 == 0).alias("local"), (F.col("l_returnflag") != "N").alias("is_file"),
    )


LINES_SQL = """lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d')) AS row_id,
  l_orderkey AS outfit_id, concat_ws('-', l_partkey, l_suppkey) AS picture, l_returnflag AS source, l_linestatus AS status, l_linenumber, l_suppkey % 97 = 0 AS local, l_returnflag <> 'N' AS is_file FROM lineitem)"""
