"""Connectors: raw answers that a fetcher has landed on any file system, read by Spark and flattened by their kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import files, shops

#: Raw answers are one JSON document a line, read in byte ranges wherever they lie. A flattener takes them (column json) and the source's settings.
Flattener = Callable[[DataFrame, dict], DataFrame]

KINDS: dict[str, Flattener] = {
    "shopify": lambda answers, o: shops.shopify_listings(answers, o["base_url"], o.get("brand", "")),
    "woocommerce": lambda answers, o: shops.woocommerce_listings(answers, o.get("brand", ""), currency=o.get("currency", "TND")),
    "item_api": lambda answers, o: shops.api_items(answers, o["base_url"], o.get("brand", "")),
    "category_tree": lambda answers, o: shops.category_leaves(answers.withColumn("source", F.lit(o.get("brand", ""))), "source"),
    "product_pages": lambda answers, o: shops.product_pages(answers.select(F.from_json("json", "url string, html string").alias("p")).select("p.*")),
    "sitemap": lambda answers, o: shops.sitemap_urls(answers.select(F.get_json_object("json", "$.xml").alias("xml")), keep=o.get("keep")),
    "snapshot": lambda answers, o: answers.select(F.from_json("json", o["schema"]).alias("p")).select("p.*"),
}
#: Kinds whose files are tables already.
TABLES: dict[str, Callable[[SparkSession, list[str], dict], DataFrame]] = {
    "scraped_csv": lambda spark, paths, o: shops.scraped_listings(files.read_text_csv(spark, paths, o["columns"])),
}


def landed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, json) of all lines that aren't blank; a line that is no JSON stops the run, with its file and its beginning."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value")).filter("value <> ''")
    broken = F.raise_error(F.concat(F.lit("no JSON in "), "path", F.lit(": "), F.substring("value", 1, 60)))
    return lines.select("path", F.when(F.try_parse_json("value").isNull(), broken).otherwise(F.col("value")).alias("json"))


def fetch(spark: SparkSession, source_id: str, kind: str, paths: list[str], **settings) -> DataFrame:
    """What a source's landed answers say, in its kind's own columns, with source_id first. An unknown kind is an error."""
    if kind in TABLES:
        told = TABLES[kind](spark, paths, settings)
    elif kind in KINDS:
        told = KINDS[kind](landed(spark, paths), settings)
    else:
        raise ValueError(f"kind must be one of {sorted([*KINDS, *TABLES])}, not {kind!r}")
    return told.select(F.lit(source_id).alias("source_id"), "*")
