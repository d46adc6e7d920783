"""Listings kept in step with their sources: upserts, tombstones, insert-once, latest rows, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_t", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_t = 1").drop("_t")


def sync(stored: DataFrame, run: DataFrame, complete: bool = True) -> DataFrame:
    """The next snapshot of one source's listings and what became of each: added, updated, relabelled, no_picture, gone, kept.

    stored and run: external_id, image_url, price, readable (run only), status (stored only), labels (what the run's picture was
    labelled, null if the run has none, and what is stored), and any further columns, which a seen listing takes from the run. A row is labelled anew
    if it is new or its picture's address changed. A picture that can't be read keeps a stored row's old one, and a new row
    with one isn't stored. What a complete run lacks is gone; an incomplete one marks nothing.
    """
    more = [c for c in dict.fromkeys([*stored.columns, *run.columns]) if c not in ("external_id", "image_url", "price", "status", "labels", "readable")]
    both = stored.withColumn("_held", F.lit(True)).alias("s").join(run.alias("r"), F.col("s.external_id") == F.col("r.external_id"), "full")
    new, seen = F.col("s._held").isNull(), F.col("r.readable").isNotNull()
    moved = seen & ~new & ~F.col("r.image_url").eqNullSafe(F.col("s.image_url"))
    what = (
        F.when(seen & new & ~F.col("r.readable"), "no_picture").when(seen & new, "added").when(moved & F.col("r.readable"), "relabelled").when(moved, "kept_picture")
        .when(seen, "updated").when(F.lit(complete) & (F.col("s.status") == "active"), "gone").otherwise("kept")
    )
    fresh = what.isin("added", "relabelled")
    side = lambda c: F.when(seen, F.col(f"r.`{c}`")).otherwise(F.col(f"s.`{c}`")) if c in stored.columns and c in run.columns else F.col(f"s.`{c}`" if c in stored.columns else f"r.`{c}`")
    return both.select(
        F.coalesce("s.external_id", "r.external_id").alias("external_id"), what.alias("outcome"),
        F.when(fresh, F.col("r.image_url")).otherwise(F.col("s.image_url")).alias("image_url"),
        F.when(seen, F.col("r.price")).otherwise(F.col("s.price")).alias("price"),
        F.when(what == "gone", "gone").when(what == "no_picture", None).when(seen, "active").otherwise(F.col("s.status")).alias("status"),
        F.when(fresh, F.col("r.labels") if "labels" in run.columns else F.lit(None)).otherwise(F.col("s.labels")).alias("labels"), *[side(c).alias(c) for c in more],
    )


def stored_rows(synced: DataFrame) -> DataFrame:
    return synced.filter("outcome <> 'no_picture'").drop("outcome")


def insert_once(stored: DataFrame, asked: DataFrame, key: list[str], answer: str, order: list[Column]) -> DataFrame:
    """asked with result: inserted, repeated (the stored or an earlier answer is the same) or refused (it differs)."""
    first = Window.partitionBy(*key).orderBy("_new", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = stored.select(*key, answer, F.lit(0).alias("_new"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in (*key, answer)])
    rows = both.unionByName(asked.withColumn("_new", F.lit(1))).withColumns({"_first": F.first(answer).over(first), "_turn": F.row_number().over(Window.partitionBy(*key).orderBy("_new", *order))})
    result = F.when(F.col("_turn") == 1, "inserted").when(F.col(answer) == F.col("_first"), "repeated").otherwise("refused")
    return rows.filter("_new = 1").withColumn("result", result).drop("_new", "_first", "_turn")


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page by order, from 0, with the total of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(size * number).limit(size).join(F.broadcast(total))


def source_gate(kind: Column, base_url: Column, enabled: Column, approved: Column, kinds: list[str]) -> Column:
    """Why a source may not be read; empty if it may."""
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "unknown kind").when(F.coalesce(base_url, F.lit("")) == "", "no address").when(~F.coalesce(enabled, F.lit(False)), "disabled")
        .when(F.try_to_date(approved, "yyyy-MM-dd").isNull(), "no approval date").otherwise("")
    )
