"""Events, wear logs and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import set_key


def per_day(events: DataFrame, at: str, kind: str, kinds: list[str]) -> DataFrame:
    """(day, one column a kind): counts by calendar day, 0 where there is none."""
    return events.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def worn_once(entries: DataFrame, user: str, day: str, items: str, order: str) -> DataFrame:
    """The first entry of each user, day and set of items, whatever the items' order."""
    turn = Window.partitionBy(user, day, set_key(items)).orderBy(order)
    return entries.withColumn("_t", F.row_number().over(turn)).filter("_t = 1").drop("_t")


def worn_summary(owned: DataFrame, worn: DataFrame, today: str, window_days: int, grace_days: int) -> DataFrame:
    """owned (user_id, item_id, since) with last_worn, lately (within the window) and never (none, and owned past the grace)."""
    last = worn.filter(F.col("day") <= F.lit(today)).groupBy("user_id", "item_id").agg(F.max("day").alias("last_worn"))
    out = owned.join(last, ["user_id", "item_id"], "left")
    lately = F.coalesce(F.col("last_worn") >= F.date_format(F.date_sub(F.to_date(F.lit(today)), window_days), "yyyy-MM-dd"), F.lit(False))
    old = F.col("since") < F.date_format(F.date_sub(F.to_date(F.lit(today)), grace_days), "yyyy-MM-dd")
    return out.withColumns({"lately": lately, "never": F.col("last_worn").isNull() & old})


def without_user(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (rows, its user column) without the users in gone (user_id)."""
    return {name: rows.join(gone.select(F.col("user_id").alias("_gone")), F.col(user) == F.col("_gone"), "left_anti") for name, (rows, user) in tables.items()}


def silent(beats: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, last, lost): whether a job's last beat is more than seconds before the newest of all."""
    last = beats.groupBy(key).agg(F.max(at).alias("last"))
    now = beats.agg(F.max(at).alias("_now"))
    return last.join(F.broadcast(now)).withColumn("lost", F.col("last") < F.col("_now") - F.make_dt_interval(secs=F.lit(seconds))).drop("_now")
