"""Running sums and the last value at or before a place, over range-sorted rows: no group is one task's, however large it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import matches
from weftline.session_dirs import ensure_checkpoint_dir


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _part, the number of the range of order that they lie in; equal rows of order share one."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()).checkpoint()


def running_sums(rows: DataFrame, by: list[str], value: str, amount: str) -> DataFrame:
    """(by, value, below, amount, total) for each different value of each group: the sums of amount over smaller values, over that value, and
    over the whole group.

    Rows are added up by value first. The values are sorted by range, each range is summed by itself, and what a group has in
    earlier ranges, a row a range, is added; so a group of any number of values is spread over many tasks. Null values are left out;
    null groups are groups.
    """
    tallied = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(amount).alias("_n"))
    held = _ranged(tallied, [*by, value])
    before = lambda order: F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = held.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    parts = parts.select(*by, "_part", before(Window.partitionBy(*by).orderBy("_part")).alias("_earlier"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    inside = held.withColumn("_inside", before(Window.partitionBy(*by, "_part").orderBy(value)))
    joined = inside.alias("_a").join(parts.alias("_b"), matches("_a", "_b", [*by, "_part"]))
    return joined.select(*[f"_a.{c}" for c in (*by, value)], (F.col("_inside") + F.col("_earlier")).alias("below"), F.col("_a._n").alias("amount"), "total")


def as_of(asks: DataFrame, facts: DataFrame, by: list[str], time: str, told: list[str], newest: str) -> DataFrame:
    """asks with the columns `told` of the last fact of the same `by` at or before their `time`; null where there is none.

    Of facts of one moment the one with the greatest `newest` counts. Both sides are one table, sorted by key and time in ranges, so a hot key
    is split by time; a range hands the last fact of the one key that runs on to the ranges after it. Asks that lack a key or the time
    come back with nulls, facts that lack one are left out; every ask comes back once. Own columns of the asks called as one in `told` are replaced.
    """
    own = [c for c in asks.columns if c not in told]
    lacking = F.lit(False)
    for c in (*by, time):
        lacking |= F.col(c).isNull()
    nothing = F.struct(*[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in told])
    row_type = asks.select(F.struct(*own).alias("r")).schema["r"].dataType
    asked = asks.filter(~lacking).select(*by, time, F.lit(1).alias("_side"), F.lit(None).cast(facts.schema[newest].dataType).alias("_new"), F.struct(*own).alias("_row"), F.when(F.lit(False), nothing).alias("_fact"))
    there = facts.filter(~lacking).select(*by, time, F.lit(0).alias("_side"), F.col(newest).alias("_new"), F.lit(None).cast(row_type).alias("_row"), F.struct(*told).alias("_fact"))
    held = _ranged(asked.unionByName(there), [*by, time, "_side", "_new"])
    order = [time, "_side", "_new"]
    last = F.last("_fact", ignorenulls=True).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = held.withColumn("_last", last).filter("_side = 1")
    ends = held.groupBy(*by, "_part").agg(F.max_by("_fact", F.when(F.col("_side") == 0, F.struct(time, "_new"))).alias("_end"))
    keys = Window.partitionBy(*by)
    earlier = keys.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({"_spans": F.count(F.lit(1)).over(keys), "_carried": F.last("_end", ignorenulls=True).over(earlier)})
    carried = carried.filter("_spans > 1 and _carried is not null").select(*by, "_part", "_carried")  # a key runs on from range to range: a row a range at most
    found = inside.join(F.broadcast(carried), [*by, "_part"], "left").withColumn("_fact", F.coalesce("_last", "_carried"))
    out = found.select("_row.*", *[F.col(f"_fact.{c}").alias(c) for c in told])
    return out.unionByName(asks.filter(lacking).select(*own, *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in told]))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in the order of all rows, by one range sort: a row's place in its range and the sizes of the ranges before,
    a row each. Equal rows of order get any of their places."""
    ensure_checkpoint_dir(rows.sparkSession)
    held = rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = held.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")
