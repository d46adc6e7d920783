"""Rule tables as data: maps, guards, ordered overrides, keyword rules and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_values(rows: DataFrame, rules: DataFrame, key: str, rule_key: str) -> DataFrame:
    """Left join of a rule table with unique keys: an unmatched value maps to null, and no row is lost or doubled."""
    return rows.join(rules, rows[key] == rules[rule_key], "left").drop(rules[rule_key])


def uncovered(rows: DataFrame, column: str, rules: DataFrame, rule_key: str) -> DataFrame:
    """Distinct values without a rule; a mapping may go on only if there are none."""
    return rows.select(F.col(column).alias("value")).filter("value is not null").distinct().join(rules, F.col("value") == rules[rule_key], "left_anti")


def require_covered(rows: DataFrame, column: str, rules: DataFrame, rule_key: str) -> None:
    missing = [r[0] for r in uncovered(rows, column, rules, rule_key).limit(20).collect()]
    if missing:
        raise ValueError(f"{column}: no rule for {missing}")


def outside_domain(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values that are neither allowed nor empty."""
    return rows.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin("", *allowed)).distinct()


def has_word(text: Column, word: str) -> Column:
    """word stands in text with no word character on either side, in any case."""
    return text.rlike(rf"(?i)\b{word}\b")


def first_keyword(text: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """The value of the first (keyword, value) by priority that stands in text; null for none."""
    return F.coalesce(*[F.when(has_word(text, word), F.lit(value)) for word, value in keywords])


def override(start: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """start rewritten by each (condition, value) that holds, in order: the last that holds wins."""
    return reduce(lambda value, rule: F.when(rule[0], rule[1]).otherwise(value), rules, start)


def gendered(rules: DataFrame, key: list[str], gender: str, order: str) -> DataFrame:
    """Of each key the row for that gender, or else the neutral one; of several the latest by order."""
    rank = Window.partitionBy(*key).orderBy((F.col("gender") != "").desc(), F.col(order).desc())
    fit = rules.filter((F.col("gender") == "") | (F.col("gender") == gender))
    return fit.withColumn("_turn", F.row_number().over(rank)).filter("_turn = 1").drop("_turn")


def with_provenance(rows: DataFrame, label: str, estimate: str, confidence: str, cut: float) -> DataFrame:
    """rows with value and value_source: the label, or an estimate that is sure enough, or unknown."""
    return rows.withColumns({
        "value": F.coalesce(label, F.when(F.col(confidence) >= cut, F.col(estimate))),
        "value_source": F.when(F.col(label).isNotNull(), "label").when((F.col(confidence) >= cut) & F.col(estimate).isNotNull(), "estimate").otherwise("unknown"),
    })


def conflicting(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose copies differ in a column; null counts as a value."""
    different = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 1 for c in columns]
    return rows.groupBy(key).agg(reduce(lambda a, b: a | b, different).alias("_conflict"), F.count(F.lit(1)).alias("copies")).filter("_conflict").drop("_conflict")


def row_errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order; a check that is null passes."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def coverage(attributes: DataFrame, rules: DataFrame, item: str, parts: DataFrame | None = None) -> DataFrame:
    """(item, coverage, coverage_from): the least score that any of an item's attributes (item, kind, name) gives, and the sorted kinds that gave one.

    rules has a row for each (kind, name) that tells something: its score and, under source, what that is called. parts (part, item) are pieces of
    items whose own attributes count for the item they belong to. An item that nothing is told of has no row.
    """
    if parts is not None:
        linked = attributes.withColumnRenamed(item, "part").join(parts.select("part", item), "part").select(item, "kind", "name")
        attributes = attributes.select(item, "kind", "name").unionByName(linked)
    told = attributes.join(rules, ["kind", "name"])
    return told.groupBy(item).agg(F.min("score").alias("coverage"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("coverage_from"))
