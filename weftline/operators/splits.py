"""Leak-free splits: a picture lies in one split only, the strictest that any of its outfits has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import split_of


def _rank(split: Column) -> Column:
    return F.when(split == "test", 2).when(split == "val", 1).when(split == "train", 0)


def assign_splits(rows: DataFrame, outfit: str, picture: str, order: list[str], local: Column | None = None, is_file: Column | None = None, n_tasks: int | None = None) -> DataFrame:
    """rows with outfit_split, split, outfit_clean and is_copy.

    An outfit's split comes from its hash; a picture takes the strictest of its outfits' splits, or its own hash where it is
    in no outfit. Local rows (our own photos) and outfits that have one are for testing only, whatever the hashes say. A row without a picture shares
    none: it has its outfit's split, null without one and not local, and is no copy. An outfit is clean if none of its pictures is used by outfits of
    different splits, null for a row without one. is_copy marks every row of a picture after the first in the given order, but none of rows whose
    picture is no file of its own (is_file).

    Whole rows are shuffled twice, by outfit and by picture; what outfits and pictures tell each other is found on (outfit, picture) alone. n_tasks is
    over how many tasks rows are dealt, as many as the session shuffles with if None.
    """
    own = F.coalesce(local, F.lit(False)) if local is not None else F.lit(False)
    file = F.coalesce(is_file, F.lit(False)) if is_file is not None else F.lit(True)
    dealt = lambda df, by: df.repartition(n_tasks, by) if n_tasks else df.repartition(by)
    has = F.col(outfit).isNotNull()
    split_here = F.when(F.col("_ours"), "test").otherwise(split_of(F.col(outfit)))
    named = rows.filter(has & own).select(outfit).distinct().withColumn("_ours", F.lit(True))
    marked = lambda df: df.join(named, outfit, "left") if local is not None else df.withColumn("_ours", F.lit(False))

    pairs = marked(dealt(rows.filter(has & F.col(picture).isNotNull()).select(outfit, picture), outfit).distinct())
    ranked = dealt(pairs.select(outfit, picture, _rank(split_here).cast("byte").alias("_r")), picture)
    within = Window.partitionBy(picture)
    shared = ranked.withColumn("_shared", F.min("_r").over(within) < F.max("_r").over(within)).filter("_shared")
    dirty = dealt(shared.select(outfit), outfit).distinct().withColumn("_dirty", F.lit(True))

    told = rows.withColumns({"_local": own, "_file": file})
    worn = marked(dealt(told.filter(has), outfit)).join(dirty, outfit, "left").withColumns({"outfit_split": split_here, "outfit_clean": F.col("_dirty").isNull()}).drop("_ours", "_dirty")
    none = told.filter(~has).withColumns({"outfit_split": F.lit(None).cast("string"), "outfit_clean": F.lit(None).cast("boolean")})
    whole = worn.unionByName(none)
    one = Window.partitionBy(picture)
    strictest = F.max(_rank(F.col("outfit_split"))).over(one)
    split = F.when(strictest == 2, "test").when(strictest == 1, "val").when(strictest == 0, "train")
    seen = dealt(whole.filter(F.col(picture).isNotNull()), picture).withColumns({
        "split": F.coalesce(split, split_of(F.col(picture))), "is_copy": (F.row_number().over(one.orderBy(*order)) > 1) & F.col("_file"),
    })
    placed = seen.unionByName(whole.filter(F.col(picture).isNull()).withColumns({"split": F.col("outfit_split"), "is_copy": F.lit(False)}))
    placed = placed.withColumn("split", F.when(F.col("_local"), "test").otherwise(F.col("split")))
    return placed.select(outfit, *[c for c in rows.columns if c != outfit], "outfit_split", "split", "is_copy", "outfit_clean")


def split_violations(rows: DataFrame, outfit: str, picture: str, key: str, category: str | None = None, categories: list[str] = (), local: Column | None = None,
                     n_tasks: int | None = None) -> DataFrame:
    """(check_name, violations) of the rules that a split table must keep; those on categories and on local rows only if these are given."""
    dealt = lambda df, *by: df.repartition(n_tasks, *by) if n_tasks else df
    count, wrong = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    each = {"unknown_split": ~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False)), "test_outfit_outside_test": (F.col("outfit_split") == "test") & (F.col("split") != "test")}
    if local is not None:
        each["local_outside_test"] = local & (F.col("split") != "test")
        each["local_outfit_outside_test"] = local & F.col(outfit).isNotNull() & (F.col("outfit_split") != "test")
    # one pass over rows: each tells its keys what they are checked for, and what it does wrong by itself goes with its id
    kinds = {"id": (F.lit(True), F.col(key), F.lit(None).cast("string"), F.lit(0)), "outfit": (F.col(outfit).isNotNull(), F.col(outfit), F.col("outfit_split"), F.lit(0)),
             "picture": (F.col(picture).isNotNull(), F.col(picture), F.col("split"), F.coalesce(~F.col("is_copy"), F.lit(False)).cast("int"))}
    if category is not None:
        kinds["category"] = (~F.coalesce(F.col(category).isin(*categories), F.lit(False)), F.col(category), F.lit(None).cast("string"), F.lit(0))
    faults = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(each.values())), F.lit(0))
    record = lambda i, k, of, v, first: F.struct(F.lit(i).cast("byte").alias("kind"), of.cast("string").alias("of"), v.alias("v"), first.alias("first"), (faults if k == "id" else F.lit(0)).alias("faults"))
    told = F.array(*[F.when(there, record(i, k, of, v, first)) for i, (k, (there, of, v, first)) in enumerate(kinds.items())])
    records = dealt(rows.select(F.explode(F.array_compact(told)).alias("r")).select("r.*"), "kind", "of")
    alone = [F.sum(F.shiftright("faults", i).bitwiseAND(1)).alias(n) for i, n in enumerate(each)]
    keys = records.groupBy("kind", "of").agg(count.alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high"), F.sum("first").alias("_firsts"), *alone)
    kind = {k: F.col("kind") == i for i, k in enumerate(kinds)}
    two = F.col("_low") < F.col("_high")
    checks = {
        "duplicate_ids": wrong(kind["id"] & (F.col("_n") > 1)), "picture_in_two_splits": wrong(kind["picture"] & two), "outfit_in_two_splits": wrong(kind["outfit"] & two),
        "first_copy_marked": wrong(kind["picture"] & (F.col("_firsts") < 1)), **{n: F.coalesce(F.sum(n), F.lit(0)) for n in each},
    }
    if category is not None:
        checks["unknown_category"] = wrong(kind["category"])
    whole = keys.agg(*[c.cast("long").alias(n) for n, c in checks.items()])
    return whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")
