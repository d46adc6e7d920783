"""Profiles and evaluation statistics as grouped plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import matches, wilson


def with_total(rows: DataFrame, by: str, aggregates: list[Column], total: str = "All") -> DataFrame:
    """Aggregates of each group and of all rows in one pass; a null group stays apart from the total."""
    grouped = rows.rollup(by).agg(F.grouping(by).alias("_g"), *aggregates)
    return grouped.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by))).drop("_g")


def fill_rates(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """The share of known values of each column, by group and for all; empty text is unknown."""
    known = lambda c: F.avg(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0))
    return with_total(rows, by, [F.round(known(c), 6).alias(c) for c in columns])


def accuracy_at_cuts(rows: DataFrame, by: str, right: Column, confidence: Column, cuts: list[float]) -> DataFrame:
    """Of each group and confidence cut: how many pass, how many of them are right, and the Wilson interval."""
    cut = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    told = rows.select(by, right.alias("_right"), confidence.alias("_conf"), cut)
    out = told.groupBy(by, "cut").agg(F.count_if(F.col("_conf") >= F.col("cut")).alias("n"), F.count_if((F.col("_conf") >= F.col("cut")) & F.col("_right")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


def average_ranks(rows: DataFrame, value: str, by: list[str], rank: str) -> DataFrame:
    """rows with the rank of value within by, from 1, ties sharing the mean of their ranks; every row comes back.

    Equal values are counted first, so a group's window holds one row for each different value. A null value has no rank and
    counts for none; null groups are groups.
    """
    tallied = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    below = F.coalesce(F.sum("_ties").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tallied.withColumn("_rank", below + (F.col("_ties") + 1) / 2)
    return rows.alias("_a").join(ranked.alias("_b"), matches("_a", "_b", [*by, value]), "left").select("_a.*", F.col("_b._rank").alias(rank))


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, rho, n) over the rows that have both values."""
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(known, a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def roc_auc(rows: DataFrame, score: str, positive: Column, by: list[str], least: int = 10) -> DataFrame:
    """Area under the ROC curve by rank sums, of groups that have at least least rows of either class; unknown ones don't count."""
    known = rows.withColumn("_pos", positive).filter(F.col("_pos").isNotNull() & F.col(score).isNotNull())
    ranked = average_ranks(known, score, by, "_r")
    sums = ranked.groupBy(*by).agg(F.count_if("_pos").alias("n_pos"), F.count_if(~F.col("_pos")).alias("n_neg"), F.sum(F.when(F.col("_pos"), F.col("_r"))).alias("_s"))
    auc = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return sums.filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least)).withColumn("auc", F.round(auc, 6)).drop("_s")


def cooccurrence(members: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, groups, share): in how many groups two values meet, a before b; a group has each value once."""
    once = members.select(group, value).distinct()
    pairs = once.withColumnRenamed(value, "a").join(once.withColumnRenamed(value, "b"), group).filter("a < b")
    total = once.agg(F.countDistinct(group).alias("_all"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups")).join(F.broadcast(total)).withColumn("share", F.round(F.col("groups") / F.col("_all"), 6)).drop("_all")


def lowest_cut(rows: DataFrame, score: str, right: str, target: float, least: int) -> DataFrame:
    """(cut, shown, precision): the lowest thousandth at which the share of right among scores from it on reaches target.

    Scores are counted by thousandth first, so the running sums are over a thousand rows however many scores there are.
    """
    binned = rows.withColumn("cut", F.floor(F.col(score) * 1000) / 1000).groupBy("cut").agg(F.count(F.lit(1)).alias("_n"), F.count_if(right).alias("_k"))
    onward = Window.orderBy(F.col("cut").desc())
    run = binned.select("cut", F.sum("_n").over(onward).alias("shown"), F.sum("_k").over(onward).alias("_hits"))
    fit = run.withColumn("precision", F.round(F.col("_hits") / F.col("shown"), 6)).filter((F.col("_hits") >= target * F.col("shown")) & (F.col("shown") >= least))
    return fit.orderBy("cut").limit(1).drop("_hits")


def correction_rates(guesses: DataFrame, field: str, unsure: Column, changed: Column) -> DataFrame:
    """(field, items, unsure, unsure_corrected, sure_corrected, and both rates): how often guesses were changed, told apart by
    whether they were flagged; a rate of none is null. Guesses of unknown flag count as sure, of unknown change as unchanged."""
    told = guesses.select(field, F.coalesce(unsure, F.lit(False)).alias("_u"), F.coalesce(changed, F.lit(False)).alias("_c"))
    sums = told.groupBy(field).agg(F.count(F.lit(1)).alias("items"), F.count_if("_u").alias("unsure"), F.count_if(F.col("_u") & F.col("_c")).alias("unsure_corrected"), F.count_if(~F.col("_u") & F.col("_c")).alias("sure_corrected"))
    share = lambda k, n: F.when(n > 0, F.round(k / n, 3))
    sure = F.col("items") - F.col("unsure")
    return sums.withColumns({"unsure_corrected_rate": share(F.col("unsure_corrected"), F.col("unsure")), "sure_corrected_rate": share(F.col("sure_corrected"), sure)})


def router_accuracy(answers: DataFrame) -> DataFrame:
    """(expected, cases, answers, n_right, rate) of scored answers (id, expected, ok, scored) and, under "All", of all of them."""
    right = F.count_if("ok")
    told = [F.countDistinct("id").alias("cases"), F.count(F.lit(1)).alias("answers"), right.alias("n_right"), F.round(right / F.count(F.lit(1)), 6).alias("rate")]
    return with_total(answers.filter("scored"), "expected", told)


def mix_ups(answers: DataFrame, n: int = 12) -> DataFrame:
    """(expected, chosen, answers): the n most common wrong choices of scored answers, ties by name."""
    wrong = answers.filter("scored and not ok").groupBy("expected", "chosen").agg(F.count(F.lit(1)).alias("answers"))
    return wrong.orderBy(F.desc("answers"), "expected", "chosen").limit(n)


def unsteady_cases(answers: DataFrame) -> DataFrame:
    """(id, expected, n_right, answers, chosen) of cases that weren't right in every scored answer; chosen lists choices by count."""
    counts = answers.filter("scored").groupBy("id", "expected", "chosen").agg(F.count(F.lit(1)).alias("_n"), F.count_if("ok").alias("_k"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("less"), "chosen"))), lambda x: F.concat_ws(" ", x["chosen"], (-x["less"]).cast("string")))
    cases = counts.groupBy("id", "expected").agg(F.sum("_k").alias("n_right"), F.sum("_n").alias("answers"), F.array_join(listed, ", ").alias("chosen"))
    return cases.filter("n_right < answers")


def range_errors(ranges: dict[str, tuple[float | None, float | None]], domains: dict[str, list] | None = None) -> Column:
    """Names of what is out of its range (both ends included, None: open) or domain, in the order given; unknown values pass."""
    bad = []
    for name, (low, high) in ranges.items():
        out = F.lit(False) if low is None else F.col(name) < low
        bad.append((name, out if high is None else out | (F.col(name) > high)))
    bad += [(name, ~F.col(name).isin(*values)) for name, values in (domains or {}).items()]
    return F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in bad]))
