"""Search calibration on synthetic wardrobes: seeded draws as joins on places, and the cut that makes what is shown as close right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import dot
from weftline.operators.timeline import numbered

#: The least pieces of a label that is asked for, the share of queries whose answer is not in the wardrobe, the most right
#: pieces that a wardrobe has, how many results count, and the least queries that a cut must show.
LEAST_PIECES, ABSENT_SHARE, MOST_RIGHT, TOP, LEAST_SHOWN = 3, 0.3, 3, 5, 20


def draw(seed: str, *of: Column) -> Column:
    """A number from 0 up to 1 that hangs on seed and what it is drawn for."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in of]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def _below(u: Column, n: Column) -> Column:
    return F.floor(u * n).cast("long")


def _spread(rows: DataFrame, count: Column, among: Column, seed: str, tag: str) -> DataFrame:
    """rows once for each of `count` different places from 0 up to `among`: one drawn in each of as many equal stretches."""
    dealt = rows.withColumn("_count", count).filter("_count > 0").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    stretch = lambda j: F.floor(j * among / F.col("_count")).cast("long")
    low, high = stretch(F.col("_j")), stretch(F.col("_j") + 1)
    return dealt.withColumn("_at", low + _below(draw(seed, F.col("query"), F.lit(tag), F.col("_j")), high - low)).drop("_count", "_j")


def wardrobes(pool: DataFrame, queries: DataFrame, size: int, seed: str, least_pieces: int = LEAST_PIECES, absent_share: float = ABSENT_SHARE) -> DataFrame:
    """(query, piece, right, similarity, asked, label): for each of queries (query) the pieces of a made-up wardrobe of `size`, none twice.

    A query asks with the picture of one piece of a label (kind and colour) that has least_pieces, and a piece is right if it has that label. The
    picture itself is left out. In a share of queries no right piece is in the wardrobe, in the others one to MOST_RIGHT. pool is item_id, kind,
    colour, embedding; pieces that lack one are left out. All draws hang on seed and query. Pieces are numbered by label, so those of a label are a
    stretch of places and a draw is a join on places: no query meets the pool. A query that finds under `size` other pieces has no wardrobe.
    """
    known = pool.dropna(subset=["item_id", "kind", "colour", "embedding"]).select("item_id", "kind", "colour", "embedding", draw(seed, F.col("item_id")).alias("_u"))
    placed = numbered(known, ["kind", "colour", "_u", "item_id"], "place").drop("_u").checkpoint()
    labels = placed.groupBy("kind", "colour").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    often = labels.filter(F.col("n") >= least_pieces).withColumn("turn", F.row_number().over(Window.orderBy("kind", "colour")) - 1)  # a row a label
    totals = F.broadcast(placed.agg(F.count(F.lit(1)).alias("total")).join(often.agg(F.count(F.lit(1)).alias("n_labels"))))
    q = F.col("query")
    asked = queries.select("query").join(totals).withColumn("turn", _below(draw(seed, q, F.lit("label")), F.col("n_labels"))).join(often, "turn")
    asked = asked.withColumn("picture", _below(draw(seed, q, F.lit("picture")), F.col("n"))).filter(F.col("total") - F.col("n") >= size)
    absent = draw(seed, q, F.lit("absent")) < absent_share
    k = F.least(_below(draw(seed, q, F.lit("right")), F.lit(MOST_RIGHT)) + 1, F.col("n") - 1)
    asked = asked.withColumn("k", F.when(absent, F.lit(0)).otherwise(k).cast("int"))
    right = _spread(asked, F.col("k"), F.col("n") - 1, seed, "r")
    right = right.withColumn("place", F.col("start") + F.col("_at") + F.when(F.col("_at") >= F.col("picture"), 1).otherwise(0))
    others = _spread(asked, F.lit(size) - F.col("k"), F.col("total") - F.col("n"), seed, "o")
    others = others.withColumn("place", F.col("_at") + F.when(F.col("_at") >= F.col("start"), F.col("n")).otherwise(0))
    told = ["query", "place", "kind", "colour"]
    both = right.select(*told, F.lit(True).alias("right")).unionByName(others.select(*told, F.lit(False).alias("right")))
    pictures = asked.select("query", (F.col("start") + F.col("picture")).alias("place")).join(placed, "place").select("query", F.col("embedding").alias("_q"))
    named = lambda colour, kind: F.concat_ws(" ", colour, kind)
    pieces = both.select("query", "place", "right", named("colour", "kind").alias("asked")).join(placed, "place").join(pictures, "query")
    similarity = F.round(dot(F.col("_q"), F.col("embedding")), 6)
    return pieces.select("query", F.col("item_id").alias("piece"), "right", similarity.alias("similarity"), "asked", named("colour", "kind").alias("label"))


def answers(pieces: DataFrame, top: int = TOP) -> DataFrame:
    """(query, has_right, top1_sim, top1_right, top5_right, asked, got) of wardrobes' pieces: what a search for the picture finds."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "piece"))
    ranked = pieces.withColumn("_place", place)
    first = lambda c: F.max(F.when(F.col("_place") == 1, F.col(c)))
    found = F.bool_or(F.col("right") & (F.col("_place") <= top))
    return ranked.groupBy("query").agg(F.bool_or("right").alias("has_right"), first("similarity").alias("top1_sim"), first("right").alias("top1_right"), found.alias("top5_right"), first("asked").alias("asked"), first("label").alias("got"))


def chosen_cut(found: DataFrame, target: float, least_shown: int = LEAST_SHOWN) -> DataFrame:
    """(cut, reached): the lowest thousandth from which on the best results are right as often as target, with at least a tenth of the queries, and
    least_shown, shown as close; else the most precise one, the lowest of equals, and reached is false.

    Scores are counted by thousandth first, so running sums are over some thousand rows.
    """
    step = F.floor(F.round(F.col("top1_sim") * 1000, 3)).cast("long")
    binned = found.groupBy(step.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.count_if("top1_right").alias("_k"))
    onward, upward = Window.orderBy(F.desc("_b")), Window.orderBy("_b")
    total = F.sum("_n").over(Window.partitionBy())
    run = binned.select("_b", F.sum("_n").over(onward).alias("_shown"), F.sum("_k").over(onward).alias("_hits"), total.alias("_all"), F.lag("_b").over(upward).alias("_under"))
    fit = run.filter((F.col("_shown") >= F.greatest(F.lit(least_shown), F.floor(F.col("_all") / 10)))).withColumn("cut", F.coalesce(F.col("_under") + 1, F.col("_b")) / 1000)
    share = F.col("_hits") / F.col("_shown")
    rated = fit.select("cut", (share >= target).alias("reached"), share.alias("_p"))
    best = F.min(F.struct((~F.col("reached")).alias("_no"), F.when(F.col("reached"), 0.0).otherwise(-F.col("_p")).alias("_less"), "cut"))
    return rated.agg(best.alias("_best")).filter("_best is not null").select("_best.cut", (~F.col("_best._no")).alias("reached"))


def measured(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (cut and own columns; a few rows) with n_queries, precision, top5_hit_rate and honest_nothing_rate; a rate of none is null."""
    shown = F.col("top1_sim") >= F.col("cut")
    joined = found.join(F.broadcast(cuts))
    sums = joined.groupBy(*cuts.columns).agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.when(shown, F.col("top1_right").cast("double"))).alias("precision"),
        F.avg(F.when(F.col("has_right"), F.col("top5_right").cast("double"))).alias("top5_hit_rate"), F.avg(F.when(~F.col("has_right"), (~shown).cast("double"))).alias("honest_nothing_rate"),
    )
    return sums
