"""Exact vector search, twins, groups and taste vectors.

Queries are a stated set and meet the whole table block by block. Groups are found by propagating the least member along links, written out between rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import dot, unit

#: Vectors of one side of a matrix product.
BLOCK = 1024
#: Concepts that may be broadcast.
MOST_CONCEPTS = 1000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _parts(*sides: DataFrame) -> list[int]:
    """How many blocks each side has, counted in one job."""
    marked = [rows.select(F.lit(i).alias("side")) for i, rows in enumerate(sides)]
    counts = {r["side"]: r["count"] for r in reduce(DataFrame.unionAll, marked).groupBy("side").count().collect()}
    return [counts.get(i, 0) // BLOCK + 1 for i in range(len(sides))]


def top_k(queries: DataFrame, items: DataFrame, k: int, on: list[str] = (), apart: str | None = None, below: float | None = None) -> DataFrame:
    """(query_id, item_id, score, place): each query's k most similar items that share the columns of on, never itself, and none of
    the same apart (a picture, say; unknown ones are apart from all), nor, if below is given, one that scores as much.

    queries: query_id, q (vector), on, apart; items: item_id, embedding, on, apart. Queries are a stated set: they and the items
    are dealt to numbered blocks of BLOCK rows, each block of items meets each of queries in one matrix product, and k hits a
    query and block go on to the ranking. Ties go to the least item_id. Rows without a vector meet none; all others must be of one
    length. Columns of on and apart alone are carried.
    """
    queries, items = queries.filter("q is not null"), items.filter("embedding is not null")
    n_q, n_i = _parts(queries, items)
    none = F.lit(None).cast("string")
    tag = lambda side, key, vector: [F.lit(side).alias("side"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(apart).cast("string") if apart else none).alias("apart"), *on]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(*tag(0, "query_id", "q")).withColumn("bq", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_q))).withColumn("bi", each(n_i))
    there = items.select(*tag(1, "item_id", "embedding")).withColumn("bi", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_i))).withColumn("bq", each(n_q))

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        q, i = (table.filter(pa.array(side == s)) for s in (0, 1))
        ids, hits = i.column("id").to_numpy(), ([], [], [])
        if q.num_rows and i.num_rows:
            scores = _matrix(q.column("v")) @ _matrix(i.column("v")).T
            group = np.array(i.column("apart").to_pylist(), dtype=object)
            for own, picture, row in zip(q.column("id").to_pylist(), q.column("apart").to_pylist(), scores, strict=True):
                fit = np.flatnonzero((ids != own) & ((group != picture) if picture is not None else True) & ((np.round(row, 6) < below) if below is not None else True))
                best = fit[np.lexsort((ids[fit], -np.round(row[fit], 6)))[:k]]
                for into, values in zip(hits, ([own] * len(best), ids[best], row[best]), strict=True):
                    into.extend(values)
        return pa.table([pa.array(hits[0], pa.int64()), pa.array(hits[1], pa.int64()), pa.array(hits[2], pa.float64())], ["query_id", "item_id", "score"])

    pairs = asked.unionByName(there).groupBy(*on, "bq", "bi").applyInArrow(meet, "query_id long, item_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return pairs.withColumn("score", F.round("score", 6)).withColumn("place", place).filter(F.col("place") <= k)


def listing_fits(price: Column, seller: Column, gender: Column, most: float | None = None, not_of: int | None = None, audience: list[str] | None = None) -> Column:
    """Whether a listing may be shown: a known price over 0 and up to most, another seller's, for the audience; None: any."""
    known = lambda c: F.coalesce(c, F.lit(False))
    priced = F.lit(True) if most is None else known((price > 0) & (price <= most))
    other = F.lit(True) if not_of is None else ~known(seller == not_of)
    return priced & other & (F.lit(True) if audience is None else known(gender.isin(audience)))


def one_per_picture(hits: DataFrame, picture: str) -> DataFrame:
    """Of the hits of a query on one picture only the best; places are dealt anew."""
    best = Window.partitionBy("query_id", picture).orderBy("place")
    once = hits.withColumn("_t", F.row_number().over(best)).filter("_t = 1").drop("_t")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))


def twins(items: DataFrame, group: str, cut: float) -> DataFrame:
    """(a, b, similarity) of items of one group from cut on, a before b.

    A group is cut into parts of BLOCK items, and part meets part in a matrix product, so a group of any size is done in full and
    only the pairs from cut on become rows. Items without a vector or group have no twin.
    """
    known = items.filter(F.col("embedding").isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col("item_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = known.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = known.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "v")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, part, v = table.column("id").to_numpy(), table.column("part").to_numpy(), _matrix(table.column("v"))
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        scores = v @ v.T
        x, y = np.nonzero(np.round(scores, 6) >= cut)
        keep = (ids[x] < ids[y]) & (within | (part[x] != part[y]))
        x, y = x[keep], y[keep]
        return pa.table([pa.array(c, t) for c, t in ((ids[x], pa.int64()), (ids[y], pa.int64()), (scores[x, y], pa.float64()))], ["a", "b", "similarity"])

    return dealt.groupBy("g", "i", "j").applyInArrow(meet, "a long, b long, similarity double").withColumn("similarity", F.round("similarity", 6))


def taste(items: DataFrame, owner: str, vector: str, size: int, least: int = 3, feedback: DataFrame | None = None) -> DataFrame:
    """(owner, taste): the unit mean of an owner's vectors plus those rated +1 and less those rated -1.

    Under least vectors the mean doesn't count; without either, or where all cancels out, there is no taste: null.
    """
    sums = F.array(*[F.sum(F.col(vector)[i].cast("double")) for i in range(size)])
    own = items.filter(F.col(vector).isNotNull()).groupBy(owner).agg(sums.alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = F.when(F.col("_n") >= least, F.transform("_s", lambda x: x / F.col("_n")))
    if feedback is None:
        return own.select(owner, unit(mean).alias("taste"))
    rated = F.array(*[F.sum(F.col("rating") * F.col(vector)[i].cast("double")) for i in range(size)])
    said = feedback.filter(F.col("rating").isin(-1, 1) & F.col(vector).isNotNull()).groupBy(owner).agg(rated.alias("_r"))
    joined = own.join(said, owner, "full")
    none = F.array_repeat(F.lit(0.0), size)
    moved = F.zip_with(F.coalesce(mean, none), F.coalesce("_r", none), lambda a, b: a + b)
    return joined.select(owner, F.when(mean.isNotNull() | F.col("_r").isNotNull(), unit(moved)).alias("taste"))


def linked_groups(edges: DataFrame, nodes: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(node, root): the least node of each node's component of edges (a, b); a node without edges is its own.

    Each round takes the least root among neighbours and then that root's root, so chains halve; a checkpoint in the
    session's folder ends each round's lineage.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = nodes.select("node", F.col("node").alias("root"))
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("low"))
        moved = now.join(near, now["node"] == near["a"], "left").select("node", "root", F.least("root", "low").alias("to"))
        jump = now.select(F.col("node").alias("to"), F.col("root").alias("far"))
        after = moved.join(jump, "to", "left").select("node", F.least("to", "far").alias("root"), (F.least("to", "far") != F.col("root")).alias("_moved"))
        after = after.checkpoint()
        now = after.select("node", "root")
        if not after.filter("_moved").limit(1).count():
            return now
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def concept_ranks(items: DataFrame, concepts: DataFrame, baseline: DataFrame, k: int) -> DataFrame:
    """(item_id, concept, lift, place): the k concepts that an item exceeds most against their baselines."""
    lifts = items.join(F.broadcast(concepts)).join(F.broadcast(baseline), "concept").withColumn("lift", F.round(dot(F.col("embedding"), F.col("c")) - F.col("base"), 6))
    return lifts.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("lift"), "concept"))).filter(F.col("place") <= k)


def concept_overlap(pairs: DataFrame, items: DataFrame, concepts: DataFrame, baseline: DataFrame, k: int = 3, most: int = MOST_CONCEPTS) -> DataFrame:
    """pairs (a, b) with both and contrast: the concepts among the k first of both pieces, in the order of a, and, where there is none, each piece's first
    concept if it is in the lower half of the other's ranking.

    A ranking orders all concepts (concept, c) by what a piece (item_id, embedding) exceeds their baseline (concept, base) by, equal ones by number. Up to
    `most` concepts are broadcast, more are refused. A piece without a vector shares and contrasts nothing.
    """
    told = concepts.join(baseline, "concept")
    if (n := told.count()) > most:
        raise ValueError(f"{n} concepts are over the {most} that may be broadcast")
    listed = F.broadcast(told.agg(F.array_sort(F.collect_list(F.struct("concept", "c", "base"))).alias("_all")))
    lift = lambda s: F.struct((-F.round(dot(F.col("embedding"), s["c"]) - s["base"], 6)).alias("less"), s["concept"].alias("concept"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("item_id")).distinct()
    ranked = items.filter("embedding is not null").join(wanted, "item_id", "left_semi").join(listed).select("item_id", F.transform(F.array_sort(F.transform("_all", lift)), lambda r: r["concept"]).alias("_r"))
    of = lambda side: ranked.select(F.col("item_id").alias(side), F.col("_r").alias(f"_{side}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    shared = F.array_intersect(F.slice("_a", 1, k), F.slice("_b", 1, k))
    both = F.coalesce(shared, F.array().cast(f"array<{concepts.schema['concept'].dataType.simpleString()}>"))
    low = lambda own, other: F.array_position(F.col(other), F.get(own, F.lit(0))) > F.floor(F.size(other) / 2)
    apart = (F.size("both") == 0) & low("_a", "_b") & low("_b", "_a")
    contrast = F.when(apart, F.struct(F.get("_a", F.lit(0)).alias("a"), F.get("_b", F.lit(0)).alias("b")))
    return joined.withColumn("both", both).withColumn("contrast", contrast).drop("_a", "_b")
