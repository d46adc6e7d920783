"""Advice over outfits: completions, buying, verdicts, picks, clash resolution, checks of labels, and tests made from data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from weftline.functions.exprs import dot, looked_up, matches, set_key
from weftline.functions.md5s import digests
from weftline.operators import outfits as sets
from weftline.operators.timeline import numbered

#: Settings of the checks.
NEAR_MISS, LEAST_WARDROBE, FAR_FROM_STYLE, BUDGET_SHARE = 5, 8, 0.5, 0.3
LEAST_CONF = {"category": 0.6, "sub_category": 0.5, "pattern": 0.6, "colour": 0.7}
MARGIN = 0.15
SIMILAR_ITEM = 0.9
#: Rounds of a bootstrap that one hash serves.
LANES = 4
#: Hashes that are told at a time: their numbers stay in the cache.
_HASHES = 1 << 14
#: Chances that a Poisson(1) count is at most 0, 1, ... 8.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917, 0.999990, 0.999999)


def ids_of(items: Column) -> Column:
    return F.transform(items, lambda i: i["id"])


def key_of(items: Column) -> Column:
    return set_key(F.transform(items, lambda i: i["id"].cast("string")))


def complete_with(outfits: DataFrame, pool: DataFrame, key: str, owner: str, k: int = 5) -> DataFrame:
    """(key, candidate, score, place): the k owned items that best complete a set, never one it clashes with or has. An owner's items meet a set as
    one array, so no trial is a row."""
    tried = outfits.join(sets.held_by(pool, owner), owner)
    told = F.zip_with("held", sets.fit_scores(F.col("items"), F.col("held")), lambda o, s: F.struct((-s).alias("low"), o["id"].alias("candidate")))
    best = tried.select(key, told.alias("_told")).select(key, F.posexplode(F.slice(F.array_sort(F.filter("_told", lambda t: t["low"].isNotNull())), 1, k)).alias("place", "_t"))
    return best.select(key, "_t.candidate", (-F.col("_t.low")).alias("score"), (F.col("place") + 1).alias("place"))


def buy_outfits(wardrobe: DataFrame, candidates: DataFrame, owner: str) -> DataFrame:
    """(owner, candidate, items, score, owned_id, owned_score, stands): outfits round one candidate item an owner, and whether it
    stands in them, which is not filtered by here: a filter on what the folds make would be computed anew for each of them.

    A main candidate is in every core: with each piece that it goes with, or alone. Another is added in its slot to the owner's
    best cores. The TOP_CORES best cores are completed. owned_id is the owned item of the candidate's category that scores most
    in its place, tried from 20 points under GOOD_OUTFIT on; of equal ones the least id.
    """
    mine = candidates.select(owner, sets.as_items().alias("_must")).join(sets.held_by(wardrobe, owner), owner, "left")
    held = F.coalesce("held", F.array().cast(sets.held_by(wardrobe, owner).schema["held"].dataType))
    mine = mine.withColumns({"held": F.concat(held, F.array("_must")), "_at": F.size(held)})
    done = sets.with_completed(sets.with_cores(mine, swimwear=None, must=F.col("_at")), must=F.col("_at"))
    told = sets.with_rivals(done, F.col("_at")).select(owner, "_must", "held", "_at", F.explode(F.arrays_zip("done", "rivals")).alias("_o"))
    tried = told.select(owner, "_must", "held", "_at", F.col("_o.done.at").alias("at"), F.col("_o.done.score").alias("score"), "_o.rivals")
    rival = F.when((F.col("score") >= sets.GOOD_OUTFIT - 20) & (F.size("rivals.at") > 0), F.struct(F.get("held", F.col("rivals.at")[0])["id"].alias("id"), F.col("rivals.score").alias("score")))
    return tried.withColumn("_rival", rival).select(
        owner, F.col("_must.id").alias("candidate"), sets.picked(F.col("at")).alias("items"), "score", F.col("_rival.id").alias("owned_id"), F.coalesce("_rival.score", F.lit(0.0)).alias("owned_score"),
        F.array_contains("at", F.col("_at")).alias("stands"),
    )


def buy_advice(wardrobe: DataFrame, candidates: DataFrame, owner: str, vector: str | None = None, hidden: Column | None = None) -> DataFrame:
    """(owner, candidate, outfits, good_outfits, near_misses, lost_to, twins, verdict, to_next) of one candidate item an owner.

    An outfit is good if it scores GOOD_OUTFIT and beats the same outfit with any owned item of the candidate's category in its
    place; lost_to lists the owned items that good ones fall to, the most outfits first. near_misses are under GOOD_OUTFIT by up
    to NEAR_MISS and beat what is owned. twins counts owned items of the category whose vector is SIMILAR_ITEM near, null without
    vectors. to_next: good outfits that the next verdict lacks, null for the best. A hidden candidate (one that the owner's own
    filters take out) is "filtered": no outfits, skip. Each owner has a row, whatever the candidate goes with.
    """
    told = candidates.withColumn("_hidden", F.coalesce(hidden, F.lit(False)) if hidden is not None else F.lit(False))
    tried = buy_outfits(wardrobe, told.filter("not _hidden"), owner)
    beats = F.col("stands") & (F.col("score") > F.col("owned_score"))
    good, lost = (F.col("score") >= sets.GOOD_OUTFIT) & beats, F.col("stands") & (F.col("score") >= sets.GOOD_OUTFIT) & ~beats & F.col("owned_id").isNotNull()
    close = (F.col("score") < sets.GOOD_OUTFIT) & (F.col("score") >= sets.GOOD_OUTFIT - NEAR_MISS) & beats
    counts = {"outfits": F.col("stands"), "good_outfits": good, "near_misses": close, "_lost": lost}
    by_rival = tried.groupBy(owner, "owned_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    fell = F.collect_list(F.when(F.col("_lost") > 0, F.struct((-F.col("_lost")).alias("less"), "owned_id")))
    fell = F.transform(F.array_sort(fell), lambda x: F.struct(x["owned_id"].alias("owned_id"), (-x["less"]).alias("outfits")))
    sums = by_rival.groupBy(owner).agg(*[F.sum(n).alias(n) for n in ("outfits", "good_outfits", "near_misses")], fell.alias("lost_to"))
    out = told.select(owner, F.col("item_id").alias("candidate"), "_hidden").join(sums, owner, "left")
    if vector is None:
        out = out.withColumn("twins", F.lit(None).cast("long"))
    else:
        near = wardrobe.alias("_w").join(told.alias("_c"), owner).filter((F.col("_w.category") == F.col("_c.category")) & (dot(F.col(f"_w.{vector}"), F.col(f"_c.{vector}")) >= SIMILAR_ITEM))
        out = out.join(near.groupBy(owner).agg(F.count(F.lit(1)).alias("twins")), owner, "left").withColumn("twins", F.coalesce("twins", F.lit(0)))
    n = F.col("good_outfits")
    verdict = F.when(n >= sets.BUY_MIN, "buy").when(n >= sets.THINK_MIN, "think").otherwise("skip")
    nothing = F.array().cast("array<struct<owned_id:bigint,outfits:bigint>>")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("outfits", "good_outfits", "near_misses")} | {"lost_to": F.coalesce("lost_to", nothing)}
    out = out.withColumns(zero).withColumns({"verdict": verdict, "reason": F.when(F.col("_hidden"), "filtered")})
    to_next = F.when(F.col("verdict") == "skip", sets.THINK_MIN - n).when(F.col("verdict") == "think", sets.BUY_MIN - n)
    return out.withColumn("to_next", to_next).drop("_hidden")


def assess(rows: DataFrame) -> DataFrame:
    """rows (wardrobe, pairing, guessed, fills_gap, style, price, budget) with codes and confidence: reasons that lower it come first."""
    lowering = (("small_wardrobe", F.col("wardrobe") < LEAST_WARDROBE), ("no_pairing_piece", F.col("pairing") == 0), ("guessed_field", F.col("guessed")))
    telling = (("fills_gap", F.col("fills_gap")), ("far_from_style", F.col("style") < FAR_FROM_STYLE), ("over_budget", F.col("price") > BUDGET_SHARE * F.col("budget")))
    listed = lambda group: F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in group]))
    low = F.size(listed(lowering))
    return rows.withColumns({"codes": F.concat(listed(lowering), listed(telling)), "confidence": F.when(low == 0, "high").when(low == 1, "medium").otherwise("low")})


def pick_three(outfits: DataFrame, owner: str, seed: str, pool: int = 3, n: int = 3, shown: DataFrame | None = None, skip: str | None = None) -> DataFrame:
    """(owner, place, outfit_key, label) from (owner, outfit_key, items, score, label): one of each label, drawn by a seeded hash
    among its pool best, pieces not used yet first; a missing label gives way to the next best outfit. shown (owner, outfit_key) are not picked
    again; skip names a column with the labels that an owner has seen, which are no slots. An owner whose outfits have no label is dealt n
    outfits drawn the same way from all of them.

    The draw takes the least hash of seed, label and key, as a random generator's order can't be had in a plan.
    """
    row = F.struct((-F.col("score")).alias("low"), F.col("outfit_key").alias("key"), "label", ids_of(F.col("items")).alias("ids"), F.md5(F.concat_ws(":", F.lit(seed), "label", "outfit_key").cast("binary")).alias("draw"))
    fresh_ones = outfits if shown is None else outfits.join(shown.select(owner, "outfit_key"), [owner, "outfit_key"], "left_anti")
    seen = F.first(skip, ignorenulls=True) if skip else F.lit(None).cast("array<string>")
    listed = fresh_ones.groupBy(owner).agg(F.array_sort(F.collect_list(row)).alias("_all"), F.coalesce(seen, F.array().cast("array<string>")).alias("_skip"))
    start = F.struct(F.array().cast("array<struct<key:string,label:string>>").alias("chosen"), F.array().cast("array<bigint>").alias("used"))

    def fresh(of: Column, state: Column) -> Column:
        new = F.filter(of, lambda o: F.size(F.array_intersect(o["ids"], state["used"])) == 0)
        return F.when(F.size(new) > 0, new).otherwise(of)

    def unchosen(state: Column) -> Column:
        return F.filter("_all", lambda o: ~F.exists(state["chosen"], lambda c: c["key"] == o["key"]))

    def taken(state: Column, o: Column) -> Column:
        return F.when(o.isNull(), state).otherwise(F.struct(F.concat(state["chosen"], F.array(F.struct(o["key"].alias("key"), o["label"].alias("label")))).alias("chosen"), F.concat(state["used"], o["ids"]).alias("used")))

    def by_label(state: Column, label: Column) -> Column:
        best = F.slice(fresh(F.filter(unchosen(state), lambda o: o["label"].eqNullSafe(label)), state), 1, pool)
        drawn = F.array_sort(F.transform(best, lambda o: F.struct(o["draw"].alias("draw"), o.alias("o"))))
        return taken(state, F.get(drawn, F.lit(0))["o"])

    def fill(state: Column, _: Column) -> Column:
        return F.when(F.size(state["chosen"]) >= n, state).otherwise(taken(state, F.get(fresh(unchosen(state), state), F.lit(0))))

    labels = F.slice(F.array_except(F.array(*[F.lit(x) for x in ("safe", "bolder", "experimental")]), F.col("_skip")), 1, n)
    slots = F.when(F.exists("_all", lambda o: o["label"].isNotNull()), labels).otherwise(F.array_repeat(F.lit(None).cast("string"), n))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.aggregate(slots, start, by_label), fill)
    return listed.select(owner, F.posexplode(state["chosen"]).alias("place", "c")).select(owner, (F.col("place") + 1).alias("place"), F.col("c.key").alias("outfit_key"), F.col("c.label").alias("label"))


def resolved(items: Column) -> Column:
    """The items that resolved_with_notes() keeps."""
    return resolved_with_notes(items)["kept"]


def resolved_with_notes(items: Column) -> Column:
    """(kept, notes): items taken in order, where a later one takes the place of earlier ones that it clashes with (of its sub-category, or the
    oldest of its category beyond its limit); a note (dropped, kept) for each that went."""
    none = F.array().cast("array<struct<dropped:bigint,kept:bigint>>")

    def step(state: Column, new: Column) -> Column:
        kept = state["kept"]
        twin = lambda i: F.coalesce(i["sub_category"] == new["sub_category"], F.lit(False))
        apart = F.filter(kept, lambda i: ~twin(i))
        same = F.filter(apart, lambda i: i["category"] == new["category"])
        over = F.greatest(F.size(same) - F.coalesce(looked_up(new["category"], sets.MOST_ITEMS).cast("int"), F.lit(1)) + 1, F.lit(0))
        gone = F.concat(ids_of(F.filter(kept, twin)), F.slice(ids_of(same), F.lit(1), over))
        left = F.filter(kept, lambda i: ~F.array_contains(gone, i["id"]))
        notes = F.transform(gone, lambda d: F.struct(d.cast("bigint").alias("dropped"), new["id"].cast("bigint").alias("kept")))
        return F.struct(F.concat(left, F.array(new)).alias("kept"), F.concat(state["notes"], notes).alias("notes"))

    return F.aggregate(items, F.struct(F.filter(items, lambda i: F.lit(False)).alias("kept"), none.alias("notes")), step)


def pairing_gap(category: Column, outfits: Column, hidden: Column, missing: Column) -> Column:
    """What a wardrobe lacks for a new piece to make any outfit: null where it makes one or the owner's own filters take it out; else the other half
    of a top or bottom, or the first thing that its owner's outfits lack (missing), "main" for none."""
    slot = looked_up(category, sets.SLOTS)
    lacking = F.get(F.filter(F.coalesce(missing, F.array().cast("array<string>")), lambda m: m.isin("bottom", "top", "main")), F.lit(0))
    gap = F.when(slot == "upper", "bottom").when(slot == "lower", "top").otherwise(F.coalesce(lacking, F.lit("main")))
    return F.when((F.coalesce(outfits, F.lit(0)) > 0) | F.coalesce(hidden, F.lit(False)), None).otherwise(gap)


def is_unsure(field: str, best: Column, second: Column) -> Column:
    """Whether the best answer is under its field's cut or leads the next by less than the margin."""
    return (best < LEAST_CONF[field]) | F.coalesce(best - second < MARGIN, F.lit(False))


def within_parent(probs: DataFrame, key: str, child: str, parent: str, chosen: str) -> DataFrame:
    """Of each key only the children of its chosen parent, their probabilities scaled to sum to 1."""
    fit = probs.filter(F.col(parent) == F.col(chosen))
    return fit.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(key)))


def unique_owner(parts: DataFrame, wholes: DataFrame, image: str, least: float = 0.8) -> DataFrame:
    """(part, owner, share): parts of which at least that share of the box lies in exactly one whole of the same image.

    Boxes are x, y, w, h; a part of no area has no owner.
    """
    p = parts.select(image, F.col("id").alias("part"), *[F.col(c).alias(f"p{c}") for c in "xywh"])
    o = wholes.select(image, F.col("id").alias("owner"), *[F.col(c).alias(f"o{c}") for c in "xywh"])
    side = lambda a, s: F.greatest(F.least(F.col(f"p{a}") + F.col(f"p{s}"), F.col(f"o{a}") + F.col(f"o{s}")) - F.greatest(f"p{a}", f"o{a}"), F.lit(0))
    area = F.col("pw") * F.col("ph")
    joined = p.join(o, image).filter(area > 0).withColumn("share", side("x", "w") * side("y", "h") / area).filter(F.col("share") >= least)
    alone = F.count(F.lit(1)).over(Window.partitionBy(image, "part"))
    return joined.withColumn("_n", alone).filter("_n = 1").select(image, "part", "owner", F.round("share", 6).alias("share"))


#: Fixed value: places of a category's ring that lie in one row.
RING_BLOCK = 16


def swap_tests(members: DataFrame, key: str, pool: DataFrame, seed: str) -> DataFrame:
    """(key, true_id, fake_id, wrong): of each set the item that a hash picks, and three items of its category from outside the
    set, of which the first is the fake. A set goes only if its category has under three others.

    The wrong ones are the next of the category on a ring in order by hash. With k items of the set in the category, the
    k + 3 places from the picked item on hold three others if there are three, so no set meets the whole pool. Rings lie in rows of RING_BLOCK places,
    so a set meets one or two rows as a rule.
    """
    digest = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *[F.col(x).cast("string") for x in c]).cast("binary"))
    member = F.struct(digest(key, "item_id").alias("_d"), "item_id", "category")
    whole = members.select(key, member.alias("_m")).groupBy(key).agg(F.array_sort(F.collect_set("_m")).alias("_all")).withColumn("_c", F.get("_all", F.lit(0)))
    same = F.filter("_all", lambda m: m["category"] == F.col("_c.category"))
    chosen = whole.select(key, F.col("_c.category").alias("category"), F.col("_c.item_id").alias("item_id"), F.transform(same, lambda m: m["item_id"]).alias("_held"))
    placed = numbered(pool.select("category", "item_id", digest("item_id").alias("_d")), ["category", "_d", "item_id"], "_seat")
    sizes = F.broadcast(placed.groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("_size"), F.min("_seat").alias("_first")))  # a row a category
    places = placed.join(sizes, "category").select("category", "item_id", (F.col("_seat") - F.col("_first")).cast("int").alias("_place"))
    block = F.floor(F.col("_place") / RING_BLOCK).cast("int")
    rings = places.groupBy("category", block.alias("_block")).agg(F.collect_list(F.struct("_place", "item_id")).alias("_ring"))
    starts = chosen.join(places, ["category", "item_id"], "left").join(sizes.drop("_first"), "category")
    starts = starts.select(key, "category", F.col("item_id").alias("true_id"), "_held", "_size", F.coalesce("_place", F.lit(0)).alias("_from"), F.least(F.size("_held") + 3, F.col("_size")).alias("_n"))
    seen = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda s: F.floor(F.pmod(F.col("_from") + s, F.col("_size")) / RING_BLOCK).cast("int"))
    met = starts.withColumn("_block", F.explode(F.array_distinct(seen))).join(rings, ["category", "_block"])
    step = lambda r: F.pmod(r["_place"] - F.col("_from"), F.col("_size"))
    near = F.filter("_ring", lambda r: (step(r) < F.col("_n")) & ~F.array_contains("_held", r["item_id"]))
    found = met.select(key, "true_id", F.transform(near, lambda r: F.struct(step(r).alias("_step"), r["item_id"].alias("item_id"))).alias("_others"))
    others = found.groupBy(key, "true_id").agg(F.array_sort(F.flatten(F.collect_list("_others"))).alias("_others"))
    wrong = F.transform(F.slice("_others", 1, 3), lambda o: o["item_id"])
    return others.filter(F.size("_others") >= 3).select(key, "true_id", wrong[0].alias("fake_id"), wrong.alias("wrong"))


def bootstrap(rows: DataFrame, key: str, value: str, by: list[str], seed: str, rounds: int = 2000) -> DataFrame:
    """(by, mean, low, high): the mean of value and the 2.5 and 97.5 % points of its resampled means; rows without value don't count.

    Resampling is Poisson: each row counts as often in a round as a hash of seed, round and key says, so rows never meet, and
    each task sums its rounds before the shuffle. A hash serves LANES rounds, 32 bits each, which tell counts up to nine.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_v"))
    known = known.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    group = known.select(F.struct(*by).alias("g")).schema["g"].dataType
    drawn = known.select(F.struct(*by).alias("g"), F.coalesce("_k", F.lit("")).alias("k"), F.col("_k").isNull().alias("bare"), F.col("_v").alias("v"))
    summed = drawn.mapInArrow(_resampled(seed, rounds), StructType().add("g", group).add("s", ArrayType(DoubleType())).add("n", ArrayType(DoubleType())))
    each = summed.select("g.*", F.posexplode(F.arrays_zip("s", "n")).alias("_at", "_x")).groupBy(*by, "_at").agg((F.sum("_x.s") / F.sum("_x.n")).alias("_m"))
    spread = each.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    plain = known.groupBy(*by).agg(F.avg("_v").alias("mean"))
    return plain.alias("_a").join(spread.alias("_b"), matches("_a", "_b", by)).select("_a.*", "_b.low", "_b.high")


def _resampled(seed: str, rounds: int):
    """Per task and group the sums of value x count and of counts, a number a round; of many groups some after others."""
    cuts = [np.uint32(min(math.ceil(c * 2**32), 2**32 - 1)) for c in POISSON]
    hashes = -(-rounds // LANES)

    def added(held: np.ndarray, keys: list[bytes], values: np.ndarray, bare: bool) -> None:
        tail = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
        for digits in range(1, len(str(hashes)) + 1):
            numbers = range(10 ** (digits - 1), min(10**digits - 1, hashes) + 1)
            fronts = [f"{seed}:{r}{'' if bare else ':'}".encode() for r in numbers]
            front = np.frombuffer(b"".join(fronts), np.uint8).reshape(len(fronts), -1)
            some = max(1, _HASHES // len(fronts))
            for at in range(0, len(keys), some):
                part, v = tail[at : at + some], values[at : at + some]
                told = np.concatenate([np.repeat(front, len(part), axis=0), np.tile(part, (len(front), 1))], axis=1)
                for lane, u in enumerate(digests(told)):
                    times = sum((u >= c).astype(np.uint8) for c in cuts).reshape(len(front), -1).astype(np.float64)
                    held[:, numbers[0] - 1 : numbers[-1], lane] += times @ v, times.sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            cells = [pa.array([h[i].ravel()[:rounds] for h in sums.values()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([dict(g) for g in sums], kind), *cells], ["g", "s", "n"])

        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kind = batch.column("g").type
            values = batch.column("v").to_numpy()
            parts: dict[tuple, list[int]] = {}
            keys = [k.encode() for k in batch.column("k").to_pylist()]
            for i, (g, k, bare) in enumerate(zip(batch.column("g").to_pylist(), keys, batch.column("bare").to_pylist(), strict=True)):
                parts.setdefault((tuple(g.items()), len(k), bare), []).append(i)
            for (g, _, bare), which in parts.items():
                held = sums.setdefault(g, np.zeros((2, hashes, LANES)))
                added(held, [keys[i] for i in which], values[which], bare)
            if len(sums) > 1000:
                yield out()
                sums = {}
        if sums:
            yield out()

    return run


def shared_fields(pairs: DataFrame, items: DataFrame, fields: list[str]) -> DataFrame:
    """pairs (a, b) with shared and differing: fields known of both, by whether they agree."""
    a, b = (items.select(F.col("item_id").alias(k), *[F.col(f).alias(f"{k}_{f}") for f in fields]) for k in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    listed = lambda equal: F.array_compact(F.array(*[F.when((F.col(f"a_{f}") == F.col(f"b_{f}")) == F.lit(equal), F.lit(f)) for f in fields]))
    return both.select("a", "b", listed(True).alias("shared"), listed(False).alias("differing"))
