"""What a wardrobe can do and where it is short, what works in an outfit, how sure its label is, and outfits built round a piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import dot, looked_up, unit, vector_sum
from weftline.operators import outfits as sets
from weftline.operators import parts
from weftline.operators.advice import ids_of, key_of

#: Settings of the explanations and labels.
STRENGTH_STYLE, STRENGTH_COLOUR_PAIR, NO_CLASH, UNLIKE = 0.7, 0.8, 0.5, 0.3
SAFE_CUT, BOLDER_CUT, LEAST_WARDROBE = 0.892, 0.777, 8
FIRST_ADDITIONS, MOST_ADDITIONS = 8, 5
LABELS = ("safe", "bolder", "experimental")
MAIN_SLOTS = ("upper", "lower", "full")
WHY_NOT = {"style": "no_vectors", "colour": "no_colours", "pattern": "no_patterns", "structure": "no_items"}


def outfit_use(wardrobe: DataFrame, owner: str) -> DataFrame:
    """(owner, item_id, slot, outfits, standing, firsts): of each item the good completed outfits that it is in; a main piece is
    versatile or unmatched. Swimwear makes outfits like any full piece. firsts counts the good outfits whose first item it is, so an owner's sum is their good outfits."""
    done = sets.with_completed(sets.with_cores(sets.held_by(wardrobe, owner), swimwear=None))
    told = lambda i, category, good, first: F.struct(i["id"].alias("item_id"), category.alias("category"), F.lit(good).alias("good"), first.alias("first"))
    owned = F.transform("held", lambda i: told(i, i["category"], False, F.lit(False)))
    good = F.filter("done", lambda s: s["score"] >= sets.GOOD_OUTFIT)
    used = F.flatten(F.transform(good, lambda s: F.transform(s["at"], lambda i, at: told(F.get("held", i), F.lit(None).cast("string"), True, at == 0))))
    rows = done.select(owner, F.explode(F.concat(owned, used)).alias("u")).select(owner, "u.*")
    each = rows.groupBy(owner, "item_id").agg(F.max("category").alias("category"), F.count_if("good").alias("outfits"), F.count_if("first").alias("firsts"))
    slot = looked_up(F.col("category"), sets.SLOTS)
    standing = F.when(slot.isin(*MAIN_SLOTS), F.when(F.col("outfits") > 0, "versatile").otherwise("unmatched"))
    return each.select(owner, "item_id", slot.alias("slot"), "outfits", standing.alias("standing"), "firsts")


def gaps(wardrobe: DataFrame, owner: str) -> DataFrame:
    """(owner, complete, new_tops, new_bottoms, missing): whether all cores fit under the limit of cores, the pairs that one more
    top or bottom would make, and what the owner's outfits lack: a main piece of any kind, a top, a bottom, or shoes."""
    slot = looked_up(F.col("category"), sets.SLOTS)
    of = lambda s: F.count_if(slot == s)
    held = wardrobe.groupBy(owner).agg(of("upper").alias("_u"), of("lower").alias("_l"), of("full").alias("_f"), of("feet").alias("_s"))
    u, low, f = F.col("_u"), F.col("_l"), F.col("_f")
    main = F.when(u + low + f == 0, "main").when((u > 0) & (low + f == 0), "bottom").when((low > 0) & (u + f == 0), "top")
    missing = F.array_compact(F.array(main, F.when(F.col("_s") == 0, "shoes")))
    return held.select(owner, (u * low + f <= sets.TOP_CORES).alias("complete"), low.alias("new_tops"), u.alias("new_bottoms"), missing.alias("missing"))


def insights(wardrobe: DataFrame, owner: str, hidden: Column | None = None) -> DataFrame:
    """(owner, good_outfits, versatile, unmatched, hidden, complete, new_tops, new_bottoms, missing), a row an owner.

    versatile: ids of main pieces by good outfits, most first, then by id. hidden: what the owner's own filters take out; it
    counts for nothing else, and an owner of whom nothing is left has no outfits and lacks a main piece and shoes.
    """
    told = wardrobe.withColumn("_hidden", F.coalesce(hidden, F.lit(False)) if hidden is not None else F.lit(False))
    shown = told.filter("not _hidden").drop("_hidden")
    by_use = F.struct((-F.col("outfits")).alias("less"), "item_id")
    ids = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("standing") == kind, by_use))), lambda x: x["item_id"])
    used = outfit_use(shown, owner).groupBy(owner).agg(F.sum("firsts").alias("good_outfits"), ids("versatile").alias("versatile"), ids("unmatched").alias("unmatched"))
    gone = told.groupBy(owner).agg(F.array_sort(F.collect_list(F.when(F.col("_hidden"), F.col("item_id")))).alias("hidden"))
    out = gone.join(used, owner, "left").join(gaps(shown, owner), owner, "left")
    none = F.array().cast(wardrobe.select(F.array("item_id")).schema[0].dataType)
    empty = {"good_outfits": F.lit(0), "versatile": none, "unmatched": none, "complete": F.lit(True), "new_tops": F.lit(0), "new_bottoms": F.lit(0), "missing": F.array(F.lit("main"), F.lit("shoes"))}
    return out.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strengths(items: Column, style: Column | None = None) -> Column:
    """Names of what works in a set, each with what it is about after colons: pieces of one style, a good pair of colours or
    else a neutral base (neither where two colours clash), one bold pattern or calm ones, and a complete structure."""
    n, colours = len(sets._COLOURS), _names(sets._COLOURS)
    table = sets._matrix(sets._COLOURS, sets._colour_pair)
    neutral = sets._constants(str(sets.GROUPS[c] == "neutral").lower() for c in sets._COLOURS)

    def colour_line(ks: Column) -> Column:
        pairs = sets.over_pairs(ks, lambda a, b: F.struct(F.get(table, a * n + b).alias("s"), a.alias("a"), b.alias("b")))

        def told(ps: Column) -> Column:
            placed = F.transform(ps, lambda p, i: F.struct(p["s"].alias("s"), (-i).alias("first"), p["a"].alias("a"), p["b"].alias("b")))
            best = F.array_max(F.filter(placed, lambda p: p["a"] != p["b"]))
            pair = F.when(best["s"] >= STRENGTH_COLOUR_PAIR, F.concat(F.lit("colour_pair:"), F.get(colours, best["a"]), F.lit(":"), F.get(colours, best["b"])))
            calm = F.size(F.filter(ks, lambda k: F.get(neutral, k)))
            base = F.when(calm >= 2, F.concat(F.lit("colour_neutral_base:"), calm.cast("string")))
            return F.when((F.size(ps) > 0) & (F.array_min(F.transform(ps, lambda p: p["s"])) >= NO_CLASH), F.coalesce(pair, base))

        return sets.bound(pairs, told)

    def pattern_line(ps: Column) -> Column:
        solid = sets._PATTERNS.index("solid")
        bold = F.filter(ps, lambda p: p != solid)
        one = F.concat(F.lit("pattern_one_bold:"), F.get(_names(sets._PATTERNS), F.get(bold, F.lit(0))))
        return F.when(F.size(bold) == 1, one).when((F.size(ps) >= 2) & (F.size(bold) == 0), "pattern_calm")

    coherent = F.lit(None).cast("string") if style is None else F.when(style >= STRENGTH_STYLE, "style_coherent")
    lines = (coherent, sets.bound(sets.known(items, "k"), colour_line), sets.bound(sets.known(items, "p"), pattern_line), F.when(sets.structure_part(items) == 1.0, "structure_complete"))
    return F.array_compact(F.array(*lines))


def _worst(codes: Column, names: tuple[str, ...], table: Column, line: str) -> Column:
    """`line` with the names of the pair of codes that scores least, the first of equals; null unless that is under NO_CLASH."""
    pairs = sets.over_pairs(codes, lambda a, b: F.struct(F.get(table, a * len(names) + b).alias("s"), a.alias("a"), b.alias("b")))
    placed = F.array_min(F.transform(pairs, lambda p, i: F.struct(p["s"].alias("s"), i.alias("i"), p["a"].alias("a"), p["b"].alias("b"))))
    told = lambda w: F.when(w["s"] < NO_CLASH, F.concat_ws(":", F.lit(line), F.get(_names(names), w["a"]), F.get(_names(names), w["b"])))
    return sets.bound(placed, told)


def problems(items: Column, coherence: Column | None = None, user_fit: Column | None = None) -> Column:
    """Names of what is wrong in a set, each with what it is about after colons, in order of style, colour, pattern and structure.

    A style unlike the owner's or mixed (under UNLIKE), the worst pair of colours, patterns or types if it clashes, too many bold colours, no
    shoes, a missing half or main piece, a full piece with a bottom, and categories over their limit, the most first, by name.
    """
    bold_codes = sets._constants(str(sets.GROUPS[c] not in ("neutral", "metal")).lower() for c in sets._COLOURS)

    def too_bold(ks: Column) -> Column:
        bold = F.array_sort(F.transform(F.array_distinct(F.filter(ks, lambda k: F.get(bold_codes, k))), lambda k: F.get(_names(sets._COLOURS), k)))
        return F.when((F.size(ks) >= 2) & (F.size(bold) > sets.MOST_BOLD), F.concat(F.lit("colour_too_bold:"), F.array_join(bold, ",")))

    def structure(slots: Column) -> Column:
        has = lambda slot: F.array_contains(slots, slot)
        core = has("full") | (has("upper") & has("lower"))
        swim = has("full") & F.forall(items, lambda i: (i["slot"] != "full") | (i["category"] == "swimwear"))
        half = F.when(has("upper") | has("lower"), "structure_incomplete:top_or_bottom").otherwise("structure_incomplete:main_piece")
        first = F.when(core & (has("feet") | swim), None).when(core, "structure_no_shoes").otherwise(half)
        return F.array(first, F.when(has("full") & has("lower"), "structure_full_and_bottom"))

    def over(cats: Column) -> Column:
        counted = F.transform(F.array_distinct(cats), lambda c: F.struct((-F.size(F.filter(cats, lambda x: x == c))).alias("less"), c.alias("c")))
        wrong = F.filter(F.array_sort(counted), lambda x: -x["less"] > F.coalesce(looked_up(x["c"], sets.MOST_ITEMS).cast("int"), F.lit(1)))
        return F.transform(wrong, lambda x: F.concat_ws(":", F.lit("structure_over_limit"), x["c"], (-x["less"]).cast("string")))

    either = lambda table: lambda a, b: sets._either(table, a, b)
    low = lambda c, line: F.lit(None).cast("string") if c is None else F.when(c < UNLIKE, line)
    colours = sets.bound(sets.known(items, "k"), lambda ks: F.array(_worst(ks, sets._COLOURS, sets._matrix(sets._COLOURS, sets._colour_pair), "colour_clash"), too_bold(ks)))
    pattern = sets.bound(sets.known(items, "p"), lambda ps: F.array(_worst(ps, sets._PATTERNS, sets._matrix(sets._PATTERNS, either(sets.PATTERN_PAIRS)), "pattern_clash")))
    types = sets.bound(sets.known(items, "u"), lambda us: F.array(_worst(us, sets._SUBS, sets._matrix(sets._SUBS, either(sets.SUB_PAIRS)), "structure_pair")))
    style = F.array(low(user_fit, "style_unlike_you"), low(coherence, "style_mixed"))
    whole = sets.bound(F.transform(items, lambda i: i["slot"]), structure)
    return F.array_compact(F.concat(style, colours, pattern, whole, sets.bound(F.transform(items, lambda i: i["category"]), over), types))


def part_reasons(parts: dict[str, Column], weights: dict[str, float] = sets.WEIGHTS) -> Column:
    """Of each part (part, counted, max_points, why_not): the most points that it can give, and why it gives none if it is out."""
    weight = sum((F.when(c.isNotNull(), weights[p]).otherwise(0.0) for p, c in parts.items()), F.lit(0.0))

    def row(part: str, value: Column) -> Column:
        counts = value.isNotNull() & (F.lit(weights[part]) > 0)
        why = F.when(~counts, "weight_zero" if weights[part] <= 0 else WHY_NOT[part])
        most = F.when(counts, F.bround(F.round(100 * weights[part] / weight, 9), 1)).otherwise(0.0)
        return F.struct(F.lit(part).alias("part"), counts.alias("counted"), most.alias("max_points"), why.alias("why_not"))

    return F.array(*[row(p, c) for p, c in parts.items()])


def taste_similarity(vectors: Column, taste: Column, size: int) -> Column:
    """The cosine of the mean of a set's vectors with a unit taste; null without either."""
    return F.round(dot(unit(vector_sum(F.filter(vectors, lambda v: v.isNotNull()), size)), taste), 9)


def label_of(similarity: Column) -> Column:
    """The label of a set by how near it is to the owner's taste; null without a taste or a look."""
    return F.when(similarity >= SAFE_CUT, LABELS[0]).when(similarity >= BOLDER_CUT, LABELS[1]).when(similarity.isNotNull(), LABELS[2])


def shown_labels(shown: DataFrame, owner: str, key: str, similarity: str) -> DataFrame:
    """shown with label: an owner's sets by similarity in three thirds, ties by key; under three known ones the cuts hold, and a
    set of unknown similarity has no label. What is shown to one owner is a page, some few sets."""
    known = F.col(similarity).isNotNull()
    place = F.row_number().over(Window.partitionBy(owner, known).orderBy(F.desc(similarity), key)) - 1
    n = F.count(similarity).over(Window.partitionBy(owner))
    third = F.get(_names(LABELS), F.floor(F.col("_place") * len(LABELS) / F.col("_n")).cast("int"))
    told = shown.withColumns({"_place": place, "_n": n})
    return told.withColumn("label", F.when(known & (F.col("_n") >= len(LABELS)), third).otherwise(label_of(F.col(similarity)))).drop("_place", "_n")


def confidence(members: DataFrame, key: str, usable: str, unsure: str, corrected: str) -> DataFrame:
    """(key, reasons, confidence) from a row an item: what lowers it is a small wardrobe, and each field that is an unsure guess
    the owner hasn't corrected. No reason: high, one: medium, more: low. A null list is an empty one."""
    none = F.array().cast("array<string>")
    guessed = F.transform(F.array_except(F.coalesce(unsure, none), F.coalesce(corrected, none)), lambda f: F.concat(F.lit("guessed_field:"), F.col("item_id").cast("string"), F.lit(":"), f))
    told = members.groupBy(key).agg(F.min(usable).alias("_usable"), F.array_sort(F.flatten(F.collect_list(guessed))).alias("_guessed"))
    small = F.array_compact(F.array(F.when(F.col("_usable") < LEAST_WARDROBE, "small_wardrobe")))
    out = told.select(key, F.concat(small, "_guessed").alias("reasons"))
    return out.withColumn("confidence", F.when(F.size("reasons") == 0, "high").when(F.size("reasons") == 1, "medium").otherwise("low"))


def build(chosen: DataFrame, wardrobe: DataFrame, owner: str) -> DataFrame:
    """(owner, first, items, score): outfits round the chosen items (owner, items), one for each of the FIRST_ADDITIONS best
    first additions, each extended by the best piece until it is complete, nothing fits, or MOST_ADDITIONS are in.

    A piece that clashes is never added; ties go to the least id. An owner of whom nothing fits has no row.
    """
    mine = sets.held_by(wardrobe, owner).join(chosen.select(owner, F.col("items").alias("_chosen")), owner)
    pools = mine.select(owner, "_chosen", F.size("held").alias("n_owned"), F.concat("held", "_chosen").alias("held"))
    told = sets.with_built(pools, FIRST_ADDITIONS, MOST_ADDITIONS).select(owner, "held", F.size("_chosen").alias("_n"), F.explode("built").alias("s"))
    return told.select(owner, F.get("held", F.get("s.at", F.col("_n")))["id"].alias("first"), sets.picked(F.col("s.at")).alias("items"), "s.score")


def merged(lists: DataFrame, owner: str) -> DataFrame:
    """(owner, outfit_key, items, score) of several lists of (owner, items, score): each set of pieces once, at its best score."""
    keyed = lists.select(owner, key_of(F.col("items")).alias("outfit_key"), "items", "score")
    return keyed.groupBy(owner, "outfit_key").agg(F.max_by("items", "score").alias("items"), F.max("score").alias("score"))


def intruders(members: DataFrame, tests: DataFrame, catalogue: DataFrame, key: str, seed: str = "", n_rows: int | None = None) -> DataFrame:
    """(key, fake_id, weakest, hit, chance): in each set the true item gives way to a fake one (tests: key, true_id, fake_id); is
    the fake the item whose best swap gains most? Ties go to the least id.

    Any item of the catalogue swaps with one of its category; what stands in the set or was taken out of it is never put in. Members are the catalogue's items. Nothing is drawn
    any more, so seed has no effect. n_rows is about how many members there are, counted if not given.
    """
    names = catalogue.select("category", "sub_category").distinct().collect()  # the vocabularies
    more = lambda known, i: (*known, *sorted({r[i] for r in names} - {None, *known}))
    coded = catalogue.select("item_id", parts.packed(more(sets._CATEGORIES, 0), more(sets._SUBS, 1)).alias("code"))
    kinds = coded.groupBy("code").count().toArrow()  # a row for each different look of an item
    rows = parts.with_tests(members, tests, key).join(coded, "item_id")
    options = parts.Options(*(kinds.column(c).to_numpy() for c in ("code", "count")))
    return parts.weakest(rows, key, members.count() if n_rows is None else n_rows, options)
