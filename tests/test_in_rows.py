"""Outfits told within an owner's row: the same as by joins, and no shuffle but the one by owner."""

import random
import re

from pyspark.sql import functions as F

from weftline.operators import outfits
from weftline.plans.registry import QUERIES
from weftline.plans.bind import CATEGORIES, COLOURS, PATTERNS, SUB_CATEGORIES

OWNED = "owner long, item_id long, category string, sub_category string, colour string, pattern string, pattern_conf double"


def _wardrobes(spark, n=12):
    rng = random.Random(3)
    maybe = lambda names: rng.choice([*names, None])
    rows = [(o, 100 * o + i, rng.choice(CATEGORIES), maybe(SUB_CATEGORIES), maybe(COLOURS), maybe(PATTERNS), rng.random()) for o in range(n) for i in range(rng.choice((1, 8, 30)))]
    return spark.createDataFrame(rows, OWNED)


def test_completed_is_complete_without_a_second_shuffle(spark):
    owned = _wardrobes(spark)
    for swimwear in (False, True, None):
        told = lambda df: sorted((r["owner"], r["place"], tuple(i["id"] for i in r["items"]), r["score"]) for r in df.collect())
        got = outfits.completed(owned, "owner", swimwear)
        assert told(got) == told(outfits.complete(outfits.top_cores(owned, "owner", swimwear=swimwear), owned, "owner"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and "Join" not in plan and "Window" not in plan


def test_fit_scores_leave_out_what_clashes(spark):
    sets = outfits.held_by(_wardrobes(spark), "owner").select(F.slice("held", 1, 4).alias("a"), F.slice("held", 3, 9).alias("b"))
    fits = lambda o: ~F.exists("a", lambda i: i["id"] == o["id"]) & (F.size(outfits.clash_reasons(F.concat("a", F.array(o)))) == 0)
    want = F.transform("b", lambda o: F.when(fits(o), outfits.set_score(F.concat("a", F.array(o)))))
    for r in sets.select(want.alias("want"), outfits.fit_scores(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_vectors_meet_outfits_where_they_are_summed(spark):
    plan = QUERIES["pair_style"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"Exchange hashpartitioning\(outfit_id#\d+L?, \d+\), (\w+)", plan)
    assert moves == ["REPARTITION_BY_NUM"]
