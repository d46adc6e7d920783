"""Running sums and as-of joins over ranges, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import timeline


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, *range(400)]), rng.randint(0, 3)) for _ in range(3000)]
    got = timeline.running_sums(spark.createDataFrame(rows, "g string, v int, n int"), ["g"], "v", "n").collect()
    known = [r for r in rows if r[1] is not None]
    assert len(got) == len({r[:2] for r in known})
    for r in got:
        group = [x for x in known if x[0] == r["g"]]
        assert (r["below"], r["amount"], r["total"]) == (sum(n for _, v, n in group if v < r["v"]), sum(n for _, v, n in group if v == r["v"]), sum(n for *_, n in group))


def test_as_of_takes_the_last_fact(spark, many_ranges):
    rng = random.Random(2)
    day = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 500))
    key = lambda: rng.choice(["hot"] * 9 + [f"k{i}" for i in range(9)])
    facts = [(key() if rng.random() > 0.02 else None, day() if rng.random() > 0.02 else None, i, rng.choice(["in", "out", None])) for i in range(900)]
    asks = [(i, key() if rng.random() > 0.05 else None, day() if rng.random() > 0.05 else None, "mine") for i in range(700)] + [(1, "hot", dt.datetime(2025, 1, 1), "mine"), (2, "no facts", day(), "mine")] * 2
    left, right = spark.createDataFrame(asks, "id int, k string, t timestamp, _row string"), spark.createDataFrame(facts, "k string, t timestamp, n int, state string")
    got = timeline.as_of(left, right, ["k"], "t", ["state", "n"], "n")
    assert sorted(got.columns) == sorted(["id", "k", "t", "_row", "state", "n"])
    want = []
    for i, k, t, m in asks:
        seen = [f for f in facts if k and t and f[0] == k and f[1] is not None and f[1] <= t]
        last = max(seen, key=lambda f: (f[1], f[2]), default=(None,) * 4)
        want.append((i, k, t, m, last[3], last[2]))
    assert sorted(map(str, [(r["id"], r["k"], r["t"], r["_row"], r["state"], r["n"]) for r in got.collect()])) == sorted(map(str, want))


def test_empty_sides(spark):
    asks, facts = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int"), spark.createDataFrame([("a", 1, 1, "x")], "k string, t int, n int, s string")
    assert timeline.as_of(asks.limit(0), facts, ["k"], "t", ["s"], "n").count() == 0
    assert [tuple(r) for r in timeline.as_of(asks, facts.limit(0), ["k"], "t", ["s"], "n").collect()] == [(1, "a", 5, None)]
    assert timeline.running_sums(facts.limit(0), ["k"], "t", "n").count() == 0


def test_a_hot_key_is_split_by_time(spark, many_ranges):
    facts = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("n"), F.col("id").alias("s"))
    held = timeline._ranged(facts, ["k", "t"])
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2000
