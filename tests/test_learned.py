"""Fits on sums against plain numpy, the served price loop, and the label check's cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import fits, learned, outfits, price_model


def frame(spark, x, parts=3, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in x[i]], *[None if columns[c][i] is None else columns[c][i] for c in names]) for i in range(len(x))]
    kinds = {"y": "double", "fold": "long", "price": "double"}
    return spark.createDataFrame(rows, "id long, x array<double>" + "".join(f", {c} {kinds.get(c, 'string')}" for c in names)).repartition(parts)


def plain_ridge(x, y, alpha):
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-12] = 1
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / spread
    return w, y.mean() - mean @ w


def plain_nested(x, y, fold, alphas):
    out = {}
    for f in sorted(set(fold)):
        inner = [g for g in sorted(set(fold)) if g != f]
        error = []
        for a in alphas:
            e = 0.0
            for g in inner:
                train, test = (fold != f) & (fold != g), fold == g
                w, b = plain_ridge(x[train], y[train], a)
                e += ((y[test] - x[test] @ w - b) ** 2).sum()
            error.append(e)
        best = alphas[int(np.argmin(error))]
        out[f] = (*plain_ridge(x[fold != f], y[fold != f], best), best)
    return out


@pytest.fixture(scope="module")
def priced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6))
    x[:, 5] = 1.0  # no deviation
    logged = x @ np.array([0.3, -0.2, 0.1, 0, 0.4, 0]) + rng.normal(scale=0.3, size=240)
    channel = np.where(rng.random(240) < 0.4, "second hand", "ads")
    price = np.round(np.exp(3 + logged + (channel == "ads") * 0.7), 2)
    category = rng.choice(["a", "b", "rare"], p=[0.6, 0.37, 0.03], size=240)
    return x, price, channel, category, rng.integers(0, 5, 240)


def test_nested_ridge_is_the_plain_loop(spark, priced):
    x, price, _, _, fold = priced
    y = np.log(price)
    got = fits.nested_ridge(fits.grams(frame(spark, x, y=y.tolist(), fold=fold.tolist()), "x", "y", "fold"))
    for f, (w, b, alpha) in plain_nested(x, y, fold, fits.ALPHAS).items():
        assert got[f].alpha == pytest.approx(alpha)
        assert got[f].weights == pytest.approx(w, abs=1e-8) and got[f].intercept == pytest.approx(b, abs=1e-8)
    with pytest.raises(ValueError, match="two folds"):
        fits.nested_ridge({0: np.eye(3)})


def test_served_errors_are_the_plain_loop(spark, priced):
    x, price, channel, category, fold = priced
    rows = frame(spark, x, price=price.tolist(), channel=channel.tolist(), category=category.tolist(), fold=fold.tolist())
    rows = price_model.with_target(rows, "channel", "price")
    models = fits.nested_ridge(fits.grams(rows, "x", "target", "fold"))
    told = price_model.served_errors(rows, models, "x", "fold", "channel", "category", "price")
    got = {r["id"]: r for r in told.collect()}
    offset = {c: np.log(price[channel == c]).mean() for c in set(channel)}
    y = np.log(price) - np.array([offset[c] for c in channel])
    want = {}
    for f, (w, b, _) in plain_nested(x, y, fold, fits.ALPHAS).items():
        scores = np.round(x @ w + b, 9)
        train = fold != f
        for i in np.flatnonzero(~train):
            pct = (scores[train] < scores[i]).sum() / train.sum()
            near = train & (channel == channel[i])
            same = near & (category == category[i])
            served = np.round(np.round(np.quantile(price[same if same.sum() >= 8 else near], pct), 6))
            want[i] = (pct, served, abs(np.log(max(served, 1)) - np.log(price[i])))
    assert set(got) == set(want)
    for i, (pct, served, error) in want.items():
        assert got[i]["pct"] == pytest.approx(pct) and got[i]["served"] == served and got[i]["error"] == pytest.approx(error)
    factors = {r["channel"]: (r["n"], r["factor"]) for r in price_model.typical_errors(told, "channel").collect()}
    for c in ("second hand", "ads", "All"):
        of = [want[i][2] for i in want if c in ("All", channel[i])]
        assert factors[c] == (len(of), pytest.approx(np.exp(np.mean(of))))


def test_rows_that_lack_something_count_for_no_fit(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 1.0, 0), (None, 1.0, 0), ([1.0, 2.0], None, 0), ([1.0, 2.0], 1.0, None), ([0.0, 1.0], 2.0, 1)], "x array<double>, y double, fold long")
    got = fits.grams(rows, "x", "y", "fold")
    assert {f: g[0, 0] for f, g in got.items()} == {0: 1.0, 1: 1.0}
    assert fits.grams(rows.limit(0), "x", "y", "fold") == {}


@pytest.mark.parametrize(("intercept", "balanced"), [(True, False), (True, True), (False, False)])
def test_logistic_is_the_least_of_its_loss(spark, intercept, balanced):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x @ [2.0, -1, 0, 0.5] + rng.normal(size=300) > 0.8).astype(float)
    got = fits.logistic(frame(spark, x, y=y.tolist()), "x", "y", penalty=0.7, intercept=intercept, balanced=balanced)
    s = np.where(y == 1, 300 / 2 / y.sum(), 300 / 2 / (300 - y.sum())) if balanced else np.ones(300)
    p = 1 / (1 + np.exp(-(x @ got.weights[0] + got.intercepts[0])))
    assert np.abs((s * (p - y)) @ x + 0.7 * got.weights[0]).max() < 1e-6
    assert abs((s * (p - y)).sum()) < 1e-6 if intercept else got.intercepts[0] == 0


def test_logistic_parts_what_can_be_parted(spark):
    x = np.array([[1.0], [2.0], [-1.0], [-2.0]] * 5)
    got = fits.logistic(frame(spark, x, y=[1.0, 1.0, 0.0, 0.0] * 5), "x", "y", penalty=1e-3)
    assert got.weights[0, 0] > 2
    with pytest.raises(ValueError, match="both answers"):
        fits.logistic(frame(spark, x, y=[1.0] * 20), "x", "y")


@pytest.mark.parametrize("balanced", [True, False])
def test_softmax_is_the_least_of_its_loss(spark, balanced):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    names = np.array(["ada", "bob", "cyd", "dee"])
    y = names[(x @ rng.normal(size=(5, 4)) * 2 + [0, 0, 1, -1] + rng.gumbel(size=(400, 4))).argmax(1)]
    got = fits.softmax(frame(spark, x, label=y.tolist()), "x", "label", penalty=0.5, balanced=balanced, close=1e-8)
    assert got.classes == sorted(set(y))
    z = x @ got.weights.T + got.intercepts
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    hot = y[:, None] == np.array(got.classes)
    s = 400 / 4 / hot.sum(0)[hot.argmax(1)] if balanced else np.ones(400)
    slope = (s[:, None] * (p - hot)).T @ x + 0.5 * got.weights
    assert np.abs(slope).max() < 1e-4 and np.abs((s[:, None] * (p - hot)).sum(0)).max() < 1e-4


def test_told_keeps_rows_without_features(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "id long, x array<double>")
    got = rows.select("id", fits.told(F.col("x"), np.array([[1.0, 1.0], [0.0, 2.0]]), np.array([0.5, 0.0])).alias("z")).collect()
    assert {r["id"]: r["z"] for r in got} == {1: [3.5, 4.0], 2: None, 3: [1.5, 2.0]}


# ---- the label check
PROBE = fits.Logits(np.zeros((4, 3)), np.array([3.0, 2.0, 1.0, 0.0]), ["gucci", "nike", "puma", "adidas"])


@pytest.mark.parametrize(
    ("title", "asking", "claimed", "original", "supports", "ratio", "action"),
    [
        ("Adidas original", 5.0, "adidas", True, False, 0.25, "ask_label_photo"),
        ("Adidas original", 25.0, "adidas", True, False, 1.25, None),
        ("Nike Air Max", 5.0, "nike", False, True, 0.25, None),
        ("robe fleurie", 5.0, None, False, None, None, None),
        ("Adidas", None, "adidas", False, False, None, None),
        ("Zara authentique", 1.0, "zara", True, None, 0.05, None),
        (None, 1.0, None, False, None, None, None),
        ("adidas 100 % vrai", 10.0, "adidas", True, False, 0.5, None),
    ],
)
def test_label_check_needs_both(spark, title, asking, claimed, original, supports, ratio, action):
    ads = spark.createDataFrame([(title, None, asking, 20.0, [0.1, 0.2, 0.3])], "title string, about string, asking double, estimate double, x array<double>")
    r = learned.label_check(ads, PROBE, "x", "title", "about", "asking", "estimate").first()
    assert (r["claimed_brand"], r["claims_original"], r["photo_supports_claim"], r["price_ratio"], r["action"]) == (claimed, original, supports, ratio, action)
    if claimed in PROBE.classes:
        assert [b["brand"] for b in r["photo_brands"]] == ["gucci", "nike", "puma"] and r["photo_brands"][0]["p"] == 0.644
    assert (r["message"] is None) == (action is None)
    either = learned.label_check(ads, PROBE, "x", "title", "about", "asking", "estimate", both=False).first()
    assert either["action"] == ("ask_label_photo" if supports is False or (ratio is not None and ratio < 0.5) else None)


def test_brand_probe_learns_only_brands_with_enough_ads(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 3)) + c for c in ([4, 0, 0], [0, 4, 0])] + [rng.normal(size=(7, 3))])
    brand = ["nike"] * 20 + ["zara"] * 20 + ["fila"] * 7
    ads = frame(spark, x, brand=brand)
    probe = learned.brand_probe(ads, "x", "brand")
    assert probe.classes == ["nike", "zara"]
    told = ads.withColumn("z", fits.told(F.col("x"), probe.weights, probe.intercepts))
    got = {r["id"]: r["best"] for r in told.select("id", learned.chances(F.col("z"), probe.classes)[0]["brand"].alias("best")).collect()}
    assert sum(got[i] == brand[i] for i in range(40)) >= 38


def test_worn_hints_mark_the_lowest_tenth(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    new = [None if i % 4 == 0 else float(x[i, 0] > 0) for i in range(200)]
    got = learned.worn_hints(frame(spark, x, y=new), "x", "y").collect()
    marked = [r["id"] for r in got if r["worn_hint"]]
    assert len(marked) == 20 and x[marked, 0].max() < np.quantile(x[:, 0], 0.3)


# ---- part weights
def test_weights_prefer_the_part_that_tells(spark):
    rng = np.random.default_rng(8)
    d = np.column_stack([rng.normal(0.6, 0.3, 200), rng.normal(0, 0.3, 200), rng.normal(0.2, 0.3, 200), rng.normal(-0.5, 0.2, 200)])
    got = learned.part_weights(frame(spark, d).withColumnRenamed("x", "differences"))
    assert list(got) == list(outfits.WEIGHTS) and sum(got.values()) == pytest.approx(1, abs=0.02)
    assert got["style"] > got["pattern"] > 0 and got["structure"] == 0
    w = np.zeros(4)
    both, y = np.concatenate([d, -d]), np.repeat([1.0, 0.0], 200)
    for _ in range(50):
        p = 1 / (1 + np.exp(-both @ w))
        w -= np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + np.eye(4), both.T @ (p - y) + w)
    w = np.clip(w, 0, None)
    assert list(got.values()) == [round(v, 2) for v in (w / w.sum()).tolist()]
