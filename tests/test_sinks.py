import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import advice, mapping, outfits, profiles, quiz
from weftline.operators.timeline import as_of
from weftline.sources import files, sinks

ITEM = "owner long, item_id long, category string, sub_category string, colour string, pattern string, pattern_conf double"


def test_checked_overwrite_and_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    fine, broken = (spark.createDataFrame([("ids", n)], "check_name string, violations long") for n in (0, 2))
    sinks.checked_overwrite(spark.range(3), fine, path)
    with pytest.raises(ValueError, match="ids"):
        sinks.checked_overwrite(spark.range(9), broken, path)
    assert spark.read.parquet(path).count() == 3
    for n in (5, 7):
        sinks.swap_in(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_publishing_never_leaves_a_reader_without_a_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for n in (3, 5, 7):
        before = sinks.published(spark, path) if n > 3 else None
        made = sinks.publish(spark.range(n), path)
        assert sinks.published(spark, path) == made and spark.read.parquet(made).count() == n
        assert before is None or spark.read.parquet(before).count() == n - 2  # who resolved the pointer before still reads
    assert sum(x.name.startswith("v-") for x in (tmp_path / "t").iterdir()) == 2

    def stop(*_):
        raise OSError("stopped between the two steps")

    monkeypatch.setattr(sinks, "point", stop)
    with pytest.raises(OSError, match="between"):
        sinks.publish(spark.range(9), path)
    assert spark.read.parquet(sinks.published(spark, path)).count() == 7


def test_stock_history_is_appended_and_read_as_of_a_time(spark, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "checked_at string, id string, availability string, sizes_in_stock array<string>").withColumn("checked_at", F.to_timestamp("checked_at"))
    for run in ([("2026-01-01 08:00:00", "a", "in_stock", ["S"]), ("2026-01-01 08:00:00", "b", "out_of_stock", [])], [("2026-01-03 08:00:00", "a", "out_of_stock", [])]):
        sinks.append_log(at(run), str(tmp_path / "history"), "checked_at")
    history = spark.read.parquet(str(tmp_path / "history")).withColumn("seen", F.col("checked_at"))
    asks = spark.createDataFrame([("a", "2026-01-02 00:00:00"), ("a", "2026-01-03 08:00:00"), ("b", "2026-02-01 00:00:00"), ("a", "2025-12-31 00:00:00"), ("c", "2026-02-01 00:00:00")], "id string, t string")
    asks = asks.withColumn("checked_at", F.to_timestamp("t"))
    got = {(r["id"], r["t"][:10]): r["availability"] for r in as_of(asks, history, ["id"], "checked_at", ["availability", "sizes_in_stock", "seen"], "seen").collect()}
    assert got == {("a", "2026-01-02"): "in_stock", ("a", "2026-01-03"): "out_of_stock", ("b", "2026-02-01"): "out_of_stock", ("a", "2025-12-31"): None, ("c", "2026-02-01"): None}


# ---- labelled cases and their report
ANSWER = {"status": 200, "answer": "Wear it.", "message": "what with 7?", "tools": [], "handoff": False, "unknown_refs": [], "pieces": []}
SHOWN = [{"category": "top", "colour": "Red"}]


@pytest.mark.parametrize(
    ("answer", "checks", "fails"),
    [
        ({}, {}, []), ({"status": 500}, {"no_tools": True}, ["http 500"]), ({"status": None}, {}, ["http none"]), ({"answer": " "}, {}, ["empty answer"]),
        ({"unknown_refs": [7, 9]}, {}, ["invented piece numbers [9]", "wrote the user's number(s) [7] as pieces"]),
        ({"tools": ["b"]}, {"tools_any": ["a", "c"]}, ["expected one of [a, c], called [b]"]), ({}, {"tools_any": ["a"]}, ["expected one of [a], called no tool"]), ({"tools": ["a"]}, {"tools_any": ["a"]}, []),
        ({"tools": ["x", "y"]}, {"no_tools": True, "forbid_tools": ["y", "z"]}, ["expected no tool, called [x, y]", "called forbidden tool y"]),
        ({"pieces": SHOWN}, {"min_pieces": 2, "max_pieces": 0}, ["showed 1 pieces, expected at least 2", "showed 1 pieces, expected at most 0"]),
        ({"pieces": SHOWN}, {"forbid_pieces": [{"colour": "red", "category": "TOP"}, {"colour": "blue"}, {"style": "x"}]}, ['showed a piece matching {"colour":"red","category":"TOP"}']),
        ({"answer": "the dress is with you"}, {"reply_lang": "fr"}, ["answered in en, expected fr"]), ({"answer": "la robe est avec toi"}, {"reply_lang": "fr"}, []),
        ({"answer": "I\nAM an AI"}, {"forbid_patterns": ["i.am", "robot"]}, ["answer matches forbidden pattern i.am"]),
        ({}, {"handoff": True}, ["expected a handoff"]), ({"handoff": True}, {"handoff": False}, ["handed over, expected no handoff"]), ({"answer": "a? b؟"}, {"max_questions": 1}, ["2 question marks, at most 1"]),
    ],
)
def test_checks_come_from_the_cases(spark, tmp_path, answer, checks, fails):
    (tmp_path / "cases.jsonl").write_text(json.dumps({"id": "c1", "message": ANSWER["message"], "checks": checks}))
    cases = files.read_cases(spark, str(tmp_path / "cases.jsonl"), quiz.CASES)
    told = {**ANSWER, **answer}
    shape = "id string, status int, answer string, tools array<string>, handoff boolean, unknown_refs array<int>, pieces array<map<string,string>>"
    answers = spark.createDataFrame([("c1", *[told[k] for k in ("status", "answer", "tools", "handoff", "unknown_refs", "pieces")])], shape)
    assert quiz.scored(answers, cases).first()["fails"] == fails


def test_cases_have_ids_of_their_own_and_a_report(spark, tmp_path):
    lines = [{"id": "a", "split": "test", "expected": "x"}, {"id": "b", "expected": "y"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [r["id"] for r in files.read_cases(spark, str(tmp_path / "c.jsonl"), quiz.CASES, "dev").collect()] == ["b"]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, [*lines, {"id": "a"}])))
    with pytest.raises(ValueError, match="'a'"):
        files.read_cases(spark, str(tmp_path / "d.jsonl"), quiz.CASES)
    answers = spark.createDataFrame([("a", "x", "x", True, True), ("b", "y", "x|z", True, False)], "id string, expected string, chosen string, scored boolean, ok boolean")
    sinks.write_report("Router", {"By agent": profiles.router_accuracy(answers).orderBy("expected"), "Mix-ups": profiles.mix_ups(answers), "None": answers.limit(0)}, answers, str(tmp_path / "r"))
    text = (tmp_path / "r/report.md").read_text()
    assert "# Router" in text and "| y | x\\|z | 1 |" in text and text.rstrip().endswith("None.") and spark.read.json(str(tmp_path / "r/rows")).count() == 2
    with pytest.raises(ValueError, match="no report"):
        sinks.pipe_table(spark.range(5), most=4)


def test_coverage_counts_linked_parts(spark):
    told = spark.createDataFrame([(1, "length", "mini"), (1, "nickname", "shirt"), (2, "length", "none"), (9, "sleeve", "long"), (3, "neck", "v")], "item long, kind string, name string")
    rules = spark.createDataFrame([("length", "mini", 2, "length"), ("nickname", "shirt", 4, "nickname"), ("sleeve", "long", 1, "sleeve")], "kind string, name string, score int, source string")
    got = {r["item"]: (r["coverage"], r["coverage_from"]) for r in mapping.coverage(told, rules, "item", spark.createDataFrame([(9, 1)], "part long, item long")).collect()}
    assert got == {1: (1, "length|nickname|sleeve"), 9: (1, "sleeve")}


def test_log_and_missing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, at string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"), "at")
    assert spark.read.parquet(str(tmp_path / "log")).filter("day = '2024-01-02'").count() == 2

    def square(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "sq": b["id"] ** 2})

    keys = spark.createDataFrame([(3,), (3,), (4,), (5,), (None,)], "id long")
    got = sinks.compute_missing(keys, spark.createDataFrame([(4, 16)], "id long, sq long"), "id", square, "id long, sq long")
    assert sorted((r["id"], r["sq"]) for r in got.collect()) == [(3, 9), (5, 25)]


def test_settings_keep_order_and_notes(tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("name,value,note\nb,2,why\na,1,\n")
    sinks.rewrite_settings(str(path), {"a": 1.5})
    assert path.read_text() == "name,value,note\nb,2,why\na,1.5,\n"

    def refuse(values):
        raise ValueError("no")

    for changes, check in (({"c": 1}, lambda v: None), ({"a": 9}, refuse)):
        with pytest.raises(ValueError):
            sinks.rewrite_settings(str(path), changes, check)
    assert "1.5" in path.read_text()


def test_reports_and_weather(spark, tmp_path):
    (tmp_path / "r.md").write_text("# x\n| a | b |\n|---|:-:|\n| one | 40.0% [1, 2] |\n\n| c |\n|---|\n| 1,234 |\n")
    got = sinks.report_tables(spark, str(tmp_path / "r.md")).withColumn("n", sinks.number_of(F.element_at("cells", -1)))
    assert [(r["table"], r["row"], r["n"]) for r in got.orderBy("table", "row").collect()] == [(0, 0, None), (0, 1, 0.4), (1, 0, None), (1, 1, 1234.0)]
    day = {"daily": {"apparent_temperature_max": [30.0], "apparent_temperature_min": [20.0], "precipitation_probability_max": [60], "weather_code": [61]}}
    rows = sinks.today_weather(spark.createDataFrame([(json.dumps(day),), ("{}",)], "json string")).collect()
    assert tuple(rows[0]) == (25.0, "summer", 60.0, True, "rain") and tuple(rows[1]) == (None,) * 5


def test_buying_counts_outfits_that_beat_what_one_owns(spark):
    wardrobe = [(1, 1, "bottom", None, "white", "solid", 1.0), (1, 2, "shoes", None, "black", None, None), (1, 3, "top", None, "multicolour", "printed", 1.0), (1, 5, "bottom", None, "grey", "solid", 1.0)]
    new = [(1, 4, "top", None, "black", "solid", 1.0)]
    row = advice.buy_advice(spark.createDataFrame(wardrobe, ITEM), spark.createDataFrame(new, ITEM), "owner").first()
    assert (row["outfits"], row["good_outfits"], row["verdict"]) == (2, 0, "skip")  # neutrals go with all: the owned top does as well
    worse = [(1, 3, "top", None, "red", "printed", 1.0) if r[1] == 3 else r for r in wardrobe] + [(1, 6, "bottom", None, "green", "striped", 1.0)]
    row = advice.buy_advice(spark.createDataFrame(worse, ITEM), spark.createDataFrame(new, ITEM), "owner").first()
    assert row["outfits"] == 3 and row["good_outfits"] == 1 and row["verdict"] == "think"


def test_picks_and_clashes(spark):
    rows = [(1, f"k{i}", [i, i % 2], 90.0 - i, label) for i, label in enumerate(["safe", "safe", "safe", "safe", "bolder", "bolder"])]
    df = spark.createDataFrame(rows, "owner long, outfit_key string, ids array<long>, score double, label string").withColumn("items", F.transform("ids", lambda i: F.struct(i.alias("id"))))
    got = [tuple(r) for r in advice.pick_three(df, "owner", "s").orderBy("place").select("outfit_key", "label").collect()]
    assert got == [tuple(r) for r in advice.pick_three(df.repartition(3), "owner", "s").orderBy("place").select("outfit_key", "label").collect()]
    assert len(set(got)) == 3 and got[0][0] in {"k0", "k1", "k2"} and [x[1] for x in got[:2]] == ["safe", "bolder"]
    worn = spark.createDataFrame([(1, 1, "top", "shirt", None, None, None), (1, 2, "bottom", "jeans", None, None, None), (1, 3, "top", "coat", None, None, None), (1, 4, "shoes", "jeans", None, None, None)], ITEM)
    kept = outfits.as_sets(worn, "owner").select(advice.ids_of(advice.resolved(F.col("items"))).alias("ids")).first()["ids"]
    assert kept == [3, 4]
