import datetime as dt

from weftline.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def stream_of(spark, tmp_path, batches, shape):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_count_and_close(spark, tmp_path):
    rows = [(T0 + dt.timedelta(hours=h), "view" if h % 2 else "click") for h in range(72)]
    df = stream_of(spark, tmp_path, [rows], "ts timestamp, event_type string")
    got = {(r["start"].day, r["event_type"]): r["n"] for r in drained(spark, flows.counts_by_window(df, late="1 hour"), "w1")}
    assert got == {(d, k): 12 for d in (1, 2) for k in ("view", "click")}


def test_one_entry_a_day(spark, tmp_path):
    rows = [(1, T0, ["a", "b"]), (1, T0 + dt.timedelta(hours=2), ["b", "a"]), (1, T0 + dt.timedelta(hours=3), ["a"]), (2, T0, ["a", "b"])]
    df = stream_of(spark, tmp_path, [rows[:1], rows[1:]], "user long, ts timestamp, items array<string>")
    got = drained(spark, flows.once_a_day(df, "user", "items"), "w2")
    assert sorted((r["user"], r["set_key"]) for r in got) == [(1, "a"), (1, "a|b"), (2, "a|b")]


def test_silent_jobs_are_lost(spark, tmp_path):
    s = dt.timedelta(seconds=1)
    df = stream_of(spark, tmp_path, [[("a", T0), ("b", T0)], [("b", T0 + 100 * s)], [("b", T0 + 200 * s)], [("b", T0 + 290 * s)]], "job string, ts timestamp")
    got = drained(spark, flows.lost_jobs(df), "w3")
    assert [r["job"] for r in got if r["lost"]] == ["a"]


def test_incremental_sync(spark, tmp_path):
    shape = "external_id long, image_url string, price double, readable boolean"
    df = stream_of(spark, tmp_path, [[(1, "u1", 5.0, True), (2, "u2", 6.0, True)], [(1, "u1", 7.0, True), (3, "u3", 1.0, False)]], shape)
    held = {"now": spark.createDataFrame([], "external_id long, image_url string, price double, status string, labels string")}

    def write(snapshot, number):
        snapshot.write.parquet(str(tmp_path / f"s{number}"))
        held["now"] = spark.read.parquet(str(tmp_path / f"s{number}"))

    q = flows.sync_stream(df, lambda: held["now"], write).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["external_id"], r["price"], r["status"]) for r in held["now"].collect()) == [(1, 7.0, "active"), (2, 6.0, "active")]
