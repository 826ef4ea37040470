from quartzfolio.streaming import events


def drained(query_df, mode, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q.sparkSession if hasattr(q, "sparkSession") else None


def copied(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_windows_of_a_stream_are_those_of_the_batch(spark, sf_dir, tmp_path):
    path = copied(spark, sf_dir, tmp_path)
    drained(events.rate_windows(events.read(spark, path)), "complete", "rates")
    got = sorted(map(tuple, spark.table("rates").collect()))
    assert got == sorted(map(tuple, events.rate_windows(spark.read.parquet(path)).collect()))


def fed(stream, folder, tmp_path, parts, name):
    """Runs a stream once for each part, with one checkpoint; returns its rows."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180), i
    return part.sparkSession.read.parquet(str(tmp_path / name)).collect()


def test_alerts_keep_their_state_over_batches(spark, sf_dir, tmp_path):
    from quartzfolio.operators import learning

    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    cuts = ["2000-01-01", "2024-01-08", "2024-01-19", "2100-01-01"]
    parts = [e.where(f"ts >= '{a}' AND ts < '{b}'") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    (tmp_path / "errors").mkdir()
    stream = events.alerts(events.read(spark, str(tmp_path / "errors")), "5 days")
    got = sorted(r["event_id"] for r in fed(stream, str(tmp_path / "errors"), tmp_path, parts, "alerts"))
    want = sorted(r["event_id"] for r in learning.cooldown(e.selectExpr("user_id AS key", "ts", "event_id"), "5 days").collect())
    assert len(want) > 5
    assert got == want


def test_rows_past_the_watermark_are_left_out(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = lambda *ts: spark.createDataFrame([(i, t, 1, "view", 1.0, "{}") for i, t in enumerate(ts)], events.EVENTS)
    (tmp_path / "late").mkdir()
    parts = [rows(at(1), at(1, 10), at(9)), rows(at(1, 20), at(8, 30), at(10)), rows(at(20)), rows(at(21))]  # 1:20 comes when the mark is at 7:00
    got = {(r["window_start"].hour, r["n"]) for r in fed(events.rate_windows(events.read(spark, str(tmp_path / "late"))), str(tmp_path / "late"), tmp_path, parts, "windows")}
    assert (1, 2) in got
    assert (8, 1) in got
    assert (9, 1) in got


def test_ingest_appends_items_of_new_files(spark, tmp_path):
    from quartzfolio.sources import catalogs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("name,price\nA,1\nB,2\n")
    stream = lambda: spark.readStream.schema("name string, price string").option("header", True).csv(str(tmp_path / "in"))
    run = lambda: events.ingest(stream(), catalogs.to_items, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (tmp_path / "in/b.csv").write_text("name,price\nC,3\n")
    run()
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]
