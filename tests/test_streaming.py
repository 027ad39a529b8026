from pyspark.sql import functions as F

from wareflow.operators import stores
from wareflow.streaming import incremental


def write(spark, path, rows):
    spark.createDataFrame(rows, "asin string, ts timestamp, price double, target double").coalesce(1).write.parquet(str(path))


def test_watched_prices_match_batch(spark, tmp_path):
    import datetime

    t = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i) for i in range(6)]
    rows = [("a", t[0], 10.0, 8.0), ("a", t[1], 8.0, 8.0), ("a", t[2], None, 8.0), ("a", t[3], 7.0, 8.0), ("b", t[4], 3.0, 8.0), ("b", t[5], 4.0, 8.0)]
    write(spark, tmp_path / "in", rows)
    stream = spark.readStream.schema("asin string, ts timestamp, price double, target double").parquet(str(tmp_path / "in"))
    job = incremental.watch_prices(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = sorted((r.asin, r.price) for r in spark.read.parquet(str(tmp_path / "out")).where("alert").collect())
    data = spark.createDataFrame(rows, "asin string, ts timestamp, price double, target double").where("price IS NOT NULL")
    batch = stores.price_alerts(data.select("asin", "ts", "price"), data.select("asin", "target").distinct())
    assert got == sorted((r.asin, r.price) for r in batch.collect()) == [("a", 7.0), ("a", 8.0)]


def test_filter_in_micro_batches(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", None, 1.0, None), ("b", None, 9.0, None)])
    stream = spark.readStream.schema("asin string, ts timestamp, price double, target double").parquet(str(tmp_path / "in"))
    seen = []
    job = incremental.filtered(stream, lambda: F.when(F.col("price") > 5, "hide").otherwise("show"), lambda df, n: seen.extend(map(tuple, df.select("asin", "filter_result").collect())), str(tmp_path / "c"))
    job.awaitTermination()
    assert sorted(seen) == [("a", "show"), ("b", "hide")]


def test_unseen_keeps_rows_without_a_key(spark, tmp_path):
    import datetime

    t = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i) for i in range(6)]
    rows = [("a", t[0], 1.0, None), ("a", t[1], 2.0, None), (None, t[2], 3.0, None), (None, t[2], 3.0, None), ("b", t[3], 4.0, None), (None, None, 5.0, None)]
    write(spark, tmp_path / "in", rows)
    stream = spark.readStream.schema("asin string, ts timestamp, price double, target double").parquet(str(tmp_path / "in"))
    job = incremental.unseen(stream, "asin", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.asin for r in got if r.asin) == ["a", "b"]
    assert sorted(r.price for r in got if r.asin is None) == [3.0, 3.0, 5.0]


def test_failed_checks_are_counted_and_skipped(spark, tmp_path):
    import datetime

    t = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i) for i in range(10)]
    write(spark, tmp_path / "in", [("a", t[0], 5.0, 9.0), *(("a", t[k], None, 9.0) for k in range(1, 8)), ("a", t[8], 4.0, 9.0)])
    stream = spark.readStream.schema("asin string, ts timestamp, price double, target double").parquet(str(tmp_path / "in"))
    job = incremental.watch_prices(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [r.failures for r in rows] == [0, 1, 2, 3, 4, 5, 0] and rows[-1].alert and rows[-1].history == [5.0, 4.0]


def test_late_details_judge_a_row_again(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", None, 1.0, None), ("c", None, 2.0, None)])
    stream = spark.readStream.schema("asin string, ts timestamp, price double, target double").parquet(str(tmp_path / "in")).select("asin", "price")
    rows = spark.createDataFrame([("a", 3), ("b", 4)], "asin string, quality int")
    verdict = lambda: F.when((F.col("price") < 5) & (F.col("quality") > 2), "show").otherwise("hide")
    job = incremental.late(stream, rows, "asin", verdict).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert [(r.asin, r.filter_result) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "show")]


def test_watched_state_restarts_and_resets(spark, tmp_path):
    """Two runs from one checkpoint: failures are skipped after the limit, a silence starts an item anew, a reset forgets keys."""
    import datetime

    from wareflow.streaming import keyed_state

    day = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    schema = "asin string, ts timestamp, price double, target double, reset boolean"
    slices = [
        [("a", day(0, 2), 8.0, 9.0, False), ("a", day(0), 10.0, 9.0, False), *(("a", day(0, 3 + k), None, 9.0, False) for k in range(3)), (None, day(0), 1.0, 9.0, False), ("a", None, 1.0, 9.0, False)],
        [("a", day(1), 7.0, 9.0, True), ("a", day(1, 1), 7.0, 9.0, False), ("a", day(9), 6.0, 9.0, False), ("a", day(9, 1), 5.0, 9.0, False)],
    ]
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for name, shape in (("w", lambda s: keyed_state.watched(s, 3, 2)), ("r", lambda s: keyed_state.unseen_since_reset(s.selectExpr("asin AS scope", "cast(price AS string) AS key", "ts", "reset")))):
            job = keyed_state.started(shape(stream), lambda s, name=name: s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start())
            job.awaitTermination()
    got = [(r.price, r.alert, list(r.history), r.failures, r.restarted) for r in spark.read.parquet(str(tmp_path / "w")).where("asin = 'a'").orderBy("ts").collect()]
    assert got == [
        (10.0, False, [10.0], 0, False), (8.0, True, [10.0, 8.0], 0, False), (None, False, [10.0, 8.0], 1, False), (None, False, [10.0, 8.0], 2, False), (7.0, True, [10.0, 8.0, 7.0], 0, False),
        (7.0, False, [10.0, 8.0, 7.0, 7.0], 0, False), (6.0, False, [6.0], 0, True), (5.0, True, [6.0, 5.0], 0, False),
    ]
    seen = [r.key for r in spark.read.parquet(str(tmp_path / "r")).where("scope = 'a'").orderBy("ts").collect()]
    assert seen == ["10.0", "8.0", None, None, None, "7.0", "6.0", "5.0"] and spark.conf.get(keyed_state.PROVIDER, "") != keyed_state.ROCKS


def test_silence_over_an_expired_state_is_a_restart(spark, tmp_path):
    """The timer of an item's silence has fired in an earlier run; checks of one instant count together."""
    import datetime

    from wareflow.streaming import keyed_state

    day = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    schema = "asin string, ts timestamp, price double, target double"
    slices = [[("a", day(0), 10.0, 9.0), ("b", day(9), 1.0, 9.0)], [("a", day(10), 8.0, 9.0), ("a", day(10, 1), None, 9.0), ("a", day(10, 1), 7.0, 9.0), ("a", day(10, 1), None, 9.0)]]
    for rows in slices:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = keyed_state.watched(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 5)
        keyed_state.started(stream, lambda s: s.writeStream.format("parquet").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()).awaitTermination()
    got = [(r.price, r.alert, list(r.history), r.failures, r.restarted) for r in spark.read.parquet(str(tmp_path / "w")).where("asin = 'a'").collect()]
    assert sorted(got, key=str) == sorted([(10.0, False, [10.0], 0, False), (8.0, False, [8.0], 0, True), (7.0, True, [8.0, 7.0], 0, False), (None, False, [8.0, 7.0], 2, False), (None, False, [8.0, 7.0], 2, False)], key=str)
