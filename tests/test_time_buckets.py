"""Spans and last values through buckets of time, against plain windows, with one key that holds nearly all rows."""

import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from wareflow.operators import stores, time_buckets

DAY = time_buckets.DAY


def rows(n=3000, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        key = "hot" if r.random() < 0.9 else r.choice(("a", "b", None))
        t = r.choice((r.randrange(-5 * DAY, 400 * DAY), r.randrange(40) * DAY, 0, -1, 7 * DAY, 7 * DAY + 1))
        out.append((k, key, None if r.random() < 0.02 else t, r.randrange(5), None if r.random() < 0.3 else float(k)))
    return out


def test_spans_equal_windows(spark):
    df = spark.createDataFrame(rows(), "id long, key string, t long, v int, p double").repartition(4)
    for after in (0, 1, DAY, 7 * DAY):
        w = Window.partitionBy("key").orderBy("t").rangeBetween(0, after)
        want = {(r.key, r.t): (r.n, r.s) for r in df.where("t IS NOT NULL").select("key", "t", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s")).collect()}
        got = time_buckets.span_sums(df, "key", "t", {"n": F.lit(1), "s": F.col("v")}, after).collect()
        assert {(r.key, r.t): (r.n, r.s) for r in got} == want and len(got) == len(want)


def test_no_task_holds_a_hot_key(spark):
    """90 % of the rows are one key's: the groups that running sums go through stay at two buckets' rows."""
    data = [(k, "hot" if k % 10 else "b", k * 3_600_000_000) for k in range(20_000)]
    df = spark.createDataFrame(data, "id long, key string, t long")
    instants = df.groupBy("key", "t").agg(F.sum(F.lit(1)).alias("n"))
    sizes = [r["count"] for r in time_buckets.dealt(instants, "key", "t", ["n"], 7 * DAY).groupBy("key", "bucket").count().collect()]
    assert max(sizes) <= 3 * (7 * 24 + 1) and len(sizes) > 100
    plan = time_buckets.fullest(df, "key", "t", 7 * DAY, "most")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and "bucket#" in plan
    assert {r.key: r.most for r in time_buckets.fullest(df, "key", "t", 7 * DAY, "most").collect()} == {"hot": 153, "b": 17}


def test_last_before_equals_windows(spark):
    df = spark.createDataFrame(rows(seed=2), "id long, key string, t long, v int, p double").repartition(4)
    for inclusive, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, end)
        want = {r.id: r.x for r in df.where("t IS NOT NULL").select("id", F.last("p", ignorenulls=True).over(w).alias("x")).collect()}
        for width in (3_600_000_000, DAY, 1000 * DAY):
            got = {r.id: (r.t, r.x) for r in time_buckets.last_before(df, "key", "t", ["t", "id"], "p", "x", inclusive, width).collect()}
            assert len(got) == 3000 and all(x is None if t is None else x == want[i] for i, (t, x) in got.items())


def test_hot_store_operators(spark):
    r = random.Random(3)
    events = [(k, "hot" if r.random() < 0.9 else "b", r.randrange(500) * 3600, r.choice("xyz"), float(r.randrange(50))) for k in range(2000)]
    df = spark.createDataFrame(events, "id long, user_id string, s long, feature string, price double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.user_id: r.busiest_week for r in stores.usage(df).collect()}
    for user in ("hot", "b"):
        times = sorted(s for _, u, s, _, _ in events if u == user)
        assert got[user] == max(sum(t <= x <= t + 7 * 86400 for x in times) for t in times)
    assert Counter(r.user_id for r in stores.usage(df).collect()) == {"hot": 1, "b": 1}
    assert stores.usage(df.limit(0)).count() == 0
