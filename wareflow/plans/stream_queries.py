"""Streams over the events: written slice by slice in the order of time, each taken up by a new run of the stream from its checkpoint, as after a restart. The SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.snapshots import KeyedTable
from ..sources.storage import scratch_path
from ..sources.tables import table
from ..streaming import keyed_state, versions
from .registry import query

SLICES = (10, 20, 32)  # days of the month in which the slices end


def _streamed(spark, rows, shape, name: str):
    """Output of shape(stream) over the rows (with a column ts), in slices."""
    base = scratch_path(spark, name)
    start = 0
    for end in SLICES:
        rows.where((F.dayofmonth("ts") >= start) & (F.dayofmonth("ts") < end)).write.mode("append").parquet(f"{base}/in")
        start = end
        stream = shape(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        job = keyed_state.started(stream, lambda s: s.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "watched_stream",
    """WITH e AS (SELECT user_id::VARCHAR AS asin, epoch_us(ts) AS t, CASE WHEN event_type IN ('view', 'purchase') THEN value END AS price FROM events),
g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY asin ORDER BY t) > 172800000000)::INT, 0) AS anew FROM e),
l AS (SELECT *, sum(anew) OVER (PARTITION BY asin ORDER BY t) AS life FROM g),
c AS (SELECT *, count(price) OVER w AS known, last_value(price IGNORE NULLS) OVER (PARTITION BY asin, life ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l WINDOW w AS (PARTITION BY asin, life ORDER BY t)),
f AS (SELECT *, CASE WHEN price IS NULL THEN count(*) FILTER (price IS NULL) OVER (PARTITION BY asin, life, known ORDER BY t) ELSE 0 END AS failures FROM c)
SELECT asin, t AS ts_us, price, coalesce(price <= 40 AND price < before, false) AS alert, least(30, known)::INT AS n_history, failures::INT AS failures, anew = 1 AS restarted FROM f WHERE failures <= 5""",
)
def watched_stream(spark, sf_dir):
    """Watched prices in a stream with timers: alerts, failures, checks skipped after five of them, and items that start anew after two days of silence (ST6, ST8, F19)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("asin"), "ts", F.when(F.col("event_type").isin("view", "purchase"), F.col("value")).alias("price"), F.lit(40.0).alias("target"))
    out = _streamed(spark, rows, lambda s: keyed_state.watched(s, silence_days=2), "watched")
    return out.select("asin", F.unix_micros("ts").alias("ts_us"), "price", "alert", F.size("history").alias("n_history"), "failures", "restarted")


@query(
    "seen_since_reset",
    """WITH e AS (SELECT user_id::VARCHAR AS scope, epoch_us(ts) AS t, event_type = 'signup' AS reset, CASE WHEN floor(value) % 7 > 0 THEN (floor(value) % 7)::INT::VARCHAR END AS key FROM events),
p AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY scope ORDER BY t) AS epoch FROM e)
SELECT scope, key, t AS ts_us FROM p WHERE NOT reset QUALIFY key IS NULL OR row_number() OVER (PARTITION BY scope, epoch, key ORDER BY t) = 1""",
)
def seen_since_reset(spark, sf_dir):
    """Keys that come again after a reset and not before it, in a stream (ST2, ST3)."""
    slot = (F.floor(F.col("value")) % 7).cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scope"), F.when(slot > 0, slot.cast("string")).alias("key"), "ts", (F.col("event_type") == "signup").alias("reset"))
    return _streamed(spark, rows, keyed_state.unseen_since_reset, "seen").select("scope", "key", F.unix_micros("ts").alias("ts_us"))


@query(
    "bounded_lists",
    """WITH e AS (SELECT user_id::VARCHAR AS list_name, (floor(value) % 40)::INT::VARCHAR AS key, epoch_us(ts) AS t, event_id FROM events),
f AS (SELECT list_name, key, min(t) AS t FROM e GROUP BY ALL)
SELECT 'refuse' AS policy, list_name, key, t AS at_us FROM f QUALIFY row_number() OVER (PARTITION BY list_name ORDER BY t, key) <= 12
UNION ALL SELECT 'fifo', list_name, event_id::VARCHAR, t FROM e QUALIFY row_number() OVER (PARTITION BY list_name ORDER BY t DESC) <= 12""",
)
def bounded_lists(spark, sf_dir):
    """Lists of twelve places, one kind that refuses what comes late and one that drops the oldest, after three batches and a replay of the second (ST7, ST10, U5)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("list_name"), (F.floor("value") % 40).cast("int").cast("string").alias("slot"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("at"))
    out = []
    for policy, key in (("refuse", "slot"), ("fifo", "event_id")):
        store = KeyedTable(spark, scratch_path(spark, f"lists-{policy}"), "list_name string, key string, at timestamp", 12, policy)
        start = 0
        for number, end in enumerate(SLICES):
            batch = e.where((F.dayofmonth("at") >= start) & (F.dayofmonth("at") < end)).select("list_name", F.col(key).alias("key"), "at")
            store.add(batch, number)
            if number == 1:
                store.add(batch, number)
            start = end
        out.append(store.read().select(F.lit(policy).alias("policy"), "list_name", "key", F.unix_micros("at").alias("at_us")))
    return out[0].unionByName(out[1])


VERSIONS = [(s, 3 * k + s, 10 * k * 86_400 + 1_704_067_200 if k else 0, 30.0 * k + 5 * s, ("error", "click", "none")[(k + s) % 3]) for s in range(3) for k in range(3)]


@query(
    "versioned_verdicts",
    f"""WITH v(scope, version, begins, least, banned) AS (VALUES {", ".join(str(v) for v in VERSIONS)}), s AS (SELECT *, lead(begins) OVER (PARTITION BY scope ORDER BY begins, version) AS ends FROM v),
e AS (SELECT event_id, user_id % 3 AS scope, epoch_us(ts) AS t, value, event_type FROM events)
SELECT event_id, version::INT AS version, begins::BIGINT * 1000000 <= t AS arrival, CASE WHEN value < least OR event_type = banned THEN 'hide' ELSE 'show' END AS verdict
FROM e JOIN s ON e.scope = s.scope AND (ends IS NULL OR t < ends::BIGINT * 1000000)""",
)
def versioned_verdicts(spark, sf_dir):
    """Events judged by the parameters valid at their time, and again by each later version, in a stream that brings both (F16, ST11)."""
    params = spark.createDataFrame(VERSIONS, "scope int, version int, begins_s long, least double, banned string")
    missing = {"event_id": "long", "at": "timestamp", "value": "double", "event_type": "string"}
    changes = params.select("scope", "version", F.timestamp_seconds("begins_s").alias("begins"), "least", "banned", *(F.lit(None).cast(t).alias(n) for n, t in missing.items()), F.lit(True).alias("is_version"))
    lacking = {"version": "int", "begins": "timestamp", "least": "double", "banned": "string"}
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("scope"), *(F.lit(None).cast(t).alias(n) for n, t in lacking.items()), "event_id", F.col("ts").alias("at"), "value", "event_type", F.lit(False).alias("is_version"))
    base = scratch_path(spark, "versions")
    verdict = lambda: F.when((F.col("value") < F.col("least")) | (F.col("event_type") == F.col("banned")), "hide").otherwise("show")
    start = 0
    for end in SLICES:
        def inside(time, start=start, end=end):  # what begins before the month comes in the first slice
            day = F.greatest(F.floor((F.unix_seconds(time) - 1_704_067_200) / 86_400) + 1, F.lit(0))
            return (day >= start) & (day < end)

        rows.where(inside("at")).unionByName(changes.where(inside("begins"))).write.mode("append").parquet(f"{base}/in")
        start = end
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        versions.judge_stream(stream, ["scope", "event_id", "at", "value", "event_type"], ["scope", "version", "begins", "least", "banned"], verdict, base).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "version", "arrival", "verdict")
