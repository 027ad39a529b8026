"""Incremental forms of the operators on Structured Streaming; each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HISTORY, MOST_FAILURES, SILENT_DAYS = 30, 5, 90


def unseen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it. Rows without a key pass through a branch of their own."""
    timed = stream.withWatermark(time, delay)
    return timed.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key]).unionByName(timed.where(F.col(key).isNull()))


def filtered(stream: DataFrame, verdict: Callable[[], Column], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is judged by the parameters of that moment; one writer at a time."""
    def each(batch: DataFrame, number: int) -> None:
        sink(batch.withColumn("filter_result", verdict()), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(stream: DataFrame, time: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Event counts and sums by tumbling window and type."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(stream: DataFrame, time: str, key: str, length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, length, slide), key).agg(F.count("*").alias("n"))


def late(details: DataFrame, rows: DataFrame, key: str, verdict: Callable[[], Column]) -> DataFrame:
    """Rows judged again when their details arrive: a stream of details against the table of rows, with the verdict on both."""
    return details.join(rows, key).withColumn("filter_result", verdict())


def watch_prices(stream: DataFrame) -> DataFrame:
    """asin, ts, price, alert, history, failures for each check of a stream (asin, ts, price, target).

    An alert if the price is at or below the target and below the last known one; history holds up to 30 prices, this one last. A null price
    is a failed check, given with the count of failures in a row; after five of them the item's checks are skipped, until a row
    with a price comes. Rows of a key are taken in the order of time; state per item is bounded, and goes when an
    item is silent for 90 days; checks older than that, and those without a time, are not taken.
    """

    def update(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, history, failures = state.get if state.exists else (None, [], 0)
        history, out = list(history), []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, price, target in zip(rows.ts, rows.price, rows.target, strict=True):
            if pd.isna(price):
                if failures < MOST_FAILURES:
                    failures += 1
                    out.append((key[0], ts, None, False, history, failures))
                continue
            alert, failures = last is not None and price <= target and price < last, 0
            last, history = float(price), [*history, float(price)][-HISTORY:]
            out.append((key[0], ts, last, bool(alert), history, failures))
        state.update((last, history, failures))
        state.setTimeoutTimestamp(int(rows.ts.max().timestamp() * 1000) + SILENT_DAYS * 86_400_000)
        yield pd.DataFrame(out, columns=["asin", "ts", "price", "alert", "history", "failures"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    shape = "asin string, ts timestamp, price double, alert boolean, history array<double>, failures int"
    return stream.withWatermark("ts", f"{SILENT_DAYS} days").groupBy("asin").applyInPandasWithState(update, shape, "last double, history array<double>, failures int", "append", GroupStateTimeout.EventTimeTimeout)
