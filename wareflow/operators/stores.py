"""Tables with keys: enrichment by lookup, stores with capacity and age, price history, journals and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, half_up_int
from .time_buckets import DAY, fullest, last_before, time_number


def enrich(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Left lookup by asin: fills only what is missing (the brand only where it is not certain); review_quality is always replaced if known.

    cache: asin, brand, country_of_origin, review_quality, with one row per asin.
    """
    c = cache.select(F.col("asin").alias("k"), F.col("brand").alias("c_brand"), F.col("country_of_origin").alias("c_country"), F.col("review_quality").alias("c_quality"))
    j = listings.join(c, F.col("asin") == F.col("k"), "left")
    return j.withColumns(
        {
            "brand": F.when(F.col("brand_certain"), F.col("brand")).otherwise(F.coalesce("c_brand", "brand")),
            "country_of_origin": F.coalesce("country_of_origin", "c_country"),
            "review_quality": F.coalesce("c_quality", "review_quality"),
        }
    ).drop("k", "c_brand", "c_country", "c_quality")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def remove_keys(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def move_brand(to: DataFrame, other: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brands enter one list and leave the other."""
    return insert_absent(to, brands, "brand"), remove_keys(other, brands, "brand")


def newest(df: DataFrame, n: int, order: str, by: str | None = None) -> DataFrame:
    """The n newest rows (of each group): capacity by first in, first out. Without groups every task keeps its own n newest before they meet."""
    latest = F.col(order).desc()
    if by is None:
        return df.orderBy(latest).limit(n)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(latest))).where(F.col("rn") <= n).drop("rn")


def fresh(df: DataFrame, column: str, now: Column, hours: float) -> DataFrame:
    """Rows of a cache that have not expired."""
    return df.where(F.unix_micros(F.col(column)) > F.unix_micros(now) - int(hours * 3_600_000_000))


def last_write(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, ts).alias(value))


def price_alerts(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """asin, ts, price: prices at or below the target and below the price before. prices: asin, ts, price; targets: asin, target."""
    known = last_before(prices.select("asin", "ts", "price", time_number(prices, "ts").alias("t"), F.struct("price").alias("p")), "asin", "t", ["t"], "p", "before", inclusive=False)
    return known.select("asin", "ts", "price", F.col("before.price").alias("before")).join(targets, "asin").where((F.col("price") <= F.col("target")) & (F.col("price") < F.col("before"))).select("asin", "ts", "price")


def price_history(prices: DataFrame, keep: int = 30) -> DataFrame:
    """The last snapshots of each item, scaled between their least and largest: asin, ts, price, scaled."""
    last = prices.withColumn("rn", F.row_number().over(Window.partitionBy("asin").orderBy(F.col("ts").desc()))).where(F.col("rn") <= keep)
    own = Window.partitionBy("asin")
    low, span = F.min("price").over(own), F.max("price").over(own) - F.min("price").over(own)
    return last.withColumn("scaled", (F.col("price") - low) / F.when(span == 0, 1.0).otherwise(span)).drop("rn")


def price_progress(first: Column, last: Column, target: Column) -> Column:
    """Percent of the way from the first price to the target, at most 100."""
    whole = first - target
    return F.when(whole > 0, F.least(F.lit(100), half_up_int((first - last) / whole * 100))).otherwise(F.when(last <= target, 100).otherwise(0))


def price_as_of(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds to each event (asin, at) the last price at or before it: a union through buckets of time, no range join and no window over a whole item."""
    both = events.select("asin", "at", F.unix_micros("at").alias("t"), F.lit(None).cast("double").alias("p"), F.lit(1).alias("is_event")).unionByName(
        prices.select("asin", F.col("ts").alias("at"), F.unix_micros("ts").alias("t"), F.col("price").alias("p"), F.lit(0).alias("is_event"))
    )
    return last_before(both, "asin", "t", ["t", "is_event"], "p", "price").where("is_event = 1").select("asin", "at", "price")


def page_stats(df: DataFrame, result: str = "filter_result", reason: str = "reason") -> DataFrame:
    """total, visible (dimmed rows count) and hidden rows by reason."""
    hidden = F.col(result) == "hide"
    return df.agg(F.count("*").alias("total"), F.count_if(~hidden).alias("visible"), *(F.count_if(hidden & (F.col(reason) == r)).alias(f"hidden_{r}") for r in ("sponsored", "reviews", "rating", "price", "other")))


def monthly_counters(events: DataFrame, keep: int = 12) -> DataFrame:
    """month, counter, amount for the last months, and a row of month 'all' with the totals."""
    by = events.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "counter").agg(F.sum("amount").alias("amount"))
    months = by.select("month").distinct().orderBy(F.col("month").desc()).limit(keep)
    return by.join(months, "month", "left_semi").unionByName(by.groupBy("counter").agg(F.sum("amount").alias("amount")).withColumn("month", F.lit("all")))


def usage(events: DataFrame) -> DataFrame:
    """user_id, uses, breadth (distinct features), retention_days, busiest_week (most uses within seven days)."""
    busiest = fullest(events.select("user_id", F.unix_micros("ts").alias("t")), "user_id", "t", 7 * DAY, "busiest_week").withColumnRenamed("user_id", "k")
    used = events.groupBy("user_id").agg(
        F.count("*").alias("uses"), F.count_distinct("feature").alias("breadth"), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / DAY).cast("long").alias("retention_days"),
    )
    return used.join(busiest, F.col("user_id").eqNullSafe(F.col("k")), "left").drop("k")


def purchase_stats(purchases: DataFrame) -> DataFrame:
    """One row: count, spend, mean trust of purchases liked (4 up) and regretted (2 down), suggested least trust."""
    liked, sad = F.col("satisfaction") >= 4, F.col("satisfaction") <= 2
    out = purchases.agg(F.count("*").alias("n"), half_up(F.sum("price"), 2).alias("spent"), half_up(F.avg(F.when(liked, F.col("trust_score"))), 1).alias("liked_trust"), F.avg(F.when(sad, F.col("trust_score"))).alias("r"))
    return out.select("n", "spent", "liked_trust", half_up(F.col("r"), 1).alias("regretted_trust"), F.least(F.lit(70.0), half_up(F.col("r") + 10, 0)).alias("suggested_min"))


def unrated(purchases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return purchases.where(~F.coalesce("prompted", F.lit(False)) & F.col("satisfaction").isNull() & (F.datediff(now, "purchased_at") > days))


def budgets(recipients: DataFrame, items: DataFrame) -> DataFrame:
    """recipient, budget, spent, remaining, over: items by the recipient's list; items without a price cost nothing."""
    sums = items.groupBy("list_name").agg(F.sum("price").alias("s"))
    j = recipients.join(sums, recipients.shortlist == sums.list_name, "left").withColumn("spent", half_up(F.coalesce("s", F.lit(0.0)), 2))
    return j.select("recipient", "budget", "spent", half_up(F.col("budget") - F.col("spent"), 2).alias("remaining"), (F.col("spent") > F.col("budget")).alias("over"))


def compare(items: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """asin, metric, value, is_best, is_worst; metrics: name -> whether higher is better. No marks if fewer than two values or all equal."""
    values = {m: F.col(m).cast("double") for m in metrics}
    spans = items.agg(*(F.struct(F.max(v).alias("high"), F.min(v).alias("low"), F.count(v).alias("n")).alias(m) for m, v in values.items()))
    spans = spans.select(F.inline(F.array(*(F.struct(F.lit(m).alias("of"), *(F.col(m)[k].alias(k) for k in ("high", "low", "n"))) for m in metrics))))
    each = (F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(metrics[m]).alias("up")) for m, v in values.items())
    long = items.select("asin", F.explode(F.array(*each)).alias("x")).select("asin", "x.*")
    marked = (F.col("n") >= 2) & (F.col("high") != F.col("low"))
    best, worst = F.when(F.col("up"), F.col("high")).otherwise(F.col("low")), F.when(F.col("up"), F.col("low")).otherwise(F.col("high"))
    is_best, is_worst = (F.coalesce(marked & (F.col("value") == end), F.lit(False)) for end in (best, worst))
    return long.join(spans, F.col("metric") == F.col("of")).select("asin", "metric", "value", is_best.alias("is_best"), is_worst.alias("is_worst"))


def cheapest_locale(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """asin, locale, usd, savings against the home price. prices: asin, locale, local_price, home_price; rates: locale, rate."""
    usd = prices.join(rates, "locale").withColumn("usd", half_up(F.col("local_price") * F.col("rate"), 2))
    best = usd.groupBy("asin").agg(F.min(F.struct("usd", "locale", "home_price")).alias("b"))
    return best.select("asin", "b.locale", "b.usd", F.greatest(F.lit(0.0), half_up(F.col("b.home_price") - F.col("b.usd"), 2)).alias("savings"))


def learn_brands(learned: DataFrame, candidates: DataFrame) -> DataFrame:
    """Learned words and the candidate words that turned out to be their listing's confirmed brand."""
    new = candidates.where(F.lower("word") == F.lower("brand")).select(F.lower("word").alias("word"))
    return learned.unionByName(new).distinct()
