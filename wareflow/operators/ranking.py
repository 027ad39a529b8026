"""Orders, value scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_score() -> Column:
    """rating * log10(reviews + 1) / price; 0 without a positive price."""
    return F.when(F.col("price") > 0, F.col("rating") * F.log10(F.col("review_count") + 1) / F.col("price")).otherwise(0.0)


def trend_score() -> Column:
    return F.sqrt(F.col("review_count").cast("double")) * F.col("rating") * F.col("rating")


def order_by(criteria: str) -> list[Column]:
    """Sort keys of a criterion; pos makes every order stable. Null prices are last in both price orders."""
    keys = {
        "default": [], "reviews": [F.col("review_count").desc()], "rating": [F.col("rating").desc()], "value": [value_score().desc()], "trending": [trend_score().desc()],
        "deal-score": [F.coalesce("deal_score", F.lit(0)).desc()], "price-low": [F.col("price").asc_nulls_last()], "price-high": [F.col("price").desc_nulls_last()],
    }
    if criteria not in keys:
        raise ValueError(f"unknown order {criteria!r}")
    return [*keys[criteria], F.col("pos").asc()]


def sort_listings(df: DataFrame, criteria: str) -> DataFrame:
    return df.orderBy(*order_by(criteria))


def top_k(df: DataFrame, by: list[str], keys: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank; the limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("rank") <= k)


def top_pick(df: DataFrame, least_scored: int = 3, least_trust: int = 70) -> DataFrame:
    """pos of the listing with the most trust for its price, if enough listings are scored; one row at most."""
    scored = df.where("trust_score IS NOT NULL")
    found = scored.agg(F.count("*").alias("n"), F.max_by(F.col("pos"), F.when((F.col("trust_score") >= least_trust) & (F.col("price") > 0), F.struct(F.col("trust_score") / F.col("price"), -F.col("pos")))).alias("pos"))
    return found.where((F.col("n") >= least_scored) & F.col("pos").isNotNull()).select("pos")


def alternatives(df: DataFrame, trust: DataFrame, quality: DataFrame, low: int = 60) -> DataFrame:
    """pos, score, role: scores by trust, else by review quality (both: asin, score); the top pick, and rows of low score that point to it.

    The pick is one row, joined by a constant key.
    """
    t, q = trust.select(F.col("asin").alias("ta"), F.col("score").alias("ts")), quality.select(F.col("asin").alias("qa"), F.col("score").alias("qs"))
    scored = df.join(t, F.col("asin") == F.col("ta"), "left").join(q, F.col("asin") == F.col("qa"), "left").withColumn("trust_score", F.coalesce("ts", "qs")).where("trust_score IS NOT NULL AND price > 0")
    pick = top_pick(scored).select(F.col("pos").alias("pick"), F.lit(1).alias("one"))
    marked = scored.withColumn("one", F.lit(1)).join(pick, "one", "left")
    role = F.when(F.col("pos") == F.col("pick"), "top-pick").when(F.col("pick").isNotNull() & (F.col("trust_score") < low), "see-alternative").otherwise("plain")
    return marked.select("pos", F.col("trust_score").alias("score"), role.alias("role"))
