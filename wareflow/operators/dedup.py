"""Variant duplicates by normalized title, and fuzzy duplicates across listings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalize_title, title_tokens
from ..sources.storage import anew, materialize
from .graph import components


def variant_duplicates(df: DataFrame, categories: tuple[str, ...], visible: Column | None = None) -> DataFrame:
    """Adds dedup_key and is_duplicate: all but the best (most reviews, best rating, first) of each key, among visible rows.

    The best row per key is a map-side combined aggregate and a join back, so a key with very many rows is not sorted in one task.
    """
    seen = F.lit(True) if visible is None else visible
    keyed = df.withColumn("dedup_key", normalize_title(F.col("title"), categories))
    if not categories:
        return keyed.withColumn("is_duplicate", F.lit(False))
    rank = F.struct(F.col("review_count"), F.col("rating"), (-F.col("pos")).alias("p"))
    best = keyed.where(seen).groupBy("dedup_key").agg(F.max(rank).alias("best")).select(F.col("dedup_key").alias("k"), (-F.col("best.p")).alias("best_pos"))
    return keyed.join(best, F.col("dedup_key") == F.col("k"), "left").withColumn("is_duplicate", F.coalesce(seen & (F.col("pos") != F.col("best_pos")), F.lit(False))).drop("k", "best_pos")


def _classes(df: DataFrame, least_tokens: int) -> DataFrame:
    """pos, asin, class (least pos with the same block and title tokens), block, tokens: copies of a title are one class."""
    brand = F.when(F.coalesce("brand", F.lit("")) == "", F.lit("__unknown__")).otherwise(F.lower("brand"))
    sets = df.select("pos", "asin", brand.alias("block"), F.array_sort(title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") >= least_tokens)
    least = sets.groupBy("block", "tokens").agg(F.min("pos").alias("class"))
    named = least.select("class", F.col("block").alias("b"), F.col("tokens").alias("t"))
    return materialize(sets.join(named, (F.col("block") == F.col("b")) & (F.col("tokens") == F.col("t"))).drop("b", "t"), "title-classes")


def _close_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of different classes of one block, by prefix filtering: two sets that similar share one of their rarest tokens, so
    classes meet by an equi-join on (block, rare token) and not by all pairs of a brand; the length filter and the exact test follow."""
    classes = sets.where(F.col("pos") == F.col("class")).select("class", "block", "tokens")
    each = classes.select("class", "block", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rare = each.groupBy("block", "token").agg(F.count("*").alias("df")).where("df > 1").select(F.col("block").alias("k"), F.col("token").alias("w"), "df")
    order = Window.partitionBy("class").orderBy("df", "token")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("class"))  # tokens that no other class of the block has come first
    ranked = each.join(rare, (F.col("block") == F.col("k")) & (F.col("token") == F.col("w"))).withColumn("place", F.row_number().over(order) + alone)
    heads = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("class", "block", "token", "n")
    left, right = heads.select(F.col("class").alias("a"), "block", "token", F.col("n").alias("na")), heads.select(F.col("class").alias("b"), "block", "token", F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    pairs = left.join(right, ["block", "token"]).where(fits).select("a", "b").distinct()
    one, two = classes.select(F.col("class").alias("a"), F.col("tokens").alias("x")), classes.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    scored = pairs.join(one, "a").join(two, "b").withColumn("similarity", jaccard(F.col("x"), F.col("y")))
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _class_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity, pairs: classes (a = b: copies of one title) and the listing pairs they stand for, those of one id left out."""
    asins = sets.where("asin IS NOT NULL").groupBy("class", "asin").agg(F.count("*").alias("m"))
    size = sets.groupBy("class").agg(F.count("*").alias("n"))
    same = asins.groupBy("class").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("same"))
    inside = size.where("n > 1").join(same, "class", "left").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"), ((F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.coalesce("same", F.lit(0))).alias("pairs"))
    close = materialize(_close_classes(sets, threshold), "close-classes")
    x, y = asins.select(F.col("class").alias("a"), "asin", F.col("m").alias("ma")), asins.select(F.col("class").alias("b"), F.col("asin").alias("other"), F.col("m").alias("mb"))
    shared = close.join(x, "a").join(y, "b").where("asin = other").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("same"))
    sized = close.join(size.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b").join(shared, ["a", "b"], "left")
    across = sized.select("a", "b", "similarity", (F.col("na") * F.col("nb") - F.coalesce("same", F.lit(0))).alias("pairs"))
    return inside.unionByName(across).where("pairs > 0")


def similar_pairs(df: DataFrame, threshold: float = 0.55, least_tokens: int = 3) -> DataFrame:
    """a, b, similarity, pairs: title classes of one brand (empty brands form a block) whose tokens have at least the given Jaccard
    similarity, named by their least listing; `pairs` counts the pairs of listings with different ids. Copies never make n^2 rows."""
    return _class_pairs(_classes(df, least_tokens), threshold)


def duplicate_groups(df: DataFrame, threshold: float = 0.55, least_tokens: int = 3) -> DataFrame:
    """pos, group_id, is_best, group_size, group_similarity: components of similar listings; the best has most reviews, best rating, least
    price, first; the similarity is the mean over the pairs of listings that made the group."""
    sets = _classes(df, least_tokens)
    pairs = materialize(_class_pairs(sets, threshold), "similar-pairs")
    linked = components(pairs.where("a < b").select("a", "b"))
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct().join(linked, "node", "left_anti").select("node", F.col("node").alias("root"))
    roots = materialize(linked.unionByName(alone), "roots")
    weight = F.sum(F.col("similarity") * F.col("pairs")) / F.sum("pairs")
    of_pairs = pairs.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(weight.alias("group_similarity")).select(anew("root").alias("r"), "group_similarity")
    in_class = sets.select("pos", "class").join(roots, F.col("class") == F.col("node")).select(F.col("pos").alias("p"), "root")
    members = in_class.join(df.select("pos", "review_count", "rating", "price"), F.col("p") == F.col("pos")).drop("p")
    rank = F.struct("review_count", "rating", (-F.coalesce("price", F.lit(math.inf))).alias("p"), (-F.col("pos")).alias("q"))
    stats = members.groupBy("root").agg(F.count("*").alias("group_size"), F.max(rank).alias("best"), F.min("pos").alias("group_id")).select(anew("root").alias("s"), "group_size", "best", "group_id")
    out = members.join(stats, F.col("root") == F.col("s")).join(of_pairs, F.col("root") == F.col("r"))
    return out.select("pos", "group_id", (F.col("pos") == -F.col("best.q")).alias("is_best"), "group_size", "group_similarity")
