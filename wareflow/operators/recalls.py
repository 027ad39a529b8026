"""Weighted fuzzy matching of listings with recalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import match_tokens

#: Words that say nothing about a product, and words that say half as much.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "for", "with", "in", "on", "of", "to", "is", "are", "was", "by", "at", "from", "as", "into", "this", "that", "it", "its", "new", "best", "top",
    "set", "pack", "pcs", "pcs.", "amazon", "com", "www",
)
GENERIC = (
    "baby", "children", "kids", "adult", "portable", "electric", "wireless", "mini", "small", "large", "big", "inch", "pack", "black", "white", "blue", "red", "pink", "green", "gray", "grey",
)


def weight(word: Column) -> Column:
    return F.when(word.isin(*GENERIC), 0.5).otherwise(1.0)


def overlap(have: Column, target: Column) -> Column:
    """struct<score, strong>: weight of the target's words that are in `have` over all weight; strong counts the full ones."""
    w = F.aggregate(
        target,
        F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("all"), F.lit(0).alias("strong")),
        lambda a, t: F.struct(
            (a["hit"] + F.when(F.array_contains(have, t), weight(t)).otherwise(0.0)).alias("hit"),
            (a["all"] + weight(t)).alias("all"),
            (a["strong"] + F.when(F.array_contains(have, t) & ~t.isin(*GENERIC), 1).otherwise(0)).alias("strong"),
        ),
    )
    return F.transform(F.array(w), lambda x: F.struct(F.when(x["all"] > 0, x["hit"] / x["all"]).otherwise(0.0).alias("score"), x["strong"].alias("strong")))[0]


def least_overlap(least: float) -> float:
    """The overlap that the best score needs without a brand hit, if confidence (two digits, 0.1 more from 0.3 on for the place of sale) is to reach `least`."""
    return min(least, max(0.3, least - 0.1)) - 0.005 - 1e-9


def rare_words(targets: DataFrame, words: DataFrame) -> DataFrame:
    """recall_id, w: words of each target, rarest first, until the others together weigh too little for its overlap.

    targets: recall_id, target (array of words), share (the overlap needed); words: w, n (listings that hold it). A listing that reaches
    the share holds one of these words at least, however common the target's other words are.
    """
    one = targets.distinct().select("*", F.explode("target").alias("w")).join(words, "w", "left")
    whole = Window.partitionBy("recall_id", "target", "share")
    order = whole.orderBy(F.coalesce("n", F.lit(0)), "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = weight(F.col("w"))
    ahead = one.select("recall_id", "w", "share", "n", (F.sum(wt).over(order) - wt).alias("ahead"), F.sum(wt).over(whole).alias("all"))
    return ahead.where("n IS NOT NULL AND ahead <= (1 - share) * all + 1e-9").select("recall_id", "w")


def meetings(own: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """pos, recall_id of all pairs that can reach `least`: by a rare word of the title, or by a brand word in a product's name.

    own: pos, words, brand; theirs: recall_id, names, title, text (arrays of words).
    """
    titled = own.select("pos", F.explode("words").alias("w"))
    words = titled.groupBy("w").agg(F.count("*").alias("n"))
    need = least_overlap(least)
    names = theirs.select("recall_id", F.explode("names").alias("target"), F.lit(need).alias("share"))
    titles = theirs.select("recall_id", F.col("title").alias("target"), F.lit(need).alias("share"))
    texts = theirs.select("recall_id", F.col("text").alias("target"), F.lit(2 * need).alias("share"))
    rare = rare_words(names.unionByName(titles).unionByName(texts), words).distinct()
    by_title = titled.join(rare, "w").select("pos", "recall_id")
    named = theirs.select("recall_id", F.explode(F.array_distinct(F.flatten("names"))).alias("w"))
    by_brand = own.select("pos", F.explode("brand").alias("w")).join(named, "w").select("pos", "recall_id")
    return by_title.unionByName(by_brand).distinct()


def match_recalls(listings: DataFrame, recalls: DataFrame, least: float = 0.45, sold_on: str = "retailer") -> DataFrame:
    """pos, recall_id, confidence, matched_on of likely matches.

    Listings meet recalls by equi-joins on words that a match cannot do without, not by all pairs and not on words that everything
    shares. The fold over a recall's products is ordered: a brand hit adds to the best score so far.
    """
    if least <= 0:
        raise ValueError("least must be positive: every pair would match")
    own, theirs = _own_words(listings), _recall_words(recalls, sold_on)
    return _score(meetings(own, theirs, least).join(own, "pos").join(theirs, "recall_id"), least)


def _own_words(listings: DataFrame) -> DataFrame:
    return listings.select("pos", F.array_distinct(match_tokens(F.col("title"), STOP_WORDS)).alias("words"), F.array_distinct(match_tokens(F.col("brand"), STOP_WORDS)).alias("brand"))


def _recall_words(recalls: DataFrame, sold_on: str) -> DataFrame:
    t = lambda c: match_tokens(c, STOP_WORDS)
    return recalls.select(
        F.col("RecallID").alias("recall_id"), F.transform("Products", lambda p: t(p["Name"])).alias("names"), t(F.col("Title")).alias("title"), t(F.col("Description")).alias("text"),
        F.exists("Retailers", lambda r: F.contains(F.lower(r["Name"]), F.lit(sold_on))).alias("sold"),
    )


def _score(both: DataFrame, least: float) -> DataFrame:
    """pos, recall_id, confidence, matched_on of pairs with all their words, if confident enough."""
    fold = F.aggregate(
        "names",
        F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("brand"), F.lit(False).alias("name")),
        lambda a, n: F.transform(
            F.array(F.struct(overlap(F.col("words"), n).alias("o"), F.arrays_overlap(F.col("brand"), n).alias("hit"))),
            lambda x: F.struct(
                F.when(x["hit"], F.least(F.lit(1.0), F.greatest(a["score"], x["o"]["score"]) + 0.25)).otherwise(F.greatest(a["score"], x["o"]["score"])).alias("score"),
                (a["brand"] | x["hit"]).alias("brand"),
                (a["name"] | (x["o"]["strong"] >= 2)).alias("name"),
            ),
        )[0],
    )
    leading = F.filter(F.flatten(F.transform("names", lambda n: F.slice(n, 1, 2))), lambda w: ~w.isin(*GENERIC))
    scored = both.select("pos", "recall_id", "brand", "sold", fold.alias("p"), overlap(F.col("words"), F.col("title")).alias("t"), overlap(F.col("words"), F.col("text")).alias("d"), leading.alias("leading"))
    best = F.greatest("p.score", "t.score", F.col("d.score") * 0.5)
    stranger = (F.size("brand") > 0) & (F.size("leading") > 0) & ~F.col("p.brand") & ~F.arrays_overlap("brand", "leading")
    held = scored.withColumn("best", F.when(stranger, best * 0.4).otherwise(best)).withColumn("boost", F.col("sold") & (F.col("best") >= 0.3))
    confidence = half_up(F.when(F.col("boost"), F.least(F.lit(1.0), F.col("best") + 0.1)).otherwise(F.col("best")), 2)
    on = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in (("product-name", F.col("p.name")), ("brand", F.col("p.brand")), ("title", F.col("t.strong") >= 2), ("description", F.col("d.score") > 0.2), ("sold-on", F.col("boost"))))))
    return held.select("pos", "recall_id", confidence.alias("confidence"), on.alias("matched_on")).where(F.col("confidence") >= least)
