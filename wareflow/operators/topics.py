"""Sentence-level topics: tagging, weighted ratings, trends and summaries.

A review's sentences each weigh 1/n. Tagging is substring matching by a dictionary, in dictionary order; a sentence without a tag
is about the fallback topic. Dictionaries are parameters: topic id -> keywords.

Two forms: tagged_sentences has a row per sentence, by Spark's expressions; review_topics has a row per review, by an Arrow function that looks
at each distinct text of a task once, since two hundred keywords in every sentence cost more than all else. Both read sentences and keywords alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, half_up_int
from ..functions.text import sentences

#: Topics and their keywords.
TOPICS = {
    "product-quality": ("quality", "well made", "poorly made", "build quality", "craftsmanship", "construction", "material", "materials", "flimsy", "sturdy", "solid", "cheap feel", "premium", "well-built", "defective", "broken", "stopped working", "doesn't work", "malfunction", "faulty"),
    "performance": ("performance", "fast", "slow", "powerful", "weak", "efficient", "battery life", "battery", "speed", "responsive", "laggy", "lag", "latency", "output", "loud", "quiet", "noise", "sound quality", "picture quality", "resolution", "brightness"),
    "durability": ("durable", "durability", "lasted", "broke after", "fell apart", "wear", "worn", "rust", "rusted", "longevity", "long lasting", "months later", "year later", "still works", "stopped working after"),
    "ease-of-use": ("easy to use", "user friendly", "intuitive", "complicated", "confusing", "learning curve", "setup", "set up", "install", "installation", "instructions", "manual", "plug and play", "out of the box", "difficult to", "hard to"),
    "value": ("value", "worth", "overpriced", "expensive", "cheap", "affordable", "bang for the buck", "price", "cost", "deal", "bargain", "rip off", "ripoff", "waste of money", "great deal", "good price"),
    "size-fit": ("size", "sizing", "too big", "too small", "too large", "too tight", "too loose", "fits perfectly", "doesn't fit", "fit well", "runs small", "runs large", "dimensions", "compact", "bulky", "heavy", "lightweight", "weight"),
    "appearance": ("looks", "look", "design", "color", "colour", "style", "aesthetic", "beautiful", "ugly", "attractive", "sleek", "modern", "appearance", "finish", "glossy", "matte"),
    "compatibility": ("compatible", "compatibility", "works with", "doesn't work with", "fits", "adapter", "connector", "port", "bluetooth", "wifi", "pairing", "connect", "connection"),
    "shipping-delivery": ("shipping", "delivery", "arrived", "late", "delayed", "package", "packaging", "box", "damaged in transit", "shipping time", "fast shipping", "slow shipping", "days to arrive", "arrived quickly", "arrived late", "fedex", "ups", "usps", "carrier"),
    "customer-service": ("customer service", "support", "return", "returned", "refund", "replacement", "warranty", "exchange", "response", "seller", "vendor", "contact", "help desk"),
    "user-error": ("didn't read", "my fault", "my mistake", "expected", "thought it was", "didn't realize", "i assumed", "not what i thought", "different than expected", "not what i expected", "misunderstood", "wrong product", "ordered wrong"),
    "packaging": ("packaging", "packaged", "box", "arrived damaged", "dented", "scratched", "opened", "used condition", "not new", "repackaged", "missing parts", "missing pieces", "incomplete"),
}
FALLBACK = "product-quality"
#: How a text states the rating it would have given.
IMPLIED = (
    r"(?i)would (?:have )?(?:given|said|rated|been)\s+(\d)\s*(?:stars?)?[\s,]*(?:except|but|if not for|were it not for|minus|other than)",
    r"(?i)(?:this is|it's|it is)\s+(?:a\s+)?(\d)\s*(?:star|/5)[\s,]*(?:product|item)?[\s,]*(?:except|but|if not for|other than)",
    r"(?i)i'?d\s+(?:give|rate)\s+(?:it\s+)?(\d)\s*(?:stars?)?[\s,]*(?:but|except|if not for)",
    r"(?i)(?:would be|could be|should be)\s+(\d)\s*(?:stars?)?[\s,]*(?:but|except|if not for)",
)


def implied_rating(text: Column) -> Column:
    found = [F.regexp_extract(text, p, 1).try_cast("int") for p in IMPLIED]
    return F.coalesce(*(F.when(v.between(1, 5), v) for v in found))


def tags(sentence: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """Ids of the topics whose keywords a sentence contains, in dictionary order."""
    marks = [F.when(sentence.rlike("(?i)" + "|".join(re.escape(k) for k in words)), F.lit(name)) for name, words in topics.items()]
    return F.array_compact(F.array(*marks))


def tagged_sentences(reviews: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS, fallback: str = FALLBACK) -> DataFrame:
    """A row per sentence: asin, review_idx, rating, ts (if any), place, sentence, weight, topics."""
    keep = [c for c in ("asin", "review_idx", "rating", "ts") if c in reviews.columns]
    cut = reviews.select(*keep, implied_rating(F.coalesce("text", F.lit(""))).alias("implied"), sentences(F.col("text")).alias("all"))
    rows = cut.select(*keep, "implied", (1.0 / F.size("all")).alias("weight"), F.posexplode("all").alias("place", "sentence"))
    found = rows.withColumn("topics", tags(F.col("sentence"), topics))
    return found.withColumn("topics", F.when(F.size("topics") == 0, F.array(F.lit(fallback))).otherwise(F.col("topics")))


def primary_topics(tagged: DataFrame) -> DataFrame:
    """asin, review_idx, primary: the topic of most sentences of a review, the first seen on ties."""
    each = tagged.select("asin", "review_idx", "place", F.posexplode("topics").alias("k", "topic"))
    counts = each.groupBy("asin", "review_idx", "topic").agg(F.count("*").alias("n"), F.min(F.struct("place", "k")).alias("at"))
    best = F.min_by(F.col("topic"), F.struct((-F.col("n")).alias("n"), F.col("at")))
    return counts.groupBy("asin", "review_idx").agg(best.alias("primary"))


def topic_counts(tagged: DataFrame) -> DataFrame:
    """asin, topic, reviews (that have it), share (% of the item's reviews), avg_rating, snippet (first sentence, 80 characters)."""
    each = tagged.select("asin", "review_idx", "rating", "place", "sentence", F.explode("topics").alias("topic"))
    per = each.groupBy("asin", "topic", "review_idx").agg(F.first("rating").alias("rating"), F.min_by("sentence", "place").alias("sentence"))
    every = tagged.groupBy("asin").agg(F.count_distinct("review_idx").alias("all"))
    out = per.groupBy("asin", "topic").agg(F.count("*").alias("reviews"), half_up(F.avg("rating"), 1).alias("avg_rating"), F.min_by("sentence", "review_idx").alias("s"))
    return out.join(every, "asin").select("asin", "topic", "reviews", half_up_int(F.col("reviews") * 100.0 / F.col("all")).alias("share"), "avg_rating", F.substring("s", 1, 80).alias("snippet"))


def _sentiment() -> Column:
    return F.when(F.col("avg_rating") >= 4.0, "positive").when(F.col("avg_rating") >= 3.0, "mixed").otherwise("negative")


def topic_scores(tagged: DataFrame) -> DataFrame:
    """asin, topic, avg_rating (weighted by sentences), review_mentions, sentence_mentions, sentiment."""
    each = tagged.select("asin", "review_idx", "rating", "weight", F.explode("topics").alias("topic"))
    n = each.groupBy("asin", "topic").agg(
        half_up(F.sum(F.col("weight") * F.col("rating")) / F.sum("weight"), 1).alias("avg_rating"), F.count_distinct("review_idx").alias("review_mentions"),
        F.count("*").alias("sentence_mentions"),
    )
    return n.withColumn("sentiment", _sentiment())


def adjusted_ratings(tagged: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """asin, adjusted_rating, used: the mean over sentences without an ignored topic; where some of a review's were dropped, the rating it
    states it would have given stands for its own."""
    drop = F.arrays_overlap("topics", F.array(*(F.lit(t) for t in ignored))) if ignored else F.lit(False)
    per = tagged.withColumn("drop", drop).groupBy("asin", "review_idx").agg(
        F.first("rating").alias("rating"), F.first("implied").alias("implied"), F.bool_or("drop").alias("some"), F.sum(F.when(~F.col("drop"), F.col("weight"))).alias("w")
    )
    value = F.when(F.col("some"), F.coalesce(F.col("implied").cast("double"), "rating")).otherwise(F.col("rating"))
    kept = per.where("w > 0")
    return kept.groupBy("asin").agg(half_up(F.sum(value * F.col("w")) / F.sum("w"), 2).alias("adjusted_rating"), F.count("*").alias("used"))


#: Distinct texts that a task remembers.
REMEMBERED = 1 << 17


def topic_marks(text: Column, ignored: tuple[str, ...] = (), topics: dict[str, tuple[str, ...]] = TOPICS, fallback: str = FALLBACK) -> Column:
    """struct<implied, sentences, kept (sentences without an ignored topic), found (topic, its sentences n; most sentences first, then first seen)>."""
    import pyarrow as pa

    rules, keys, most, skip = IMPLIED, {name: [w.encode().lower() for w in words] for name, words in topics.items()}, REMEMBERED, set(ignored)
    shape = pa.struct([("implied", pa.int32()), ("sentences", pa.int32()), ("kept", pa.int32()), ("found", pa.list_(pa.struct([("topic", pa.string()), ("n", pa.int32())])))])
    have, memo = {}, []

    def one(text, patterns, tagged):
        dots, digits, ends, cut, *stated = patterns
        guarded = ends.sub("\2", digits.sub("\\1\1\\2", dots.sub("\\1\1", text)))
        said = [t for t in (p.replace("\1", ".").replace("\2", "...").strip(" ") for p in cut.split(guarded)) if t]
        values = (int(m[1]) for m in (p.search(text) for p in stated) if m)
        counts, kept = {}, 0
        for sentence in said:
            names = tagged(sentence)
            kept += skip.isdisjoint(names)
            for name in names:
                counts[name] = counts.get(name, 0) + 1
        found = sorted(counts.items(), key=lambda x: -x[1])  # stable: the first seen first
        return {"implied": next((v for v in values if 1 <= v <= 5), None), "sentences": len(said), "kept": kept, "found": [{"topic": k, "n": n} for k, n in found]}

    def read(texts):
        import functools

        if not memo:
            cuts = (r"(?i)(?<![0-9A-Za-z_])(mr|mrs|ms|dr|prof|sr|jr|vs|etc|e\.g|i\.e|inc|ltd|co|approx)\.", r"([0-9])\.([0-9])", r"\.{2,}", r"(?<=[.!?])\s+")
            patterns = [re.compile(p, re.ASCII) for p in (*cuts, *rules)]

            @functools.lru_cache(most)
            def tagged(sentence):
                low = sentence.encode().lower()
                return tuple(name for name, words in keys.items() if any(w in low for w in words)) or (fallback,)

            memo[:] = [pa.array([], shape), patterns, tagged]
        if len(have) > most:
            have.clear()
            memo[0] = pa.array([], shape)
        coded = texts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [t for t in distinct if t not in have]
        if new:
            memo[0] = pa.concat_arrays([memo[0], pa.array([one(t, *memo[1:]) for t in new], shape)])
            have.update(zip(new, range(len(have), len(have) + len(new)), strict=True))
        return memo[0].take(pa.array([have[t] for t in distinct], pa.int32()).take(coded.indices))

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "implied int, sentences int, kept int, found array<struct<topic: string, n: int>>")(F.coalesce(text, F.lit("")))


def review_topics(reviews: DataFrame, ignored: tuple[str, ...] = (), topics: dict[str, tuple[str, ...]] = TOPICS, fallback: str = FALLBACK) -> DataFrame:
    """A row per review that has a sentence: asin, review_idx, rating, ts (if any) and topic_marks."""
    keep = [c for c in ("asin", "review_idx", "rating", "ts") if c in reviews.columns]
    return reviews.select(*keep, topic_marks(F.col("text"), ignored, topics, fallback).alias("m")).where("m.sentences > 0").select(*keep, "m.*")


def _each_topic(marked: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, rating, topic, n, weight (the review's share that is about the topic)."""
    rows = marked.select(*columns, "rating", "sentences", F.explode("found").alias("f"))
    return rows.select("*", "f.topic", "f.n", (F.col("f.n") / F.col("sentences")).alias("weight"))


def topic_scores_of_reviews(marked: DataFrame) -> DataFrame:
    """As topic_scores, of review_topics."""
    n = _each_topic(marked, "asin").groupBy("asin", "topic").agg(
        half_up(F.sum(F.col("weight") * F.col("rating")) / F.sum("weight"), 1).alias("avg_rating"), F.count("*").alias("review_mentions"), F.sum("n").alias("sentence_mentions")
    )
    return n.withColumn("sentiment", _sentiment())


def adjusted_ratings_of_reviews(marked: DataFrame) -> DataFrame:
    """As adjusted_ratings, of review_topics with the ignored topics."""
    w = F.col("kept") / F.col("sentences")
    value = F.when(F.col("kept") < F.col("sentences"), F.coalesce(F.col("implied").cast("double"), "rating")).otherwise(F.col("rating"))
    rows = marked.where("kept > 0").select("asin", w.alias("w"), (value * w).alias("v"))
    return rows.groupBy("asin").agg(half_up(F.sum("v") / F.sum("w"), 2).alias("adjusted_rating"), F.count("*").alias("used"))


def quarter_scores_of_reviews(marked: DataFrame) -> DataFrame:
    """As quarter_scores, of review_topics."""
    each = _each_topic(marked, "asin", F.date_trunc("quarter", "ts").alias("quarter"))
    return each.groupBy("asin", "quarter", "topic").agg((F.sum(F.col("weight") * F.col("rating")) / F.sum("weight")).alias("score"))


def recent_quarters(reviews: DataFrame, most: int = 2) -> DataFrame:
    """Reviews with a sentence in their item's last quarters that have such reviews: all that trends() looks at."""
    said = reviews.where(F.trim("text") != "").withColumn("quarter", F.date_trunc("quarter", "ts"))
    return said.withColumn("k", F.dense_rank().over(Window.partitionBy("asin").orderBy(F.col("quarter").desc()))).where(F.col("k") <= most).drop("k", "quarter")


def quarter_scores(tagged: DataFrame) -> DataFrame:
    """asin, quarter, topic, score: weighted means in calendar quarters that have reviews."""
    each = tagged.select("asin", F.date_trunc("quarter", "ts").alias("quarter"), "rating", "weight", F.explode("topics").alias("topic"))
    return each.groupBy("asin", "quarter", "topic").agg((F.sum(F.col("weight") * F.col("rating")) / F.sum("weight")).alias("score"))


def trends(scores: DataFrame, step: float = 0.5) -> DataFrame:
    """asin, topic, trend: the item's last quarter against the one before that has reviews; null if either lacks the topic."""
    ranked = scores.withColumn("k", F.dense_rank().over(Window.partitionBy("asin").orderBy(F.col("quarter").desc()))).where("k <= 2")
    both = ranked.groupBy("asin", "topic").agg(F.max(F.when(F.col("k") == 1, F.col("score"))).alias("now"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("before"))
    d = F.col("now") - F.col("before")
    return both.select("asin", "topic", F.when(d > step, "rising").when(d < -step, "falling").when(d.isNotNull(), "stable").alias("trend"))


def weighted_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds weight (1.0 for topics without one) and weighted_rating. weights: topic, weight."""
    joined = scores.join(weights, "topic", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return joined.withColumn("weighted_rating", half_up(F.col("avg_rating") * F.col("weight"), 1))


def weighted_aggregate(scores: DataFrame) -> DataFrame:
    """asin, weighted_score: the mean of topics by weight and mentions; 0 when there are none."""
    w = F.col("weight") * F.col("review_mentions")
    return scores.groupBy("asin").agg(F.coalesce(half_up(F.try_divide(F.sum(F.col("avg_rating") * w), F.sum(w)), 1), F.lit(0.0)).alias("weighted_score"))


def summary(scores: DataFrame, cut: float = 3.5, pros: int = 3, cons: int = 2) -> DataFrame:
    """asin, pros, cons, one_liner: topics by weight and mentions, then rating."""
    w = (F.col("weight") if "weight" in scores.columns else F.lit(1.0)) * F.col("review_mentions")
    good = F.col("avg_rating") >= cut
    by = F.when(good, -F.col("avg_rating")).otherwise(F.col("avg_rating"))
    order = Window.partitionBy("asin", "good").orderBy(w.desc(), by, "topic")
    ranked = scores.withColumn("good", good).withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.when(F.col("good"), pros).otherwise(cons))

    def names(which: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("k", "topic")))), lambda x: x["topic"])

    out = ranked.groupBy("asin").agg(names(F.col("good")).alias("pros"), names(~F.col("good")).alias("cons"))
    liked = F.when(F.size("pros") > 0, F.concat(F.lit("Praised for "), F.array_join("pros", ", ")))
    blamed = F.when(F.size("cons") > 0, F.concat(F.lit("Criticised for "), F.array_join("cons", ", ")))
    return out.withColumn("one_liner", F.concat_ws(". ", liked, blamed))


def keyword_summary(reviews: DataFrame, aspects: dict[str, tuple[str, ...]], least_reviews: int = 2, least_chars: int = 10) -> DataFrame:
    """asin, topic, review_mentions, avg_rating by keywords of whole reviews; the fall-back where there are no sentences."""
    rows = reviews.where(F.length("text") >= least_chars).select("asin", "review_idx", "rating", F.explode(tags(F.col("text"), aspects)).alias("topic"))
    return rows.groupBy("asin", "topic").agg(F.count("*").alias("review_mentions"), half_up(F.avg("rating"), 1).alias("avg_rating")).where(F.col("review_mentions") >= least_reviews)


def best_quotes(tagged: DataFrame, label_words: dict[str, str]) -> DataFrame:
    """asin, topic, quote: the first sentence of 20 to 150 characters that holds a topic's label word."""
    table = F.create_map(*(F.lit(x) for pair in label_words.items() for x in pair))
    each = tagged.select("asin", "review_idx", "place", "sentence", F.explode("topics").alias("topic"))
    fit = each.where(F.length("sentence").between(20, 150) & F.contains(F.lower("sentence"), F.element_at(table, F.col("topic"))))
    return fit.groupBy("asin", "topic").agg(F.min_by("sentence", F.struct("review_idx", "place")).alias("quote"))
