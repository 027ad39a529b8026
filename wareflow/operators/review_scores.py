"""Review authenticity and trust: histograms, texts, dates, and the ten trust signals with their score.

Everything is grouped by asin with map-side combined aggregates; time patterns go through buckets of time (time_buckets), so no task holds a whole asin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, half_up_int, label
from ..functions.text import long_words, plain_words
from ..sources.storage import discard, materialize
from .time_buckets import DAY, fullest, span_sums

#: Phrase lists and word lists of the text rules.
SUPERLATIVES = ("best", "amazing", "perfect", "awesome", "love", "excellent", "incredible", "wonderful", "fantastic", "great", "outstanding")
TEMPLATE_PHRASES = ("i received", "worth the money", "highly recommend", "5 stars", "bought this for", "works as expected", "does the job", "great product", "love this")
INCENTIVES = (
    "received this product free", "received free", "in exchange for", "honest review", "provided by the seller", "provided by the manufacturer", "complimentary", "sample product",
    "free sample", "promotional item", "discount in exchange", "received at a discount", "vine voice", "vine review",
)
GENERIC_PRAISE = (
    "great product", "love it", "love this", "highly recommend", "best ever", "works great", "works perfectly", "exactly what i needed", "exactly as described", "five stars", "5 stars",
    "amazing product", "perfect product", "would buy again", "must buy", "so happy", "very happy", "no complaints", "exceeded expectations", "a+++", "a++++",
)
NEGATIVE = ("terrible", "awful", "horrible", "worst", "broke", "broken", "defective", "waste", "useless", "garbage", "trash", "hate", "disappointing", "regret", "return", "refund")
POSITIVE = ("excellent", "amazing", "perfect", "love", "great", "fantastic", "wonderful", "outstanding", "superb", "impressed", "best")


def word_pattern(words: tuple[str, ...]) -> str:
    """Whole words in ASCII terms, any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases a text contains."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def histograms(reviews: DataFrame) -> DataFrame:
    """asin, five .. one, total, average."""
    stars = {"five": 5, "four": 4, "three": 3, "two": 2, "one": 1}
    return reviews.groupBy("asin").agg(*(F.count_if(F.col("rating") == v).alias(k) for k, v in stars.items()), F.count("*").alias("total"), F.avg("rating").alias("average"))


def entropy() -> Column:
    """Shannon entropy in bits of the five counts."""
    out = F.lit(0.0)
    for k in ("five", "four", "three", "two", "one"):
        p = F.try_divide(F.col(k).cast("double"), F.col("total").cast("double"))
        out = out - F.when(F.col(k) > 0, p * F.log2(p)).otherwise(0.0)
    return out


def _share(k: str) -> Column:
    return F.coalesce(F.try_divide(F.col(k) * 100.0, F.col("total").cast("double")), F.lit(0.0))


def histogram_deduction() -> Column:
    five, one = _share("five"), _share("one")
    polar = F.when((five + one > 80) & (_share("two") + _share("three") < 10), 25).otherwise(0)
    high = F.when((five > 90) & (F.col("total") > 50), 20).otherwise(0)
    flat = F.when(entropy() < 1.0, 15).otherwise(0)
    return F.when(F.col("total") == 0, 0).otherwise(F.least(F.lit(30), polar + high + flat))


def text_deduction() -> Column:
    """0 to 40 for one review: repetitive words, superlatives, template phrases, a short five-star text."""
    words = plain_words(F.col("text"))
    n = F.size(words)
    repetitive = F.when((n > 30) & (F.size(F.array_distinct(words)) / n < 0.35), 10).otherwise(0)
    superb = F.when((n > 0) & (F.regexp_count("text", F.lit(word_pattern(SUPERLATIVES))) / F.greatest(n, F.lit(1)) > 0.05), 10).otherwise(0)
    template = F.when(phrases_in(F.col("text"), TEMPLATE_PHRASES) >= 3, 15).otherwise(0)
    short = F.when((n < 20) & (F.col("rating") == 5), 5).otherwise(0)
    return F.least(F.lit(40), repetitive + superb + template + short)


def temporal_patterns(reviews: DataFrame) -> DataFrame:
    """asin, burst, recovery, one_week, temporal_deduction. Reviews without a date stand at the epoch and count."""
    rows = reviews.select("asin", "review_idx", "rating", F.unix_micros("ts").alias("t"))
    bursts = fullest(rows, "asin", "t", DAY, "within_day")
    # After a low review, fives count from its own instant on; those of that instant that sort before the first low one do not follow it.
    low = rows.groupBy("asin", "t").agg(F.min(F.when(F.col("rating") <= 2, F.col("review_idx"))).alias("low")).where("low IS NOT NULL").withColumnsRenamed({"asin": "k", "t": "u"})
    fives = rows.where("rating = 5").join(low, F.col("asin").eqNullSafe(F.col("k")) & (F.col("t") == F.col("u")), "left").groupBy("asin", "t").agg(F.count("*").alias("five"), F.count_if(F.col("review_idx") < F.col("low")).alias("before"))
    marks = fives.select("asin", "t", "five", "before", F.lit(0).alias("low")).unionByName(low.select(F.col("k").alias("asin"), F.col("u").alias("t"), F.lit(0).cast("long").alias("five"), F.lit(0).cast("long").alias("before"), F.lit(1).alias("low")))
    spans = span_sums(marks, "asin", "t", {"fives": F.col("five")}, 2 * DAY)
    at = marks.groupBy("asin", "t").agg(F.max("low").alias("low"), F.sum("before").alias("before")).where("low = 1").withColumnsRenamed({"asin": "k", "t": "u"})
    recovered = spans.join(at, F.col("asin").eqNullSafe(F.col("k")) & (F.col("t") == F.col("u"))).where("fives - before >= 3").select(F.col("asin").alias("k")).distinct()
    base = rows.groupBy("asin").agg(F.count("*").alias("n"), (F.max("t") - F.min("t") <= 7 * DAY).alias("one_week"))
    found = (
        base.join(bursts.withColumnRenamed("asin", "b"), F.col("asin").eqNullSafe(F.col("b")), "left").join(recovered, F.col("asin").eqNullSafe(F.col("k")), "left")
        .select("asin", "n", "one_week", F.coalesce(F.col("within_day") >= 5, F.lit(False)).alias("burst"), F.col("k").isNotNull().alias("recovery"))
    )
    some = F.col("n") >= 2
    deduction = F.when(some, F.least(F.lit(30), F.when(F.col("burst"), 15).otherwise(0) + F.when(F.col("recovery"), 20).otherwise(0) + F.when(F.col("one_week"), 10).otherwise(0))).otherwise(0)
    return found.select("asin", (some & F.col("burst")).alias("burst"), (some & F.col("recovery")).alias("recovery"), (some & F.col("one_week")).alias("one_week"), deduction.alias("temporal_deduction"))


def authenticity(histogram: Column, text: Column, temporal: Column) -> Column:
    """struct<score, label> from the three deductions; a missing one counts 0."""
    score = clamp(half_up_int(100 - F.coalesce(histogram, F.lit(0)) - F.coalesce(text, F.lit(0.0)) - F.coalesce(temporal, F.lit(0)))).cast("int")
    return F.struct(score.alias("score"), label(score, [(80, "authentic"), (50, "mixed")], "suspicious").alias("label"))


def densest_week(reviews: DataFrame) -> DataFrame:
    """asin, most (reviews in the fullest seven days), dated (reviews with a date)."""
    rows = reviews.select("asin", F.unix_micros("ts").alias("t")).where("t > 0")
    sums = span_sums(rows, "asin", "t", {"most": F.lit(1)}, 7 * DAY)
    dated = rows.groupBy("asin").agg(F.count("*").alias("dated")).withColumnRenamed("asin", "k")
    return sums.groupBy("asin").agg(F.max("most").alias("most")).join(dated, F.col("asin").eqNullSafe(F.col("k"))).select("asin", "most", "dated")


#: Words whose frequency orders a review's words; all others count as rarer. Words of the sets that one part of an item's reviews holds.
FREQUENT, WORDS_PER_PART = 1 << 18, 1 << 18
#: Bits of a set's sketch, and of the map of classes whose sets are read again (2^10 maps of 2^15 bits, 4 MB in all).
SKETCH_BITS, MAP_BITS = 1 << 10, 1 << 25


def _heads(sets: DataFrame, threshold: float) -> DataFrame:
    """c, n, word: each review's rarest words (hashed, with its item), as many as two sets at the threshold must share one of.

    Any one order of all words will do, so only the most frequent are known by their number; those that occur once in all are left out where all others are known.
    """
    import numpy as np

    every = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    known = np.array(every.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect(), dtype=np.int64).reshape(-1, 2)
    known, whole = known[np.argsort(known[:, 0])], len(known) < FREQUENT

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists, item, c = batch.column("words"), *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("item", "c"))
            n, words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known[:, 0], words), max(0, len(known) - 1))
            found = known[at, 0] == words if len(known) else np.zeros(len(words), dtype=bool)
            often = np.where(found, known[at, 1], 0) if len(known) else np.zeros(len(words), dtype=np.int64)
            rare_first = np.lexsort((words, often, of))
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            heads = rare_first[place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[of]]
            heads = heads[found[heads]] if whole else heads
            mine = of[heads]
            yield pa.RecordBatch.from_arrays([pa.array(c[mine]), pa.array(n[mine].astype(np.int32)), pa.array((words[heads].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ item[mine].view(np.uint64)).view(np.int64))], ["c", "n", "word"])

    return sets.select("item", "c", "words").mapInArrow(run, "c long, n int, word long")


def _meetings(heads: DataFrame, threshold: float) -> DataFrame:
    """a, b: classes that share so many of their rarest words that they may reach the threshold.

    Of two sets one has its last head first: all that they share up to there is among the heads of both, and beyond it stand only its other words.
    """
    each = heads.repartition("word").dropDuplicates()
    left, right = each.withColumnsRenamed({"c": "a", "n": "na"}), each.withColumnsRenamed({"c": "b", "n": "nb", "word": "v"})
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    met = left.join(right, F.col("word") == F.col("v")).where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    beyond = F.ceil(threshold * F.greatest("na", "nb") - 1e-9) - 1
    return met.where(F.col("k") + beyond >= F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6)).select("a", "b")


def _sketched(sets: DataFrame) -> DataFrame:
    """asin, c, review_idx, n, sketch: for each bit of the sketch whether an odd number of the set's words falls on it.

    Each word that only one of two sets holds turns one bit, so at most as many bits differ as words do.
    """
    kind, longs = sets.schema["review_idx"].dataType.simpleString(), SKETCH_BITS // 64

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("words")
            n, words = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            out = np.zeros(len(n) * longs, dtype=np.uint64)
            at = np.repeat(np.arange(len(n)) * longs, n) + ((words >> np.uint64(6)) % np.uint64(longs)).astype(np.int64)
            np.bitwise_xor.at(out, at, np.uint64(1) << (words & np.uint64(63)))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * longs, pa.int32()), pa.array(out.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("asin", "c", "review_idx")), pa.array(n.astype(np.int32)), sketches], ["asin", "c", "review_idx", "n", "sketch"])

    return sets.select("asin", "c", "review_idx", "words").mapInArrow(run, f"asin string, c long, review_idx {kind}, n int, sketch array<bigint>")


def _alike(threshold: float) -> Column:
    """Whether sets of na and nb words with sketches sa and sb may reach the threshold: never false for two that do."""
    turned = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return turned <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-6


def _of_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the classes, and a few others: by a map of bits, so that the other sets are not shuffled to be dropped."""
    import numpy as np

    place, each = F.col("c").bitwiseAND(F.lit(MAP_BITS - 1)), 1 << 15
    maps = classes.groupBy((place / each).cast("int").alias("k")).agg(F.bitmap_construct_agg(place % each).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for k, found in maps:
        bits[k * each // 8 : (k + 1) * each // 8] = np.frombuffer(bytes(found), dtype=np.uint8)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("c").to_numpy(zero_copy_only=False) & (MAP_BITS - 1)
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return sets.mapInArrow(run, sets.schema)


def copied_pairs(reviews: DataFrame, threshold: float = 0.7, least_tokens: int = 5) -> DataFrame:
    """asin, pairs: reviews of one item whose word sets (three characters or more) have at least this Jaccard similarity.

    Reviews with equal word sets are one class and count n(n-1)/2 pairs at once. Classes meet on their rarest words (prefix filtering), not by all
    pairs of an item; those that share too few of these, or whose sketches differ too much, are not compared. Only sets that are still asked for are read
    again, and travel once to each pair of parts of their item where one of their pairs is counted. Words are 64-bit hashes throughout: two words
    of one pair would have to fall together to miscount it.
    """
    said = reviews.where("asin IS NOT NULL").select("asin", "review_idx", F.sort_array(F.array_distinct(F.transform(long_words(F.col("text")), lambda x: F.xxhash64(x)))).alias("words"))
    words = materialize(said, "review-words", **{"parquet.dictionary.page.size": 8 << 20})
    hashed = words.where(F.size("words") >= least_tokens).select("asin", "review_idx", F.xxhash64("asin", "words").alias("c"), "words")
    classes = materialize(_sketched(hashed).groupBy("asin", "c").agg(F.min("review_idx").alias("rep"), F.count("*").alias("m"), F.any_value("n").alias("n"), F.any_value("sketch").alias("s")), "review-classes")
    pairs = materialize(_meetings(_heads(hashed.select("c", F.xxhash64("asin").alias("item"), "words"), threshold), threshold), "review-meetings")
    one, other = (classes.select(F.col("asin").alias(f"i{k}"), F.col("c").alias(f"c{k}"), *(F.col(x).alias(f"{x}{k}") for x in ("rep", "m", "n", "s"))) for k in "ab")
    near = pairs.join(one, F.col("a") == F.col("ca")).join(other, F.col("b") == F.col("cb")).where((F.col("ia") == F.col("ib")) & _alike(threshold))
    near = materialize(near.select(F.col("ia").alias("asin"), "a", "b", "repa", "repb", "na", "nb", (F.col("ma") * F.col("mb")).alias("both")), "review-near")
    members = near.select("asin", F.col("a").alias("c"), F.col("na").alias("n")).unionByName(near.select("asin", F.col("b").alias("c"), F.col("nb").alias("n"))).distinct()
    parts = members.groupBy("asin").agg(F.ceil(F.sum("n") / WORDS_PER_PART).alias("parts")).withColumnRenamed("asin", "i")
    own = {k: F.pmod(F.xxhash64(k), F.col("parts")).cast("int") for k in ("a", "b")}
    asked = near.join(parts, F.col("asin") == F.col("i")).withColumns({"low": F.least(*own.values()), "high": F.greatest(*own.values())})
    asked = materialize(asked.select("asin", "low", "high", "a", "b", "repa", "repb", "both"), "review-asked")
    keys = ("asin", "low", "high")
    place = [F.col(k).alias(k) for k in keys]  # columns of their own: the sets meet the pairs again below
    places = asked.select(*place, F.col("a").alias("k"), F.col("repa").alias("rep")).unionByName(asked.select(*place, F.col("b").alias("k"), F.col("repb").alias("rep"))).distinct()
    sets = _of_classes(hashed, members).withColumnRenamed("asin", "i")
    spread = sets.join(places, (F.col("c") == F.col("k")) & (F.col("review_idx") == F.col("rep")) & (F.col("asin") == F.col("i"))).select(*keys, "c", "words")

    def count(sets, asked):
        import numpy as np
        import pyarrow as pa

        lists = sets["words"].combine_chunks()
        ends, words = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist(), lists.flatten().to_numpy(zero_copy_only=False)
        of = {c: words[start:end] for c, start, end in zip(sets["c"].to_pylist(), [0, *ends], ends, strict=False)}
        found = 0
        for a, b, both in zip(*(asked[k].to_pylist() for k in ("a", "b", "both")), strict=True):
            x, y = of[a], of[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            found += both if shared / (len(x) + len(y) - shared) >= threshold else 0
        return pa.table({"asin": asked["asin"][:1], "p": pa.array([found], pa.int64())})

    close = spread.groupBy(*keys).cogroup(asked.select(*keys, "a", "b", "both").groupBy(*keys)).applyInArrow(count, "asin string, p long").where("p > 0")
    counts = close.unionByName(classes.where("m > 1").select("asin", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("p")))
    found = materialize(counts.groupBy("asin").agg(F.sum("p").alias("pairs")), "review-pairs")
    discard(words, classes, pairs, near, asked)
    return found


def _signal(name: str, deduction: Column, confidence: Column | float, most: int) -> Column:
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(name).alias("id"), F.coalesce(deduction, F.lit(0)).cast("int").alias("deduction"), F.when(F.coalesce(deduction, F.lit(0)) > 0, c).otherwise(0.0).cast("double").alias("confidence"), F.lit(most).alias("most"))


def _step(value: Column, *steps: tuple[float, int]) -> Column:
    out = F
    for cut, points in steps:
        out = out.when(value >= cut, points)
    return out.otherwise(0)


def trust_signals(reviews: DataFrame, displayed: DataFrame | None = None) -> DataFrame:
    """asin, n, signals (ten structs), trust score, label. displayed: asin, average_rating as shown on the page."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(long_words(text))
    praise = phrases_in(text, GENERIC_PRAISE)
    bad, good = text.rlike(word_pattern(NEGATIVE)), text.rlike(word_pattern(POSITIVE))
    odd = ((F.col("rating") == 5) & bad & ~good) | ((F.col("rating") <= 2) & good & ~bad)
    size = F.length(text)
    base = reviews.groupBy("asin").agg(
        F.count("*").alias("n"), F.avg(F.col("verified").cast("double")).alias("verified"), F.count_if(phrases_in(text, INCENTIVES) > 0).alias("paid"),
        F.count_if((F.col("rating") >= 4) & (((praise >= 2) & (words < 40)) | (praise >= 3))).alias("generic"), F.count_if(F.col("rating") >= 4).alias("happy"),
        F.try_divide(F.stddev_pop(size), F.avg(size)).alias("cv"), F.count_if(odd).alias("odd"), F.max("helpful_votes").alias("votes"),
    )
    stats = base.join(histograms(reviews), "asin").join(copied_pairs(reviews), "asin", "left").join(densest_week(reviews), "asin", "left")
    shown = F.col("average")
    if displayed is not None:
        stats, shown = stats.join(displayed, "asin", "left"), F.coalesce("average_rating", "average")
    n, r = F.col("n"), F.col("total")
    five, four, one, middle = _share("five"), _share("four"), _share("one"), _share("two") + _share("three") + _share("four")
    shape = F.when((five > 70) & (four < 5) & (r > 30), 12).when((five > 85) & (r > 50), 8).otherwise(0) + F.when((five > 50) & (one > 20) & (middle < 15), 10).otherwise(0)
    paid = F.col("paid") / n
    generic = F.try_divide(F.col("generic").cast("double"), F.col("happy").cast("double"))
    week = F.col("most") / F.col("dated")
    signals = F.array(
        _signal("rating-shape", F.when(r >= 10, F.least(F.lit(15), shape)), F.when(r >= 100, 1.0).when(r >= 30, 0.7).otherwise(0.4), 15),
        _signal("verified-ratio", F.when(n >= 3, F.when(F.col("verified") < 0.2, 15).when(F.col("verified") < 0.4, 10).when(F.col("verified") < 0.6, 5).otherwise(0)), F.when(n >= 8, 1.0).when(n >= 5, 0.7).otherwise(0.5), 15),
        _signal("incentivized", F.when(F.col("paid") > 0, _step(paid, (0.5, 12), (0.3, 8), (0.0, 4))), F.when(n >= 5, 0.9).otherwise(0.6), 12),
        _signal("generic-praise", _step(generic, (0.6, 12), (0.4, 8), (0.2, 4)), F.when(n >= 5, 0.8).otherwise(0.5), 12),
        _signal("length-uniformity", F.when((n >= 4) & (F.col("cv") <= 0.3), F.when(F.col("cv") < 0.15, 8).otherwise(4)), F.when(n >= 7, 0.8).otherwise(0.5), 8),
        _signal("copy-paste", F.when(F.col("pairs") >= 3, 15).when(F.col("pairs") >= 2, 10).when(F.col("pairs") >= 1, 7), F.when(n >= 4, 0.9).otherwise(0.6), 15),
        _signal("sentiment-mismatch", F.when(F.col("odd") > 0, _step(F.col("odd") / n, (0.4, 10), (0.2, 6), (0.0, 3))), F.when(n >= 5, 0.8).otherwise(0.5), 10),
        _signal("helpful-votes", F.when((n >= 3) & (F.col("votes") <= 0), F.when(r >= 200, 6).when(r >= 50, 3)), F.when(r >= 200, 0.5).otherwise(0.4), 6),
        _signal("date-clustering", F.when((n >= 3) & (F.col("dated") >= 3), _step(week, (0.8, 12), (0.6, 7), (0.5, 4))), F.when(F.col("dated") >= 7, 0.85).otherwise(0.5), 12),
        _signal("rating-count-anomaly", F.when((r >= 50) & (F.abs(F.col("average") - shown) > 0.3), 8), 0.7, 8),
    )
    scored = stats.select("asin", "n", signals.alias("signals")).withColumn("lost", F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["deduction"] * s["confidence"]))
    score = clamp(half_up_int(100 - F.col("lost"))).cast("int")
    return scored.select("asin", "n", "signals", half_up(F.col("lost"), 1).alias("total_deduction"), score.alias("trust_score"), label(score, [(85, "trustworthy"), (65, "mixed"), (40, "questionable")], "suspicious").alias("trust_label"))


def sentiment_scorer(scorer) -> Column:
    """A pluggable model as an Arrow function: scorer takes a list of texts and gives probabilities of being negative."""
    import pandas as pd

    def score(text):
        return pd.Series(scorer(text.fillna("").tolist()))

    score.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(F.col("text"))


def positive_signals(reviews: DataFrame) -> DataFrame:
    """asin, positives: the good signs of an item's reviews (with n_topics, the topics of each): most are verified, their words vary, four
    stars have a natural share, many speak of several topics, many were found helpful, they spread over a quarter."""
    words = F.explode(F.array_distinct(F.filter(plain_words(F.col("text")), lambda w: F.length(w) > 3)))
    varied = reviews.select("asin", words.alias("w")).distinct().groupBy("asin").agg(F.count("*").alias("words")).withColumnRenamed("asin", "k")
    seconds = F.when(F.unix_timestamp("ts") > 0, F.unix_timestamp("ts"))
    base = reviews.groupBy("asin").agg(
        F.count("*").alias("n"), F.avg(F.col("verified").cast("int")).alias("verified"), (F.avg((F.col("rating") == 4).cast("int")) * 100).alias("four"), F.avg((F.col("n_topics") >= 2).cast("int")).alias("several"),
        F.avg((F.col("helpful_votes") > 0).cast("int")).alias("helped"), F.count(seconds).alias("dated"), (F.max(seconds) - F.min(seconds)).alias("span"),
    )
    some, full = F.col("n") >= 3, base.join(varied, F.col("asin").eqNullSafe(F.col("k")), "left")
    signs = {
        "verified": some & (F.col("verified") >= 0.8), "vocabulary": some & (F.col("words") / F.col("n") > 30), "distribution": F.col("four").between(12, 30), "balanced": some & (F.col("several") >= 0.3),
        "helpful": some & (F.col("helped") >= 0.3), "spread": (F.col("dated") >= 3) & (F.col("span") >= 90 * 86400),
    }
    return full.select("asin", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in signs.items()))).alias("positives"))
