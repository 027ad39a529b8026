"""Queries over reviews: histograms, time patterns, texts, trust, topics, recalls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import sentences
from ..operators import recalls, review_scores, sentiment, topics
from ..sources.tables import RECALL_SCHEMA, listings, reviews, table, text_reviews
from .listing_queries import LISTINGS
from .registry import query

REVIEWS = """WITH r AS (SELECT l_partkey::VARCHAR AS asin, l_orderkey * 8 + l_linenumber AS idx, 1 + floor((l_quantity - 1) / 10) AS rating, epoch_us(l_shipdate::TIMESTAMP) AS t,
  l_returnflag <> 'R' AS verified, l_linenumber - 1 AS votes FROM lineitem)"""
HIST = REVIEWS + """, h AS (SELECT asin, count(*) FILTER (rating = 5)::BIGINT AS five, count(*) FILTER (rating = 4)::BIGINT AS four, count(*) FILTER (rating = 3)::BIGINT AS three,
  count(*) FILTER (rating = 2)::BIGINT AS two, count(*) FILTER (rating = 1)::BIGINT AS one, count(*)::BIGINT AS total FROM r GROUP BY asin)"""
ENTROPY = "-(" + " + ".join(f"CASE WHEN {k} > 0 THEN {k}::DOUBLE / total * log2({k}::DOUBLE / total) ELSE 0 END" for k in ("five", "four", "three", "two", "one")) + ")"
TEXTS = "WITH r AS (SELECT source AS asin, doc_id AS idx, coalesce(text, '') AS text, 1.0 + doc_id % 5 AS rating FROM documents)"


def _like(phrases: tuple[str, ...]) -> str:
    """SQL: how many of the phrases column `low` contains."""
    return "(" + " + ".join("contains(low, '" + p.replace("'", "''") + "')::INT" for p in phrases) + ")"


def _words(words: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


@query(
    "histogram_analysis",
    HIST + f"""SELECT asin, five, one, total, floor(({ENTROPY}) * 1e6 + 0.5) / 1e6 AS entropy, least(30,
  CASE WHEN (five + one) * 100.0 / total > 80 AND two * 100.0 / total + three * 100.0 / total < 10 THEN 25 ELSE 0 END + CASE WHEN five * 100.0 / total > 90 AND total > 50 THEN 20 ELSE 0 END
  + CASE WHEN {ENTROPY} < 1.0 THEN 15 ELSE 0 END)::INT AS deduction FROM h""",
)
def histogram_analysis(spark, sf_dir):
    """Histogram, entropy and deduction of each item."""
    h = review_scores.histograms(reviews(spark, sf_dir))
    return h.select("asin", "five", "one", "total", half_up(review_scores.entropy(), 6).alias("entropy"), review_scores.histogram_deduction().alias("deduction"))


TEMPORAL = REVIEWS + """, o AS (SELECT *, lead(t, 4) OVER (PARTITION BY asin ORDER BY t, idx) AS fifth, row_number() OVER (PARTITION BY asin ORDER BY t, idx) AS k FROM r),
rec AS (SELECT DISTINCT a.asin FROM o a JOIN o b ON a.asin = b.asin AND b.k > a.k AND b.t <= a.t + 172800000000 AND b.rating = 5 WHERE a.rating <= 2 GROUP BY a.asin, a.k HAVING count(*) >= 3),
g AS (SELECT asin, count(*) AS n, coalesce(bool_or(fifth - t <= 86400000000), false) AS burst, max(t) - min(t) <= 604800000000 AS week FROM o GROUP BY asin)"""


@query(
    "temporal_patterns",
    TEMPORAL + """SELECT asin, n >= 2 AND burst AS burst, n >= 2 AND asin IN (FROM rec) AS recovery, n >= 2 AND week AS one_week,
  (CASE WHEN n >= 2 THEN least(30, burst::INT * 15 + (asin IN (FROM rec))::INT * 20 + week::INT * 10) ELSE 0 END)::INT AS temporal_deduction FROM g""",
)
def temporal_patterns(spark, sf_dir):
    """Bursts, recovery bursts, single weeks."""
    return review_scores.temporal_patterns(reviews(spark, sf_dir))


@query("densest_week", REVIEWS + ", c AS (SELECT asin, count(*) OVER (PARTITION BY asin ORDER BY t RANGE BETWEEN CURRENT ROW AND 604800000000 FOLLOWING) AS n FROM r WHERE t > 0) SELECT asin, max(n)::BIGINT AS most, count(*)::BIGINT AS dated FROM c GROUP BY asin")
def densest_week(spark, sf_dir):
    """The fullest seven days of each item."""
    return review_scores.densest_week(reviews(spark, sf_dir))


TEXT_RULES = TEXTS + f""", w AS (SELECT asin, idx, rating, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM r),
d AS (SELECT asin, idx, least(40, CASE WHEN len(w) > 30 AND len(list_distinct(w)) / len(w) < 0.35 THEN 10 ELSE 0 END
  + CASE WHEN len(w) > 0 AND len(regexp_extract_all(text, '{_words(review_scores.SUPERLATIVES)}')) / len(w) > 0.05 THEN 10 ELSE 0 END
  + CASE WHEN {_like(review_scores.TEMPLATE_PHRASES)} >= 3 THEN 15 ELSE 0 END + CASE WHEN len(w) < 20 AND rating = 5 THEN 5 ELSE 0 END)::INT AS deduction FROM w)"""


@query("review_text_rules", TEXT_RULES + "SELECT idx AS review_idx, deduction FROM d")
def review_text_rules(spark, sf_dir):
    """Deduction of each text."""
    return text_reviews(spark, sf_dir).select("review_idx", review_scores.text_deduction().alias("deduction"))


@query("review_text_means", TEXT_RULES + "SELECT asin, count(*)::BIGINT AS n, floor(avg(deduction) * 1e6 + 0.5) / 1e6 AS avg_deduction FROM d GROUP BY asin")
def review_text_means(spark, sf_dir):
    """Mean deduction of an item's texts."""
    rows = text_reviews(spark, sf_dir).select("asin", review_scores.text_deduction().alias("d"))
    return rows.groupBy("asin").agg(F.count("*").alias("n"), half_up(F.avg("d"), 6).alias("avg_deduction"))


@query(
    "authenticity_scores",
    TEMPORAL + ", " + HIST.split(", h AS", 1)[1].join(["h AS", ""]) + f""", s AS (SELECT asin, greatest(0, least(100, floor(100 - least(30, CASE WHEN (five + one) * 100.0 / total > 80 AND two * 100.0 / total + three * 100.0 / total < 10 THEN 25 ELSE 0 END + CASE WHEN five * 100.0 / total > 90 AND total > 50 THEN 20 ELSE 0 END + CASE WHEN {ENTROPY} < 1.0 THEN 15 ELSE 0 END)
  - (CASE WHEN n >= 2 THEN least(30, burst::INT * 15 + (asin IN (FROM rec))::INT * 20 + week::INT * 10) ELSE 0 END) + 0.5)))::INT AS score FROM g JOIN h USING (asin))
SELECT asin, score, CASE WHEN score >= 80 THEN 'authentic' WHEN score >= 50 THEN 'mixed' ELSE 'suspicious' END AS label FROM s""",
)
def authenticity_scores(spark, sf_dir):
    """Authenticity from histogram and dates."""
    rows = reviews(spark, sf_dir)
    both = review_scores.histograms(rows).join(review_scores.temporal_patterns(rows), "asin")
    score = review_scores.authenticity(review_scores.histogram_deduction(), F.lit(None).cast("double"), F.col("temporal_deduction"))
    return both.select("asin", score.alias("s")).select("asin", "s.score", "s.label")


COPY_SQL = TEXTS + r""", t AS MATERIALIZED (SELECT asin, idx, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda w: length(w) > 2) AS w FROM r), ok AS (SELECT * FROM t WHERE len(w) >= 5),
c AS (SELECT a.asin, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM ok a JOIN ok b ON a.asin = b.asin AND a.idx < b.idx AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w))
SELECT asin, count(*)::BIGINT AS pairs FROM c WHERE i / (x + y - i) >= 0.7 GROUP BY asin"""


@query("copied_reviews", COPY_SQL)
def copied_reviews(spark, sf_dir):
    """Near-copies among an item's reviews."""
    return review_scores.copied_pairs(text_reviews(spark, sf_dir))


@query(
    "verified_and_votes",
    REVIEWS + """SELECT asin, CASE WHEN count(*) >= 3 THEN CASE WHEN avg(verified::INT) < 0.2 THEN 15 WHEN avg(verified::INT) < 0.4 THEN 10 WHEN avg(verified::INT) < 0.6 THEN 5 ELSE 0 END ELSE 0 END::INT AS verified_deduction,
  CASE WHEN count(*) >= 3 AND max(votes) <= 0 THEN CASE WHEN count(*) >= 200 THEN 6 WHEN count(*) >= 50 THEN 3 ELSE 0 END ELSE 0 END::INT AS votes_deduction FROM r GROUP BY asin""",
)
def verified_and_votes(spark, sf_dir):
    """Two signals of the trust score, from the whole signal set."""
    rows = reviews(spark, sf_dir).withColumn("text", F.lit(""))
    found = review_scores.trust_signals(rows)
    return found.select("asin", F.get("signals", F.lit(1))["deduction"].alias("verified_deduction"), F.get("signals", F.lit(7))["deduction"].alias("votes_deduction"))


TRUST_SQL = TEXTS.replace("FROM documents", ", doc_id % 3 > 0 AS verified, doc_id % 2 AS votes, (1700000000 + doc_id * 40000) * 1000000 AS t FROM documents") + COPY_SQL[len(TEXTS):].replace("\nSELECT asin, count(*)::BIGINT AS pairs FROM c", ", t0 AS (SELECT asin, count(*) AS pairs FROM c").replace(", t AS MATERIALIZED", ", tk AS MATERIALIZED").replace("SELECT * FROM t WHERE", "SELECT * FROM tk WHERE") + f"""),
wk AS (SELECT asin, max(n) AS most, count(*) AS dated FROM (SELECT asin, count(*) OVER (PARTITION BY asin ORDER BY t RANGE BETWEEN CURRENT ROW AND 604800000000 FOLLOWING) AS n FROM r WHERE t > 0) GROUP BY asin),
lo AS (SELECT *, lower(text) AS low, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2)) AS words, regexp_matches(text, '{_words(review_scores.NEGATIVE)}') AS bad, regexp_matches(text, '{_words(review_scores.POSITIVE)}') AS good FROM r),
g AS (SELECT asin, count(*) AS n, avg(verified::INT) AS v, count(*) FILTER ({_like(review_scores.INCENTIVES)} > 0) AS paid, count(*) FILTER (rating >= 4) AS happy, count(*) FILTER (rating >= 4 AND (({_like(review_scores.GENERIC_PRAISE)} >= 2 AND words < 40) OR {_like(review_scores.GENERIC_PRAISE)} >= 3)) AS generic,
  stddev_pop(length(text)) / nullif(avg(length(text)), 0) AS cv, count(*) FILTER ((rating = 5 AND bad AND NOT good) OR (rating <= 2 AND good AND NOT bad)) AS odd, max(votes) AS votes,
  count(*) FILTER (rating = 5) * 100.0 / count(*) AS five, count(*) FILTER (rating = 4) * 100.0 / count(*) AS four, count(*) FILTER (rating = 1) * 100.0 / count(*) AS one FROM lo WHERE asin IS NOT NULL GROUP BY asin),
d AS (SELECT asin, n,
  [CASE WHEN n >= 10 THEN least(15, CASE WHEN five > 70 AND four < 5 AND n > 30 THEN 12 WHEN five > 85 AND n > 50 THEN 8 ELSE 0 END + CASE WHEN five > 50 AND one > 20 AND 100 - five - one < 15 THEN 10 ELSE 0 END) ELSE 0 END * CASE WHEN n >= 100 THEN 1.0 WHEN n >= 30 THEN 0.7 ELSE 0.4 END::DOUBLE,
  CASE WHEN n >= 3 THEN CASE WHEN v < 0.2 THEN 15 WHEN v < 0.4 THEN 10 WHEN v < 0.6 THEN 5 ELSE 0 END ELSE 0 END * CASE WHEN n >= 8 THEN 1.0 WHEN n >= 5 THEN 0.7 ELSE 0.5 END::DOUBLE,
  CASE WHEN paid > 0 THEN CASE WHEN paid / n >= 0.5 THEN 12 WHEN paid / n >= 0.3 THEN 8 ELSE 4 END ELSE 0 END * CASE WHEN n >= 5 THEN 0.9 ELSE 0.6 END::DOUBLE,
  CASE WHEN generic / nullif(happy, 0) >= 0.6 THEN 12 WHEN generic / nullif(happy, 0) >= 0.4 THEN 8 WHEN generic / nullif(happy, 0) >= 0.2 THEN 4 ELSE 0 END * CASE WHEN n >= 5 THEN 0.8 ELSE 0.5 END::DOUBLE,
  CASE WHEN n >= 4 AND cv <= 0.3 THEN CASE WHEN cv < 0.15 THEN 8 ELSE 4 END ELSE 0 END * CASE WHEN n >= 7 THEN 0.8 ELSE 0.5 END::DOUBLE,
  CASE WHEN pairs >= 3 THEN 15 WHEN pairs >= 2 THEN 10 WHEN pairs >= 1 THEN 7 ELSE 0 END * CASE WHEN n >= 4 THEN 0.9 ELSE 0.6 END::DOUBLE,
  CASE WHEN odd > 0 THEN CASE WHEN odd / n >= 0.4 THEN 10 WHEN odd / n >= 0.2 THEN 6 ELSE 3 END ELSE 0 END * CASE WHEN n >= 5 THEN 0.8 ELSE 0.5 END::DOUBLE,
  CASE WHEN n >= 3 AND votes <= 0 THEN CASE WHEN n >= 200 THEN 6 WHEN n >= 50 THEN 3 ELSE 0 END ELSE 0 END * CASE WHEN n >= 200 THEN 0.5 ELSE 0.4 END::DOUBLE,
  CASE WHEN n >= 3 AND dated >= 3 THEN CASE WHEN most / dated >= 0.8 THEN 12 WHEN most / dated >= 0.6 THEN 7 WHEN most / dated >= 0.5 THEN 4 ELSE 0 END ELSE 0 END * CASE WHEN dated >= 7 THEN 0.85 ELSE 0.5 END::DOUBLE] AS parts
  FROM g LEFT JOIN t0 USING (asin) LEFT JOIN wk USING (asin)), l AS (SELECT asin, n::BIGINT AS n, list_sum(parts) AS lost FROM d), z AS (SELECT asin, n, floor(lost * 10 + 0.5) / 10 AS total_deduction, greatest(0, least(100, floor(100 - lost + 0.5)))::INT AS trust_score FROM l)
SELECT *, CASE WHEN trust_score >= 85 THEN 'trustworthy' WHEN trust_score >= 65 THEN 'mixed' WHEN trust_score >= 40 THEN 'questionable' ELSE 'suspicious' END AS trust_label FROM z"""


@query("trust_scores", TRUST_SQL)
def trust_scores(spark, sf_dir):
    """All ten signals and the trust score over texts."""
    rows = text_reviews(spark, sf_dir).withColumns({"ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("review_idx") * 40000), "verified": F.col("review_idx") % 3 > 0, "helpful_votes": F.col("review_idx") % 2})
    return review_scores.trust_signals(rows).select("asin", "n", "total_deduction", "trust_score", "trust_label")


@query(
    "phrase_signals",
    TEXTS + f""", l AS (SELECT *, lower(text) AS low FROM r)
SELECT asin, count(*) FILTER ({_like(review_scores.INCENTIVES)} > 0)::BIGINT AS paid, count(*) FILTER ((rating = 5 AND regexp_matches(text, '{_words(review_scores.NEGATIVE)}') AND NOT regexp_matches(text, '{_words(review_scores.POSITIVE)}'))
  OR (rating <= 2 AND regexp_matches(text, '{_words(review_scores.POSITIVE)}') AND NOT regexp_matches(text, '{_words(review_scores.NEGATIVE)}')))::BIGINT AS contrary, floor(stddev_pop(length(text)) / avg(length(text)) * 1e6 + 0.5) / 1e6 AS cv FROM l GROUP BY asin""",
)
def phrase_signals(spark, sf_dir):
    """What three of the signals count."""
    text = F.col("text")
    bad, good = text.rlike(review_scores.word_pattern(review_scores.NEGATIVE)), text.rlike(review_scores.word_pattern(review_scores.POSITIVE))
    return text_reviews(spark, sf_dir).groupBy("asin").agg(
        F.count_if(review_scores.phrases_in(text, review_scores.INCENTIVES) > 0).alias("paid"), F.count_if(((F.col("rating") == 5) & bad & ~good) | ((F.col("rating") <= 2) & good & ~bad)).alias("contrary"),
        half_up(F.stddev_pop(F.length(text)) / F.avg(F.length(text)), 6).alias("cv"),
    )


#: A dictionary whose words occur in the driver's prose.
GENERIC_TOPICS = {"articles": ("the ", "der ", "les "), "links": (" and ", " und ", " et "), "places": (" in ", " on ", " at ")}


def _tagged(spark, sf_dir):
    """Lines of documents as sentences, for SQL has no look-behind to cut them with."""
    rows = text_reviews(spark, sf_dir).select("asin", "review_idx", "rating", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("all"))
    each = rows.select("asin", "review_idx", "rating", F.lit(None).cast("int").alias("implied"), (1.0 / F.size("all")).alias("weight"), F.posexplode("all").alias("place", "sentence"))
    found = each.withColumn("topics", topics.tags(F.col("sentence"), GENERIC_TOPICS))
    return found.withColumn("topics", F.when(F.size("topics") == 0, F.array(F.lit("other"))).otherwise(F.col("topics")))


TAGGED = TEXTS + """, l AS (SELECT asin, idx, rating, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM r), s AS (SELECT asin, idx, rating, 1.0::DOUBLE / len(a) AS weight, unnest(a) AS s, generate_subscripts(a, 1) AS place FROM l),
g0 AS (SELECT *, list_filter([CASE WHEN regexp_matches(s, '(?i)the |der |les ') THEN 'articles' END, CASE WHEN regexp_matches(s, '(?i) and | und | et ') THEN 'links' END, CASE WHEN regexp_matches(s, '(?i) in | on | at ') THEN 'places' END], lambda x: x IS NOT NULL) AS g1 FROM s),
g AS (SELECT *, CASE WHEN len(g1) = 0 THEN ['other'] ELSE g1 END AS topics FROM g0), x AS (SELECT *, unnest(topics) AS topic, generate_subscripts(topics, 1) AS k FROM g)"""


@query(
    "topic_scores",
    TAGGED + """, n AS (SELECT asin, topic, floor(sum(weight * rating) / sum(weight) * 10 + 0.5) / 10 AS avg_rating, count(DISTINCT idx)::BIGINT AS review_mentions, count(*)::BIGINT AS sentence_mentions FROM x GROUP BY asin, topic)
SELECT *, CASE WHEN avg_rating >= 4 THEN 'positive' WHEN avg_rating >= 3 THEN 'mixed' ELSE 'negative' END AS sentiment FROM n""",
)
def topic_scores(spark, sf_dir):
    """Weighted rating and mentions of each topic."""
    return topics.topic_scores(_tagged(spark, sf_dir))


@query(
    "topic_counts",
    TAGGED + """, p AS (SELECT asin, topic, idx, any_value(rating) AS rating FROM x GROUP BY asin, topic, idx), e AS (SELECT asin, count(DISTINCT idx) AS n FROM g GROUP BY asin)
SELECT asin, topic, count(*)::BIGINT AS reviews, floor(count(*) * 100.0 / any_value(n) + 0.5)::INT AS share, floor(avg(rating) * 10 + 0.5) / 10 AS avg_rating FROM p JOIN e USING (asin) GROUP BY asin, topic""",
)
def topic_counts(spark, sf_dir):
    """Reviews of each topic (A4)."""
    return topics.topic_counts(_tagged(spark, sf_dir)).select("asin", "topic", "reviews", "share", "avg_rating")


@query("primary_topics", TAGGED + ", c AS (SELECT asin, idx, topic, count(*) AS n, min(place * 100 + k) AS seen FROM x GROUP BY asin, idx, topic) SELECT asin, idx AS review_idx, topic AS \"primary\" FROM c QUALIFY row_number() OVER (PARTITION BY asin, idx ORDER BY n DESC, seen) = 1")
def primary_topics(spark, sf_dir):
    """The leading topic of each review."""
    return topics.primary_topics(_tagged(spark, sf_dir))


@query(
    "adjusted_ratings",
    TAGGED + """, k AS (SELECT asin, idx, any_value(rating) AS rating, sum(CASE WHEN NOT list_contains(topics, 'places') THEN weight END) AS w FROM g GROUP BY asin, idx)
SELECT asin, floor(sum(rating * w) / sum(w) * 100 + 0.5) / 100 AS adjusted_rating, count(*)::BIGINT AS used FROM k WHERE w > 0 GROUP BY asin""",
)
def adjusted_ratings(spark, sf_dir):
    """Ratings without the sentences on an ignored topic (A5)."""
    return topics.adjusted_ratings(_tagged(spark, sf_dir), ("places",))


@query(
    "topic_trends",
    TAGGED + """, q AS (SELECT asin, topic, date_trunc('quarter', make_timestamp((1700000000 + idx * 40000) * 1000000)) AS q, sum(weight * rating) / sum(weight) AS score FROM x GROUP BY 1, 2, 3),
z AS (SELECT *, dense_rank() OVER (PARTITION BY asin ORDER BY q DESC) AS k FROM q), b AS (SELECT asin, topic, max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END) AS d FROM z WHERE k <= 2 GROUP BY asin, topic)
SELECT asin, topic, CASE WHEN d > 0.5 THEN 'rising' WHEN d < -0.5 THEN 'falling' WHEN d IS NOT NULL THEN 'stable' END AS trend FROM b""",
)
def topic_trends(spark, sf_dir):
    """The last quarter against the one before."""
    dated = _tagged(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("review_idx") * 40000))
    return topics.trends(topics.quarter_scores(dated))


@query(
    "topic_weights",
    TAGGED + """, n AS (SELECT asin, topic, floor(sum(weight * rating) / sum(weight) * 10 + 0.5) / 10 AS a, count(DISTINCT idx) AS m FROM x GROUP BY asin, topic), w AS (SELECT *, CASE topic WHEN 'links' THEN 1.5 WHEN 'places' THEN 0.5 ELSE 1.0 END::DOUBLE AS wt FROM n)
SELECT asin, floor(sum(a * wt * m) / sum(wt * m) * 10 + 0.5) / 10 AS weighted_score FROM w GROUP BY asin""",
)
def topic_weights(spark, sf_dir):
    """Department weights and the weighted mean."""
    weights = spark.createDataFrame([("links", 1.5), ("places", 0.5)], "topic string, weight double")
    return topics.weighted_aggregate(topics.weighted_scores(topics.topic_scores(_tagged(spark, sf_dir)), weights))


@query(
    "topic_summary",
    TAGGED + """, n AS (SELECT asin, topic, floor(sum(weight * rating) / sum(weight) * 10 + 0.5) / 10 AS a, count(DISTINCT idx) AS m FROM x GROUP BY asin, topic),
k AS (SELECT *, a >= 3.0 AS good, row_number() OVER (PARTITION BY asin, a >= 3.0 ORDER BY m DESC, CASE WHEN a >= 3.0 THEN -a ELSE a END, topic) AS k FROM n),
p AS (SELECT asin, string_agg(topic, ', ' ORDER BY k) FILTER (good AND k <= 3) AS pro, string_agg(topic, ', ' ORDER BY k) FILTER (NOT good AND k <= 2) AS con FROM k GROUP BY asin)
SELECT asin, concat_ws('. ', 'Praised for ' || pro, 'Criticised for ' || con) AS one_liner FROM p""",
)
def topic_summary(spark, sf_dir):
    """Pros, cons and one line."""
    return topics.summary(topics.topic_scores(_tagged(spark, sf_dir)), cut=3.0).select("asin", "one_liner")


@query(
    "keyword_summary",
    TEXTS + """, a AS (SELECT asin, idx, rating, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)the |der |les ') THEN 'articles' END, CASE WHEN regexp_matches(text, '(?i) and | und | et ') THEN 'links' END, CASE WHEN regexp_matches(text, '(?i) in | on | at ') THEN 'places' END], lambda x: x IS NOT NULL)) AS topic FROM r WHERE length(text) >= 10)
SELECT asin, topic, count(*)::BIGINT AS review_mentions, floor(avg(rating) * 10 + 0.5) / 10 AS avg_rating FROM a GROUP BY asin, topic HAVING count(*) >= 2""",
)
def keyword_summary(spark, sf_dir):
    """Aspects by keywords of whole reviews."""
    return topics.keyword_summary(text_reviews(spark, sf_dir), GENERIC_TOPICS)


@query("best_quotes", TAGGED + "SELECT asin, topic, arg_min(s, idx * 100000 + place) AS quote FROM x WHERE length(s) BETWEEN 20 AND 150 AND contains(lower(s), CASE topic WHEN 'articles' THEN 'the' WHEN 'links' THEN 'and' WHEN 'places' THEN 'in' END) GROUP BY asin, topic")
def best_quotes(spark, sf_dir):
    """The first fitting sentence of each topic."""
    return topics.best_quotes(_tagged(spark, sf_dir), {"articles": "the", "links": "and", "places": "in"})


@query(
    "sentence_split",
    TEXTS + r""", g AS (SELECT asin, idx, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(mr|mrs|ms|dr|prof|sr|jr|vs|etc|e\.g|i\.e|inc|ltd|co|approx)\.', '\1' || chr(1), 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '\.{2,}', chr(2), 'g') AS t FROM r),
s AS (SELECT asin, idx, unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(3), 'g'), chr(3))) AS s FROM g)
SELECT asin, count(*)::BIGINT AS sentences, count(DISTINCT idx)::BIGINT AS reviews FROM s WHERE trim(s) <> '' GROUP BY asin""",
)
def sentence_split(spark, sf_dir):
    """Sentences of reviews, as their topics are found in them (P13-P16); SQL marks the cuts where Spark looks behind."""
    return topics.tagged_sentences(text_reviews(spark, sf_dir)).groupBy("asin").agg(F.count("*").alias("sentences"), F.count_distinct("review_idx").alias("reviews"))


@query("sentence_literals", "SELECT * FROM (VALUES (0, 'Dr. Smith paid 4.5 dollars.'), (1, 'Good... or not?'), (2, 'Yes!')) t(place, sentence)")
def sentence_literals(spark, sf_dir):
    """Sentence cutting on a literal."""
    row = spark.createDataFrame([("Dr. Smith paid 4.5 dollars. Good... or not? Yes!",)], "t string")
    return row.select(F.posexplode(sentences(F.col("t"))).alias("place", "sentence"))


def recall_feed(spark):
    rows = [
        (1, [("Red Anvil Large", None), ("Old Bolt Kit", None)], "Retailer recalls red anvil", "The red anvil may break", ["retailer.example"]),
        (2, [("Blue Ring Small", None)], "Blue ring recall", "Rings in blue can fall", ["Shop"]),
    ]
    cells = [(i, None, None, t, d, None, None, None, [(n, None, None, None) for n, _ in ps], [], [], [], [(s,) for s in sold], [], []) for i, ps, t, d, sold in rows]
    return spark.createDataFrame(cells, RECALL_SCHEMA)


def _recall_sql() -> str:
    """All pairs of listings and recalls; the ordered fold over products is a list_reduce."""

    def quoted(words) -> str:
        return ", ".join(f"'{w}'" for w in words)

    def tokens(c: str) -> str:
        return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({quoted(recalls.STOP_WORDS)}))"

    def total(c: str) -> str:
        return f"coalesce(list_sum(list_transform({c}, lambda w: CASE WHEN w IN ({quoted(recalls.GENERIC)}) THEN 0.5::DOUBLE ELSE 1 END)), 0)"

    def overlap(c: str) -> str:
        return f"(CASE WHEN {total(c)} > 0 THEN {total(f'list_filter({c}, lambda w: list_contains(words, w))')} / {total(c)} ELSE 0 END)"

    feed = """SELECT * FROM (VALUES (1::BIGINT, ['Red Anvil Large', 'Old Bolt Kit'], 'Retailer recalls red anvil', 'The red anvil may break', true),
  (2, ['Blue Ring Small'], 'Blue ring recall', 'Rings in blue can fall', false)) t(recall_id, products, title, text, sold)"""
    return (
        LISTINGS
        + f""", feed AS ({feed}),
theirs AS (SELECT recall_id, list_transform(products, lambda p: {tokens("p")}) AS names, {tokens("title")} AS title_words, {tokens("text")} AS text_words, sold FROM feed),
own AS (SELECT pos, list_distinct({tokens("title")}) AS words, list_distinct({tokens("brand")}) AS brand_words FROM listings),
pairs AS (SELECT *, list_transform(names, lambda n: {{'o': {overlap("n")}::DOUBLE, 'hit': list_has_any(brand_words, n)}}) AS each,
  list_filter(flatten(list_transform(names, lambda n: n[1:2])), lambda w: w NOT IN ({quoted(recalls.GENERIC)})) AS first_words FROM own, theirs),
folded AS (SELECT *, list_reduce(each, lambda a, x: {{'o': CASE WHEN x.hit THEN least(1.0::DOUBLE, greatest(a.o, x.o) + 0.25::DOUBLE) ELSE greatest(a.o, x.o) END, 'hit': a.hit OR x.hit}}, {{'o': 0.0::DOUBLE, 'hit': false}}) AS p,
  {overlap("title_words")} AS t, {overlap("text_words")} AS d FROM pairs),
best AS (SELECT *, greatest(p.o, t, d * 0.5::DOUBLE)
  * CASE WHEN len(brand_words) > 0 AND len(first_words) > 0 AND NOT p.hit AND NOT list_has_any(brand_words, first_words) THEN 0.4::DOUBLE ELSE 1 END AS best FROM folded),
held AS (SELECT pos, recall_id, floor(CASE WHEN sold AND best >= 0.3::DOUBLE THEN least(1.0::DOUBLE, best + 0.1::DOUBLE) ELSE best END * 100 + 0.5) / 100 AS confidence FROM best)
SELECT * FROM held WHERE confidence >= 0.3"""
    )


@query("recall_matches", _recall_sql())
def recall_matches(spark, sf_dir):
    """Listings that fit a recall (P9, P11, P12, J7, T9); the fold over products is ordered."""
    return recalls.match_recalls(listings(spark, sf_dir), recall_feed(spark), 0.3).select("pos", "recall_id", "confidence")


@query("text_sentiment")
def text_sentiment(spark, sf_dir):
    """Sentiment of all documents by a model learned from the labelled ones that are not held out, and stars that contradict it.

    Positive means good and not toxic; a fifth is held out. Texts never meet labels: hashed words do for the fit, scores do for the result.
    """
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.bool_and((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 2, F.lit(False))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (1.0 + F.col("doc_id") % 5).alias("rating"), held_out.alias("held_out"))
    words = rows.where("NOT held_out").select("doc_id", sentiment.hashed_words(F.col("text")).alias("places"))
    weights = sentiment.fit(words.join(labels.hint("merge"), F.col("doc_id") == F.col("id")).select("places", "target"))
    found = sentiment.scored(rows, weights, ("doc_id", "rating", "held_out")).join(labels.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    said = found.withColumn("s", sentiment.sentiment(F.col("positive"))).withColumn("m", sentiment.mismatch(F.col("s"), F.col("rating")))
    return said.select("doc_id", "held_out", "target", "rating", "s.label", half_up(F.col("s.score"), 4).alias("score"), "m.deduction", "m.reason")


@query("sentiment_accuracy")
def sentiment_accuracy(spark, sf_dir):
    """How often the model agrees with the labels it learned from and with those held out, beside the share of the commoner label."""
    rows = text_sentiment(spark, sf_dir).where("target IS NOT NULL")
    return rows.groupBy("held_out").agg(
        F.count("*").alias("n"), half_up(F.avg(((F.col("label") == "POSITIVE") == F.col("target")).cast("int")), 4).alias("accuracy"),
        half_up(F.greatest(F.avg(F.col("target").cast("int")), F.avg((~F.col("target")).cast("int"))), 4).alias("commoner"),
    )


BUSY = """WITH r AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'hot' ELSE l_orderkey::VARCHAR END AS asin, l_orderkey * 8 + l_linenumber AS idx, 1 + floor((l_quantity - 1) / 10) AS rating,
  epoch_us(o_orderdate::TIMESTAMP) + l_linenumber * (l_orderkey % 5) * 108000000000 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "busy_items",
    TEMPORAL.replace(REVIEWS, BUSY).replace("rec AS (SELECT DISTINCT a.asin FROM o a JOIN o b ON a.asin = b.asin AND b.k > a.k AND b.t <= a.t + 172800000000 AND b.rating = 5 WHERE a.rating <= 2 GROUP BY a.asin, a.k HAVING count(*) >= 3)",
        "rec AS (SELECT DISTINCT asin FROM (SELECT asin, rating, count(*) FILTER (rating = 5) OVER (PARTITION BY asin ORDER BY t RANGE BETWEEN CURRENT ROW AND 172800000000 FOLLOWING) - count(*) FILTER (rating = 5) OVER (PARTITION BY asin, t ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS fives FROM r) WHERE rating <= 2 AND fives >= 3)")
    + """, w AS (SELECT asin, max(n)::BIGINT AS most FROM (SELECT asin, count(*) OVER (PARTITION BY asin ORDER BY t RANGE BETWEEN CURRENT ROW AND 604800000000 FOLLOWING) AS n FROM r WHERE t > 0) GROUP BY asin)
SELECT asin, n >= 2 AND burst AS burst, n >= 2 AND asin IN (FROM rec) AS recovery, n >= 2 AND week AS one_week,
  (CASE WHEN n >= 2 THEN least(30, burst::INT * 15 + (asin IN (FROM rec))::INT * 20 + week::INT * 10) ELSE 0 END)::INT AS temporal_deduction, most FROM g JOIN w USING (asin)""",
)
def busy_items(spark, sf_dir):
    """Time patterns of items one of which has over a quarter of all reviews, the others the lines of one order: bursts, recoveries and single weeks occur and do not."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    hours = F.col("l_linenumber") * (F.col("l_orderkey") % 5) * 30
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("hot")).otherwise(F.col("l_orderkey").cast("string")).alias("asin"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_idx"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"), F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + hours * 3_600_000_000).alias("ts"),
    )
    weeks = review_scores.densest_week(rows).select(F.col("asin").alias("k"), "most")
    return review_scores.temporal_patterns(rows).join(weeks, F.col("asin") == F.col("k")).drop("k")
