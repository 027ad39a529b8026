"""Topics by the whole dictionary in sentences of generated reviews: four sentences of fourteen for each order line, joined to a text that Spark cuts again.

The SQL knows the sentences and looks for every keyword in them; ratings are also stated in texts, so that they replace a reviewer's own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topics
from ..sources.tables import reviews
from .registry import query

SENTENCES = (
    "The quality is great.", "Shipping was terrible and the box came late.", "I would have given 5 stars except for the shipping.", "Battery life is short, and it is very loud!", "It fell apart two months later.",
    "Dr. Miller said it was easy to use.", "Worth every cent at 4.5 dollars.", "The size runs small... too tight!", "Color and design look beautiful.", "It works with my adapter.", "Customer service gave a refund.",
    "My fault, I assumed too much.", "Nothing else to say?", "It's a 4 star product but the delivery was slow.",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _topic_case(name: str, words: tuple[str, ...]) -> str:
    return f"CASE WHEN {' OR '.join(f'contains(low, {_quoted(w)})' for w in words)} THEN '{name}' END"


_IMPLIED = "coalesce(" + ", ".join(f"CASE WHEN try_cast(regexp_extract(body, {_quoted(p)}, 1) AS INT) BETWEEN 1 AND 5 THEN regexp_extract(body, {_quoted(p)}, 1)::INT END" for p in topics.IMPLIED) + ")"
REVIEWED = f"""WITH d(k, s) AS (VALUES {", ".join(f"({k}, {_quoted(s)})" for k, s in enumerate(SENTENCES))}),
t AS MATERIALIZED (SELECT k, s, CASE WHEN len(g) = 0 THEN ['{topics.FALLBACK}'] ELSE g END AS topics FROM (SELECT k, s, list_filter([{", ".join(_topic_case(n, w) for n, w in topics.TOPICS.items())}], lambda x: x IS NOT NULL) AS g FROM (SELECT *, lower(s) AS low FROM d))),
r AS (SELECT *, row_number() OVER () AS rid FROM (SELECT l_partkey::VARCHAR AS asin, l_orderkey * 8 + l_linenumber AS idx, max(1 + floor((l_quantity - 1) / 10)) AS rating, max(l_shipdate::TIMESTAMP) AS ts FROM lineitem GROUP BY 1, 2)),
n AS (SELECT *, [idx % 14, idx // 14 % 14, idx // 196 % 14, idx // 2744 % 14] AS of FROM r),
b AS (SELECT *, (SELECT s FROM d WHERE k = of[1]) || ' ' || (SELECT s FROM d WHERE k = of[2]) || ' ' || (SELECT s FROM d WHERE k = of[3]) || ' ' || (SELECT s FROM d WHERE k = of[4]) AS body FROM n),
s AS (SELECT asin, idx, rid, rating, ts, {_IMPLIED} AS implied, unnest(of) AS k, unnest([0, 1, 2, 3]) AS place FROM b),
g AS (SELECT s.*, t.topics, 1.0::DOUBLE / count(*) OVER (PARTITION BY rid) AS weight FROM s JOIN t USING (k)), x AS (SELECT *, unnest(topics) AS topic, generate_subscripts(topics, 1) AS j FROM g)"""


def _reviewed(spark, sf_dir):
    """asin, review_idx, rating, ts, text of each order line. Dealt by item once: nothing after that is shuffled, and a review is smaller than its topics."""
    rows = reviews(spark, sf_dir).select("asin", "review_idx", "rating", "ts").repartition("asin").groupBy("asin", "review_idx").agg(F.max("rating").alias("rating"), F.max("ts").alias("ts"))  # a few lines share their numbers
    said = F.array(*(F.lit(s) for s in SENTENCES))
    each = [F.get(said, (F.floor(F.col("review_idx") / size) % len(SENTENCES)).cast("int")) for size in (1, 14, 196, 2744)]
    return rows.withColumn("text", F.concat_ws(" ", *each))


@query(
    "dictionary_topics",
    REVIEWED + """, n2 AS (SELECT asin, topic, floor(sum(weight * rating) / sum(weight) * 10 + 0.5) / 10 AS avg_rating, count(DISTINCT idx)::BIGINT AS review_mentions, count(*)::BIGINT AS sentence_mentions FROM x GROUP BY asin, topic)
SELECT *, CASE WHEN avg_rating >= 4 THEN 'positive' WHEN avg_rating >= 3 THEN 'mixed' ELSE 'negative' END AS sentiment FROM n2""",
)
def dictionary_topics(spark, sf_dir):
    """The twelve topics in the sentences of reviews."""
    return topics.topic_scores_of_reviews(topics.review_topics(_reviewed(spark, sf_dir)))


@query(
    "stated_ratings",
    REVIEWED + """, p AS (SELECT asin, idx, any_value(rating) AS rating, any_value(implied) AS implied, bool_or(list_has_any(topics, ['shipping-delivery'])) AS dropped, sum(CASE WHEN NOT list_has_any(topics, ['shipping-delivery']) THEN weight END) AS w FROM g GROUP BY asin, idx)
SELECT asin, floor(sum(CASE WHEN dropped THEN coalesce(implied, rating) ELSE rating END * w) / sum(w) * 100 + 0.5) / 100 AS adjusted_rating, count(*)::BIGINT AS used FROM p WHERE w > 0 GROUP BY asin""",
)
def stated_ratings(spark, sf_dir):
    """Ratings without what is said on shipping; where that was dropped, a rating that the text states stands for the reviewer's."""
    return topics.adjusted_ratings_of_reviews(topics.review_topics(_reviewed(spark, sf_dir), ("shipping-delivery",)))


@query(
    "dictionary_trends",
    REVIEWED + """, q AS (SELECT asin, topic, date_trunc('quarter', ts) AS q, sum(weight * rating) / sum(weight) AS score FROM x GROUP BY 1, 2, 3), z AS (SELECT *, dense_rank() OVER (PARTITION BY asin ORDER BY q DESC) AS k FROM q),
y AS (SELECT asin, topic, max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END) AS dif FROM z WHERE k <= 2 GROUP BY asin, topic)
SELECT asin, topic, CASE WHEN dif > 0.5 THEN 'rising' WHEN dif < -0.5 THEN 'falling' WHEN dif IS NOT NULL THEN 'stable' END AS trend FROM y""",
)
def dictionary_trends(spark, sf_dir):
    """Topics that rise, fall or hold between the last two quarters."""
    return topics.trends(topics.quarter_scores_of_reviews(topics.review_topics(topics.recent_quarters(_reviewed(spark, sf_dir)))))


@query(
    "dictionary_primary",
    REVIEWED + ", c AS (SELECT asin, idx, topic, count(*) AS n, min(place * 100 + j) AS seen FROM x GROUP BY asin, idx, topic) SELECT asin, idx AS review_idx, topic AS \"primary\" FROM c QUALIFY row_number() OVER (PARTITION BY asin, idx ORDER BY n DESC, seen) = 1",
)
def dictionary_primary(spark, sf_dir):
    """The leading topic of each review."""
    return topics.review_topics(_reviewed(spark, sf_dir)).select("asin", "review_idx", F.get("found", F.lit(0))["topic"].alias("primary"))
