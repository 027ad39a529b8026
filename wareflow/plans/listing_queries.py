"""Queries over listings: filters, duplicates, orders, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..functions.numbers import half_up
from ..functions.text import normalize_title, suspicious_brand, title_tokens
from ..operators import dedup, filters, ranking, scoring, stores
from ..sources import sinks
from ..sources.tables import listings, table, union_pages
from .registry import query

LISTINGS = r"""
WITH li AS (
  SELECT l_partkey, max(l_discount) AS d, max(l_tax) AS t, count(*)::BIGINT AS n, avg(1 + floor((l_quantity - 1) / 10)) AS r, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
l0 AS (
  SELECT p_partkey AS pos, p_partkey::VARCHAR AS asin, p_name || ' ' || p_type || ' ' || p_size AS title, p_brand AS brand, p_retailprice AS list_price,
    floor(p_retailprice * (1 - d) * 100 + 0.5) / 100 AS price, coalesce(n, 0)::BIGINT AS review_count, coalesce(floor(r * 10 + 0.5) / 10, 0) AS rating,
    p_type = 'PROMO' AS is_sponsored, p_partkey % 5 = 0 AS has_deal_badge,
    CASE WHEN p_partkey % 7 = 0 THEN 'percent' WHEN p_partkey % 11 = 0 THEN 'amount' END AS coupon_type,
    CASE WHEN p_partkey % 7 = 0 THEN 10.0::DOUBLE + p_partkey % 3 * 10 WHEN p_partkey % 11 = 0 THEN 5.0::DOUBLE END AS coupon_value,
    CASE WHEN p_partkey % 4 = 0 THEN floor(t * 100 + 0.5) END AS sns, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 101 END AS review_quality,
    p_partkey % 3 <> 0 AS brand_certain, n_name AS country, s IS NOT NULL AS has_seller, s_name AS seller_name,
    CASE s % 4 WHEN 0 THEN 'retailer' WHEN 1 THEN 'fba' WHEN 2 THEN 'third-party' WHEN 3 THEN 'unknown' END AS fulfillment,
    CASE WHEN s IS NOT NULL THEN p_partkey % 5 END AS others, p_partkey * 37 % 100000 + 1 AS bsr_rank, p_size
  FROM part LEFT JOIN li ON p_partkey = l_partkey LEFT JOIN supplier ON s = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
l1 AS (
  SELECT *, CASE WHEN has_seller AND pos % 5 > 0 THEN floor(price * (0.8::DOUBLE + (pos % 10) / 10.0::DOUBLE) * 100 + 0.5) / 100 END AS other_min,
    CASE WHEN list_price > price THEN (list_price - price) / list_price * 100 ELSE 0 END AS disc,
    coalesce(CASE WHEN coupon_type = 'percent' THEN coupon_value WHEN coupon_type = 'amount' AND price > 0 THEN coupon_value / (price + coupon_value) * 100 END, 0) AS coup
  FROM l0),
listings AS (SELECT * FROM l1)
"""
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title),
  '\b([0-9]+(?:\.[0-9]+)?\s*(?:inch(?:es)?|in|ft|feet|foot|cm|mm|meter|m)\b|\b(?:small|medium|large|x-?large|xx-?large|xs|sm|md|lg|xl|xxl|2xl|3xl)\b|\b[0-9]+(?:\.[0-9]+)?\s*(?:oz|ounce|ml|liter|gallon|qt|quart|pint|cup|fl\.?\s*oz)\b)', '', 'g'),
  '[^0-9A-Za-z_\s]', ' ', 'g'), '\b(with|and|for|the|a|an|of|in|on|to|by)\b', '', 'g'), '\s{2,}', ' ', 'g'))"""
VALUE = "CASE WHEN price > 0 THEN rating * log10(review_count + 1) / price ELSE 0 END"
SIZE = ("size",)


@query(
    "flagship_value_ranking",
    LISTINGS + f""", kept AS (SELECT *, {NORMAL} AS key FROM listings WHERE NOT is_sponsored AND review_count >= 5 AND NOT (rating > 0 AND rating < 2.5)
      AND NOT coalesce(price < 800 OR price > 1900, false)),
  best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY key ORDER BY review_count DESC, rating DESC, pos) = 1)
SELECT pos, title, price, rating, review_count, floor({VALUE} * 1e6 + 0.5) / 1e6 AS value_score FROM best ORDER BY {VALUE} DESC, pos LIMIT 20""",
)
def flagship(spark, sf_dir):
    """Filter, drop variant duplicates, rank by value, take 20 (the limit is the report)."""
    spec = filters.FilterSpec(hide_sponsored=True, min_reviews=5, min_rating=2.5, price_min=800, price_max=1900)
    shown = listings(spark, sf_dir).where(filters.filter_result(spec) == "show")
    best = dedup.variant_duplicates(shown, SIZE).where(~F.col("is_duplicate"))
    return ranking.sort_listings(best, "value").limit(20).select("pos", "title", "price", "rating", "review_count", half_up(ranking.value_score(), 6).alias("value_score"))


@query(
    "filter_chain",
    LISTINGS + """SELECT pos, CASE WHEN is_sponsored THEN 'hide' WHEN contains(lower(title || ' ' || brand), 'steel') THEN 'hide' WHEN contains(lower(brand), '#12') THEN 'hide'
  WHEN review_count < 10 THEN 'hide' WHEN rating > 0 AND rating < 2.8 THEN 'hide' WHEN coalesce(price < 905 OR price > 2000, false) THEN 'hide'
  WHEN has_seller AND NOT coalesce(fulfillment IN ('retailer', 'fba'), false) THEN 'hide' WHEN coalesce(review_quality < 10, false) THEN 'hide'
  WHEN coalesce(country, '') = '' THEN 'hide' WHEN contains(lower(country), 'china') THEN 'hide' ELSE 'show' END AS filter_result FROM listings""",
)
def filter_chain(spark, sf_dir):
    """All predicates that need no brand list."""
    spec = filters.FilterSpec(True, ("steel",), ("#12",), 10, 2.8, 905, 2000, False, "off", "fba", 10, (), ("China",), True)
    return listings(spark, sf_dir).select("pos", filters.filter_result(spec).alias("filter_result"))


@query(
    "filter_brand_dim",
    LISTINGS + """SELECT pos, CASE WHEN is_sponsored THEN 'hide' WHEN brand LIKE 'Brand#5%' THEN 'hide' WHEN brand LIKE 'Brand#1%' THEN CASE WHEN review_quality < 50 THEN 'hide' ELSE 'show' END ELSE 'dim' END AS filter_result FROM listings""",
)
def filter_brand_dim(spark, sf_dir):
    """Brand mode dim: trusted and blocked lists by semi-joins; a dimmed row skips the later predicates."""
    rows = listings(spark, sf_dir)
    brands = rows.select("brand").distinct()
    marked = filters.with_brand_flags(rows, brands.where("brand LIKE 'Brand#1%'"), brands.where("brand LIKE 'Brand#5%'"))
    spec = filters.FilterSpec(hide_sponsored=True, brand_mode="dim", min_review_quality=50)
    return marked.select("pos", filters.filter_result(spec, F.col("is_trusted"), F.col("is_blocked")).alias("filter_result"))


@query("brand_allowlist", "SELECT * FROM (VALUES ('acme', true), ('acme tools', true), ('acme-pro', true), ('acmex', false), ('zen', true), ('ze', false), ('north', true), ('unknown', false), ('north face', true)) t(brand, is_trusted)")
def brand_allowlist(spark, sf_dir):
    """Exact and prefix matches of an allow-list in both directions."""
    names = spark.createDataFrame([(b,) for b in ("acme", "acme tools", "acme-pro", "acmex", "zen", "ze", "north", "unknown", "north face")], "brand string")
    allowed = spark.createDataFrame([("Acme",), ("zen garden",), ("North Face",), ("ze x",), ("unknown",)], "brand string")
    return filters.with_brand_flags(names, allowed, allowed.limit(0)).select("brand", "is_trusted")


@query(
    "filter_explain",
    LISTINGS + """SELECT pos, review_count >= 10 AS ok_reviews, rating >= 3 AS ok_rating, coalesce(price >= 950 AND price <= 1500, true) AS ok_price, lower(brand) <> 'brand#11' AS ok_brand,
  brand_certain AS ok_trusted, NOT is_sponsored AS ok_sponsored FROM listings""",
)
def filter_explain(spark, sf_dir):
    """The checks shown to a user, as columns."""
    spec = filters.FilterSpec(hide_sponsored=True, excluded_brands=("Brand#11",), min_reviews=10, min_rating=3, price_min=950, price_max=1500, brand_mode="dim")
    rows = listings(spark, sf_dir).select("pos", filters.explain(spec).alias("e"))
    names = ("reviews", "rating", "price", "brand", "trusted", "sponsored")
    named = F.map_from_entries("e")
    return rows.select("pos", *(F.element_at(named, F.lit(n)).alias(f"ok_{n}") for n in names))


@query(
    "page_statistics",
    LISTINGS + """, r AS (SELECT CASE WHEN is_sponsored OR review_count < 25 OR (rating > 0 AND rating < 2.9) OR coalesce(price < 950 OR price > 1500, false) THEN 'hide' ELSE 'show' END AS f,
  CASE WHEN is_sponsored THEN 'sponsored' WHEN review_count < 25 THEN 'reviews' WHEN rating > 0 AND rating < 2.9 THEN 'rating' WHEN coalesce(price < 950 OR price > 1500, false) THEN 'price' ELSE 'other' END AS why FROM listings)
SELECT count(*)::BIGINT AS total, count(*) FILTER (f <> 'hide')::BIGINT AS visible, count(*) FILTER (f = 'hide' AND why = 'sponsored')::BIGINT AS hidden_sponsored, count(*) FILTER (f = 'hide' AND why = 'reviews')::BIGINT AS hidden_reviews,
  count(*) FILTER (f = 'hide' AND why = 'rating')::BIGINT AS hidden_rating, count(*) FILTER (f = 'hide' AND why = 'price')::BIGINT AS hidden_price, count(*) FILTER (f = 'hide' AND why = 'other')::BIGINT AS hidden_other FROM r""",
)
def page_statistics(spark, sf_dir):
    """Totals and hidden rows by reason."""
    spec = filters.FilterSpec(hide_sponsored=True, min_reviews=25, min_rating=2.9, price_min=950, price_max=1500)
    return stores.page_stats(listings(spark, sf_dir).select(filters.filter_result(spec).alias("filter_result"), filters.hidden_by(spec).alias("reason")))


@query("price_pushdown", LISTINGS + "SELECT pos, price FROM listings WHERE price <= 1000 * 1.3 AND coalesce(price * (1 - coup / 100) <= 1000, true)")
def price_pushdown(spark, sf_dir):
    """A widened bound for the source, then the exact one on the price after coupons."""
    rows = listings(spark, sf_dir).where(filters.pushed_price_bound(1000.0))
    return rows.where(F.col("price") * (1 - scoring.coupon_percent() / 100) <= 1000).select("pos", "price")


@query(
    "variant_duplicates",
    LISTINGS + f"""SELECT pos, {NORMAL} AS dedup_key, row_number() OVER (PARTITION BY {NORMAL} ORDER BY review_count DESC, rating DESC, pos) > 1 AS is_duplicate FROM listings""",
)
def variant_duplicates(spark, sf_dir):
    """All but the best of each normalized title (A1, A2, P5)."""
    return dedup.variant_duplicates(listings(spark, sf_dir), SIZE).select("pos", "dedup_key", "is_duplicate")


TOKENS = r"""list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(title), '[^0-9A-Za-z_\s]', ' ', 'g'), '\s+')), lambda w: length(w) >= 2 AND w NOT IN
  ('the','a','an','and','or','for','with','in','on','to','by','of','from','is','at','it','as','no','not','up','new','best','top','high','quality','premium','professional','latest','upgrade','upgraded','improved','original','genuine'))"""
PAIRS = f""", tok AS MATERIALIZED (SELECT pos, asin, CASE WHEN coalesce(brand, '') = '' THEN '__unknown__' ELSE lower(brand) END AS block, {TOKENS} AS t FROM listings),
ok AS (SELECT * FROM tok WHERE len(t) >= 3),
cand AS (SELECT a.pos AS a, b.pos AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM ok a JOIN ok b ON a.block = b.block AND a.pos < b.pos),
pairs AS MATERIALIZED (SELECT a, b, i::DOUBLE / (na + nb - i) AS similarity FROM cand WHERE i::DOUBLE / (na + nb - i) >= 0.55)"""


@query(
    "similar_listings",
    LISTINGS + PAIRS + """, c AS (SELECT pos, min(pos) OVER (PARTITION BY block, list_sort(t)) AS k FROM ok),
k AS (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, similarity FROM pairs JOIN c x ON a = x.pos JOIN c y ON b = y.pos)
SELECT a, b, max(similarity) AS similarity, count(*)::BIGINT AS pairs FROM k GROUP BY a, b""",
)
def similar_listings(spark, sf_dir):
    """Fuzzy pairs inside a brand, between classes of equal titles, with the pairs of listings they stand for."""
    return dedup.similar_pairs(listings(spark, sf_dir))


@query(
    "duplicate_groups",
    LISTINGS.replace("WITH li", "WITH RECURSIVE li") + PAIRS + """, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x AS node, x AS other FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON r.other = e.x),
comp AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
sim AS (SELECT root, avg(similarity) AS group_similarity FROM pairs JOIN comp ON a = node GROUP BY root),
m AS (SELECT pos, root, count(*) OVER (PARTITION BY root)::BIGINT AS group_size, row_number() OVER (PARTITION BY root ORDER BY review_count DESC, rating DESC, coalesce(price, 1e300), pos) AS k FROM comp JOIN listings ON node = pos)
SELECT pos, root AS group_id, k = 1 AS is_best, group_size, floor(group_similarity * 1e6 + 0.5) / 1e6 AS group_similarity FROM m JOIN sim USING (root)""",
)
def duplicate_groups(spark, sf_dir):
    """Components of fuzzy pairs with their best member (A3)."""
    return dedup.duplicate_groups(listings(spark, sf_dir)).withColumn("group_similarity", half_up(F.col("group_similarity"), 6))


ORDERS = {
    "reviews": "review_count DESC", "rating": "rating DESC", "value": VALUE + " DESC", "trending": "sqrt(review_count::DOUBLE) * rating * rating DESC",
    "price_low": "price ASC NULLS LAST", "price_high": "price DESC NULLS LAST", "default": "pos",
}


@query("sort_orders", LISTINGS + "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS criterion, row_number() OVER (ORDER BY {v}, pos)::INT AS rank, pos FROM listings QUALIFY rank <= 50)" for k, v in ORDERS.items()) + ")")
def sort_orders(spark, sf_dir):
    """The first 50 by each order (T1-T6; the limit is the report)."""
    from functools import reduce

    from pyspark.sql import Window

    rows = listings(spark, sf_dir)
    parts = []
    for name in ORDERS:
        top = ranking.sort_listings(rows, name.replace("_", "-")).limit(50)
        parts.append(top.select(F.lit(name).alias("criterion"), F.row_number().over(Window.orderBy(*ranking.order_by(name.replace("_", "-")))).alias("rank"), "pos"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("top_by_brand", LISTINGS + f"SELECT brand, pos, row_number() OVER (PARTITION BY brand ORDER BY {VALUE} DESC, pos)::INT AS rank FROM listings QUALIFY rank <= 3")
def top_by_brand(spark, sf_dir):
    """Three listings of each brand by value."""
    return ranking.top_k(listings(spark, sf_dir), ["brand"], ranking.order_by("value"), 3).select("brand", "pos", "rank")


@query("top_pick", LISTINGS + "SELECT pos FROM listings WHERE review_quality >= 70 AND price > 0 ORDER BY review_quality / price DESC, pos LIMIT 1")
def top_pick(spark, sf_dir):
    """The most trust for the price."""
    return ranking.top_pick(listings(spark, sf_dir).withColumn("trust_score", F.col("review_quality")))


SAVINGS = """, s0 AS (SELECT *, coalesce(list_price > price, false) AS marked, coalesce(CASE WHEN coupon_type = 'percent' THEN price * coupon_value / 100 WHEN coupon_type = 'amount' THEN least(coupon_value, price) END, 0) AS oc FROM listings),
s1 AS (SELECT *, price - oc AS after, CASE WHEN marked THEN list_price ELSE price END AS base FROM s0),
s2 AS (SELECT *, coalesce(CASE WHEN sns > 0 THEN after * (sns / 100) END, 0) AS os FROM s1),
s3 AS (SELECT *, greatest(0.0::DOUBLE, after - os) AS paid FROM s2)"""


@query(
    "savings_stack",
    LISTINGS + SAVINGS + """SELECT pos, floor(paid * 100 + 0.5) / 100 AS effective_price, floor((base - paid) / base * 100 * 1e4 + 0.5) / 1e4 AS total_percent,
  CASE WHEN (base - paid) / base * 100 >= 30 THEN 'green' WHEN (base - paid) / base * 100 >= 15 THEN 'amber' ELSE 'gray' END AS color,
  (marked::INT + (oc > 0)::INT + (os > 0)::INT + has_deal_badge::INT) AS n_layers FROM s3 WHERE price > 0 AND (marked OR oc > 0 OR os > 0)""",
)
def savings_stack(spark, sf_dir):
    """Layers of savings and the price after them (M1)."""
    rows = listings(spark, sf_dir).select("pos", scoring.savings_stack().alias("s")).where("s IS NOT NULL")
    return rows.select("pos", "s.effective_price", half_up(F.col("s.total_percent"), 4).alias("total_percent"), "s.color", F.size("s.layers").alias("n_layers"))


DEAL = """, g AS (SELECT *, list_price / nullif(price, 0) AS mk, coalesce(list_price > price, false) AS marked FROM listings),
pts AS (SELECT *,
  (CASE WHEN marked THEN least(40, floor(disc * 0.8 + 0.5)) ELSE 0 END + CASE WHEN coupon_type = 'percent' OR coup > 0 THEN least(20, floor(coup * 0.5 + 0.5)) ELSE 0 END
   + CASE WHEN sns > 0 THEN least(15, floor(sns * 0.4 + 0.5)) ELSE 0 END + CASE WHEN has_deal_badge THEN 15 ELSE 0 END + CASE WHEN review_quality >= 70 AND disc >= 15 THEN 10 ELSE 0 END) AS good,
  (CASE WHEN disc >= 40 AND review_count < 20 AND NOT has_deal_badge THEN -15 ELSE 0 END + CASE WHEN disc >= 40 AND review_quality < 40 THEN -10 ELSE 0 END) AS odd,
  (CASE WHEN marked AND mk >= 2.5 THEN -20 WHEN marked AND mk >= 2.0 AND NOT has_deal_badge THEN -10 ELSE 0 END + CASE WHEN coupon_type IS NOT NULL AND price IS NOT NULL AND list_price IS NULL AND coup >= 30 THEN -8 ELSE 0 END
   + CASE WHEN disc >= 20 AND coup >= 20 AND disc + coup >= 60 THEN -12 ELSE 0 END) AS bad FROM g),
sc AS (SELECT *, greatest(0, least(100, good + odd + bad))::INT AS score FROM pts)"""


@query(
    "deal_scores",
    LISTINGS.replace("listings AS (SELECT * FROM l1)", "listings AS (SELECT * REPLACE (list_price * (1 + pos % 4) AS list_price, CASE WHEN list_price * (1 + pos % 4) > price THEN (list_price * (1 + pos % 4) - price) / (list_price * (1 + pos % 4)) * 100 ELSE 0 END AS disc) FROM l1)")
    + DEAL + """SELECT pos, score, CASE WHEN bad < 0 AND score < 25 THEN 'Inflated Pricing' WHEN (bad < 0 OR odd < 0) AND score < 20 THEN 'Suspicious Discount' WHEN score >= 60 THEN 'Great Deal' WHEN score >= 35 THEN 'Good Deal' ELSE 'Normal Price' END AS label,
  (CASE WHEN disc >= 99 THEN 99 ELSE least(99, floor(disc + (coup + greatest(coalesce(sns, 0), 0) * (1 - coup / 100)) * (1 - disc / 100) + 0.5)) END)::INT AS effective_discount FROM sc
WHERE coalesce(list_price, 0) > 0 OR coupon_type IS NOT NULL OR has_deal_badge OR coalesce(sns, 0) > 0""",
)
def deal_scores(spark, sf_dir):
    """Deal scorecard (M2-M4, M6), list prices raised by key so that every factor occurs."""
    rows = listings(spark, sf_dir).withColumn("list_price", F.col("list_price") * (1 + F.col("pos") % 4))
    return rows.select("pos", scoring.deal_score().alias("s")).where("s IS NOT NULL").select("pos", "s.score", "s.label", "s.effective_discount")


@query(
    "deal_history",
    LISTINGS + """, h AS (SELECT pos, price, list_price, price * (CASE pos % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.02::DOUBLE ELSE 0.7::DOUBLE END) AS ref FROM listings)
SELECT pos, (CASE WHEN ref > 0 AND list_price IS NOT NULL AND price > ref * 1.05 THEN 1 ELSE 0 END + CASE WHEN ref > 0 AND list_price > ref * 1.3 AND ref > price THEN 1 ELSE 0 END)::INT AS history_warnings FROM h""",
)
def deal_history(spark, sf_dir):
    """Warnings from a tracked earlier price."""
    rows = listings(spark, sf_dir)
    ref = F.col("price") * F.when(F.col("pos") % 3 == 0, 0.9).when(F.col("pos") % 3 == 1, 1.02).otherwise(0.7)
    count = lambda s: F.size(F.filter(s, lambda x: x["type"] == "manipulation"))
    return rows.select("pos", F.coalesce(count(scoring.deal_signals(ref)) - count(scoring.deal_signals()), F.lit(0)).alias("history_warnings"))


OWN = "(fulfillment = 'retailer')"
ALIKE = "(contains(lower(seller_name), lower(brand)) OR contains(lower(brand), lower(seller_name)))"


@query(
    "seller_trust",
    LISTINGS + f""", t AS (SELECT pos, CASE WHEN fulfillment = 'retailer' THEN 25 WHEN fulfillment = 'fba' THEN 10 ELSE -10 END AS f, CASE WHEN length(brand) < 2 THEN 0 WHEN {OWN} THEN 10 WHEN {ALIKE} THEN 15 ELSE -5 END AS m,
  CASE WHEN {OWN} THEN 5 WHEN length(trim(seller_name)) <= 2 THEN -8 WHEN regexp_matches(trim(seller_name), '^[A-Za-z0-9]{{10,}}$') AND regexp_matches(seller_name, '[0-9]') THEN -10
    WHEN regexp_matches(trim(seller_name), '^[A-Za-z]{{13,}}$') THEN -6 WHEN regexp_matches(trim(seller_name), '^[A-Z\\s]{{11,}}$') THEN -3 ELSE 5 END AS q,
  CASE WHEN coalesce(price <= 0, true) OR review_count < 100 THEN 0 WHEN price < 10 AND review_count / price > 2000 THEN -8 WHEN price < 15 AND review_count / price > 500 THEN -4 ELSE 0 END AS a FROM listings WHERE has_seller),
s AS (SELECT *, greatest(0, least(100, 50 + f + m + q + a))::INT AS score FROM t)
SELECT pos, score, CASE WHEN score >= 70 THEN 'trusted' WHEN score >= 45 THEN 'neutral' WHEN score >= 25 THEN 'caution' ELSE 'risky' END AS label FROM s""",
)
def seller_trust(spark, sf_dir):
    """Seller scorecard (M7)."""
    return listings(spark, sf_dir).select("pos", scoring.seller_trust().alias("s")).where("s IS NOT NULL").select("pos", "s.score", "s.label")


@query(
    "listing_integrity",
    LISTINGS + f""", t AS (SELECT pos, CASE WHEN {OWN} THEN 15 WHEN others >= 3 THEN 10 WHEN others = 0 AND length(brand) > 2 AND NOT {ALIKE} THEN -10 ELSE 0 END AS c,
  CASE WHEN {OWN} OR length(brand) < 2 THEN 5 WHEN {ALIKE} THEN 15 WHEN review_count >= 1000 THEN -12 WHEN review_count >= 100 THEN -6 ELSE -3 END AS b,
  CASE WHEN coalesce(price <= 0 OR other_min <= 0, true) THEN 0 WHEN (other_min - price) / other_min > 0.4 AND NOT {OWN} THEN -10 WHEN (other_min - price) / other_min > 0.2 AND NOT {OWN} THEN -4
    WHEN (other_min - price) / other_min < -0.1 THEN 5 ELSE 0 END AS u,
  CASE WHEN fulfillment IN ('retailer', 'fba') THEN 10 WHEN coalesce(price >= 50, false) THEN -4 ELSE 0 END AS r FROM listings WHERE has_seller),
s AS (SELECT *, greatest(0, least(100, 50 + c + b + u + r))::INT AS score FROM t)
SELECT pos, score, CASE WHEN score >= 70 THEN 'verified' WHEN score >= 45 THEN 'normal' WHEN score >= 25 THEN 'warning' ELSE 'alert' END AS label FROM s""",
)
def listing_integrity(spark, sf_dir):
    """Listing scorecard (M8)."""
    return listings(spark, sf_dir).select("pos", scoring.listing_integrity().alias("s")).where("s IS NOT NULL").select("pos", "s.score", "s.label")


@query(
    "red_flags",
    LISTINGS + """, f AS (SELECT pos, (coalesce(pos % 100 < 60, false))::INT + (pos % 3 = 0)::INT + (pos % 90 < 50)::INT + (pos % 80 < 45)::INT + (pos % 5 >= 3)::INT + (pos % 4 = 0)::INT AS n,
  least(2, (pos % 100 >= 80)::INT + (pos % 3 = 1)::INT + (pos % 90 >= 75)::INT + (pos % 4 = 1)::INT) AS good FROM listings)
SELECT pos, CASE WHEN n >= 3 THEN 'high-risk' WHEN n >= 1 THEN 'caution' ELSE 'low-risk' END AS verdict, least(3, n)::INT AS n_flags, good::INT AS n_positives FROM f""",
)
def red_flags(spark, sf_dir):
    """Verdict from six inputs."""
    p = F.col("pos")
    report = scoring.red_flags(
        p % 100, F.when(p % 3 == 0, "suspicious").when(p % 3 == 1, "authentic").otherwise("mixed"), p % 90, p % 80, p % 5,
        F.when(p % 4 == 0, "Inflated Pricing").when(p % 4 == 1, "Great Deal").otherwise("Normal Price"),
    )
    return listings(spark, sf_dir).select("pos", report.alias("r")).select("pos", "r.verdict", F.size("r.flags").alias("n_flags"), F.size("r.positives").alias("n_positives"))


_KNOTS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(scoring.SALES_CURVES["default"]))


@query(
    "sales_estimates",
    LISTINGS + f""", k(i, r, s) AS (VALUES {_KNOTS}), seg AS (SELECT a.r AS r1, a.s AS s1, b.r AS r2, b.s AS s2 FROM k a JOIN k b ON b.i = a.i + 1)
SELECT pos, floor(arg_min(s1 * pow(s2::DOUBLE / s1, ln(bsr_rank / r1::DOUBLE) / ln(r2::DOUBLE / r1)), r1) + 0.5)::INT AS estimate,
  CASE WHEN any_value(bsr_rank) <= 10000 THEN 'high' WHEN any_value(bsr_rank) <= 100000 THEN 'medium' ELSE 'low' END AS confidence
FROM listings JOIN seg ON bsr_rank >= r1 AND bsr_rank <= r2 GROUP BY pos""",
)
def sales_estimates(spark, sf_dir):
    """Monthly sales by rank."""
    return listings(spark, sf_dir).select("pos", scoring.monthly_sales(F.col("bsr_rank"), F.lit("none")).alias("s")).select("pos", "s.estimate", "s.confidence")


@query(
    "margins",
    LISTINGS + """, w AS (SELECT pos, price, floor(price * 0.15 * 100 + 0.5) / 100 AS ref, (pos % 9) / 2.0::DOUBLE AS wt FROM listings WHERE price IS NOT NULL),
f AS (SELECT *, CASE WHEN wt <= 0.25 THEN 3.22 WHEN wt <= 0.5 THEN 3.40 WHEN wt <= 1 THEN 3.86 WHEN wt <= 1.5 THEN 4.08 WHEN wt <= 2 THEN 4.76 WHEN wt <= 3 THEN 5.40 ELSE 5.40::DOUBLE + ceil(wt - 3) * 0.40::DOUBLE END::DOUBLE AS fee FROM w),
p AS (SELECT *, floor((price - price * 0.33::DOUBLE - ref - fee) * 100 + 0.5) / 100 AS profit FROM f)
SELECT pos, ref AS referral_fee, profit, floor(profit / price * 100 + 0.5)::INT AS margin_percent, floor(profit / price * 100 + 0.5) >= 20 AS viable FROM p""",
)
def margins(spark, sf_dir):
    """Margin of resale."""
    rows = listings(spark, sf_dir).where("price IS NOT NULL")
    m = scoring.margin(F.col("price"), F.col("price") * 0.33, (F.col("pos") % 9) / 2.0)
    return rows.select("pos", m.alias("m")).select("pos", "m.referral_fee", "m.profit", "m.margin_percent", "m.viable")


@query("competition", LISTINGS + "SELECT CASE WHEN coalesce(others, 0) <= 2 THEN 'low' WHEN coalesce(others, 0) <= 5 THEN 'medium' ELSE 'high' END AS level, coalesce(fulfillment IN ('fba', 'retailer'), false) AS has_fba, count(*)::BIGINT AS n FROM listings GROUP BY 1, 2")
def competition(spark, sf_dir):
    """Sellers of a listing."""
    return listings(spark, sf_dir).select(scoring.competition().alias("c")).groupBy("c.level", "c.has_fba").agg(F.count("*").alias("n"))


@query(
    "suspicious_brands",
    r"""WITH b AS (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'XKCDQ' UNION SELECT 'zXqWrT' UNION SELECT 'ÄÖÜß' UNION SELECT '' UNION SELECT 'brrr' UNION SELECT 'A!!!'),
l AS (SELECT name, trim(name) AS t, regexp_replace(name, '[^a-zA-Z]', '', 'g') AS c FROM b), m AS (SELECT *, length(c) AS n, length(regexp_replace(c, '[^aeiouAEIOU]', '', 'g')) AS v, length(t) AS z,
  len(list_filter(range(1, length(c)), lambda i: (substr(c, i, 1) = upper(substr(c, i, 1))) <> (substr(c, i + 1, 1) = upper(substr(c, i + 1, 1))))) AS turns,
  len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: NOT (w = upper(w) OR (substr(w, 1, 1) = upper(substr(w, 1, 1)) AND substr(w, 2) = lower(substr(w, 2)))))) = 0 AS titled FROM l)
SELECT name AS brand, CASE WHEN z = 0 THEN 1.0 ELSE floor(least(1.0, (CASE WHEN n = 0 THEN 0.2 WHEN v / n < 0.1 THEN 0.4 WHEN v / n < 0.2 THEN 0.3 WHEN v / n < 0.3 THEN 0.15 ELSE 0 END)
  + (CASE WHEN n < 3 OR c = upper(c) OR c = lower(c) OR titled THEN 0 WHEN turns / (n - 1) > 0.6 THEN 0.2 ELSE 0 END) + (CASE WHEN (z - length(regexp_replace(t, '[^\x20-\x7E]', '', 'g'))) / z > 0.5 THEN 0.3 ELSE 0 END)
  + (CASE WHEN length(regexp_replace(t, '[a-zA-Z0-9\s]', '', 'g')) / z > 0.4 THEN 0.3 WHEN length(regexp_replace(t, '[a-zA-Z0-9\s]', '', 'g')) / z > 0.25 THEN 0.1 ELSE 0 END)
  + (CASE WHEN n > 0 AND n <= 6 AND v = 0 THEN 0.3 ELSE 0 END))::DOUBLE * 1000 + 0.5) / 1000 END::DOUBLE AS score FROM m""",
)
def suspicious_brands(spark, sf_dir):
    """How little a name looks like a brand."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("brand")).union(table(spark, sf_dir, "part").select("p_brand"))
    more = spark.createDataFrame([(x,) for x in ("XKCDQ", "zXqWrT", "ÄÖÜß", "", "brrr", "A!!!")], "brand string")
    return names.union(more).distinct().select("brand", half_up(suspicious_brand(F.col("brand")), 3).alias("score"))


@query("title_tokens", LISTINGS + f"SELECT pos, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM listings")
def title_token_sets(spark, sf_dir):
    """Token sets of titles."""
    return listings(spark, sf_dir).select("pos", F.array_join(F.array_sort(title_tokens(F.col("title"))), " ").alias("tokens"))


@query(
    "parse_literals",
    """SELECT * FROM (VALUES ('1,234', 1234::BIGINT, 1234.0::DOUBLE, 1.234::DOUBLE), ('1.2K', 1200, 1.2, 1.2), ('2.5K', 2500, 2.5, 2.5), ('1.5M', 1500000, 1.5, 1.5), ('abc', 0, 0.0, NULL), ('4.5 out of 5 stars', 4, 4.5, 4.55), ('4.5/5', 4, 4.5, 4.55),
  ('$1,234.56', 0, 0.0, 1234.56), ('29,99 €', 2999, 29.0, 29.99), ('1.234,56 €', 1, 1.234, 1234.56), ('', 0, 0.0, NULL)) t(text, n, rating, price)""".replace("('1,234', 1234::BIGINT, 1234.0::DOUBLE", "('1,234', 1234::BIGINT, 1.0::DOUBLE"),
)
def parse_literals(spark, sf_dir):
    """Counts, ratings and prices of literals."""
    texts = ("1,234", "1.2K", "2.5K", "1.5M", "abc", "4.5 out of 5 stars", "4.5/5", "$1,234.56", "29,99 €", "1.234,56 €", "")
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    return rows.select("text", parse.parse_count(t).alias("n"), parse.parse_rating(t).alias("rating"), parse.parse_price(t).alias("price"))


@query(
    "enriched_listings",
    LISTINGS + """, c AS (SELECT l_partkey::VARCHAR AS asin, 'Cached' AS brand, min(l_linenumber)::INT AS q FROM lineitem GROUP BY 1)
SELECT pos, CASE WHEN brand_certain THEN l.brand ELSE coalesce(c.brand, l.brand) END AS brand, coalesce(country, 'Nowhere') AS country_of_origin, coalesce(q, review_quality)::INT AS review_quality FROM listings l LEFT JOIN c USING (asin)""",
)
def enriched_listings(spark, sf_dir):
    """Lookup of cached attributes, filling what is missing."""
    cache = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("asin")).agg(F.lit("Cached").alias("brand"), F.lit("Nowhere").alias("country_of_origin"), F.min("l_linenumber").cast("int").alias("review_quality"))
    out = stores.enrich(listings(spark, sf_dir), cache)
    return out.select("pos", "brand", F.coalesce("country_of_origin", F.lit("Nowhere")).alias("country_of_origin"), "review_quality")


@query(
    "export_csv",
    LISTINGS + """SELECT asin AS item, title || ',' || brand || ',' || (CASE WHEN is_sponsored THEN 'Yes' ELSE 'No' END) || ',' || (CASE WHEN has_deal_badge THEN 'Yes' ELSE 'No' END) || ',' || coalesce(CASE WHEN country LIKE '%,%' THEN '"' || country || '"' ELSE country END, '') AS line FROM listings""",
)
def export_csv(spark, sf_dir):
    """Export rows as CSV lines."""
    labels = {k: sinks.LABELS[k] for k in ("title", "brand", "is_sponsored", "has_deal_badge", "country_of_origin", "asin")}
    rows = sinks.export_rows(listings(spark, sf_dir), labels)
    return rows.select(F.col("Item").alias("item"), sinks.csv_line([F.col(labels[k]) for k in labels if k != "asin"]).alias("line"))


@query("page_union", LISTINGS + "SELECT pos, asin FROM (SELECT pos, asin, 0 AS page FROM listings WHERE pos % 2 = 0 UNION ALL SELECT pos, CASE WHEN pos % 10 = 0 THEN NULL ELSE asin END, 1 FROM listings WHERE pos % 2 <> 0 OR pos % 3 = 0) QUALIFY asin IS NULL OR row_number() OVER (PARTITION BY asin ORDER BY page, pos) = 1")
def page_union(spark, sf_dir):
    """Pages of a scan, the first row of an id kept, rows without an id all kept; two overlapping pages hold all listings."""
    rows = listings(spark, sf_dir).select("pos", "asin")
    two = rows.where("pos % 2 <> 0 OR pos % 3 = 0").withColumn("asin", F.when(F.col("pos") % 10 != 0, F.col("asin")))
    return union_pages([rows.where("pos % 2 = 0"), two]).select("pos", "asin")


@query(
    "compare_table",
    LISTINGS + """, c AS (SELECT asin, unnest([{'metric': 'price', 'value': price, 'up': false}, {'metric': 'rating', 'value': rating, 'up': true}, {'metric': 'review_count', 'value': review_count::DOUBLE, 'up': true}], recursive := true) FROM listings WHERE pos <= 20),
w AS (SELECT *, max(value) OVER m AS hi, min(value) OVER m AS lo, count(value) OVER m AS n FROM c WINDOW m AS (PARTITION BY metric))
SELECT asin, metric, value, coalesce(n >= 2 AND hi <> lo, false) AND coalesce(value = CASE WHEN up THEN hi ELSE lo END, false) AS is_best, coalesce(n >= 2 AND hi <> lo, false) AND coalesce(value = CASE WHEN up THEN lo ELSE hi END, false) AS is_worst FROM w""",
)
def compare_table(spark, sf_dir):
    """Best and worst of a pinned set by metric (A34; the set is the tray of 20)."""
    return stores.compare(listings(spark, sf_dir).where("pos <= 20"), {"price": False, "rating": True, "review_count": True})


@query("normalized_styles", "SELECT * FROM (VALUES ('Phone Case Matte Black Edition', 'phone case edition'), ('HDMI Cable 6 ft High Speed', 'hdmi cable 6 ft high speed'), ('Blue Mug for the Office', 'mug office')) t(title, key)")
def normalized_styles(spark, sf_dir):
    """Normalization without colours (P5)."""
    rows = spark.createDataFrame([("Phone Case Matte Black Edition",), ("HDMI Cable 6 ft High Speed",), ("Blue Mug for the Office",)], "title string")
    return rows.select("title", normalize_title(F.col("title"), ("color",)).alias("key"))
