"""Queries over events, orders and pages: counters, histories, alerts, budgets, page fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..functions.numbers import half_up
from ..operators import filters, scoring, stores
from ..sources import html, sinks
from ..sources.tables import table
from .registry import query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _prices(spark, sf_dir):
    """Event values as prices of a user's item."""
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("asin"), "ts", F.col("value").alias("price"), "event_id")


@query(
    "monthly_counters",
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS counter, count(*)::BIGINT AS amount FROM orders GROUP BY 1, 2), m AS (SELECT DISTINCT month FROM o ORDER BY month DESC LIMIT 12)
SELECT month, counter, amount FROM o WHERE month IN (FROM m) UNION ALL SELECT 'all', counter, sum(amount)::BIGINT FROM o GROUP BY counter""",
)
def monthly_counters(spark, sf_dir):
    """Counters of the last months and of all time."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("counter"), F.lit(1).cast("long").alias("amount"))
    return stores.monthly_counters(rows).select("month", "counter", "amount")


@query(
    "usage_metrics",
    """WITH w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT user_id, count(*)::BIGINT AS uses, count(DISTINCT event_type)::BIGINT AS breadth, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS retention_days, max(n)::BIGINT AS busiest_week FROM w GROUP BY user_id""",
)
def usage_metrics(spark, sf_dir):
    """Uses, breadth, retention, rolling week."""
    return stores.usage(_events(spark, sf_dir).withColumnRenamed("event_type", "feature"))


@query(
    "price_alerts",
    """WITH p AS (SELECT user_id::VARCHAR AS asin, ts, value AS price, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), t AS (SELECT user_id::VARCHAR AS asin, avg(value) * 0.5 AS target FROM events GROUP BY 1)
SELECT asin, epoch_us(ts) AS ts_us, price FROM p JOIN t USING (asin) WHERE price <= target AND price < before""",
)
def price_alerts(spark, sf_dir):
    """Price drops under a target (F19, ST6 in batch form)."""
    prices = _prices(spark, sf_dir)
    targets = prices.groupBy("asin").agg((F.avg("price") * 0.5).alias("target"))
    return stores.price_alerts(prices, targets).select("asin", F.unix_micros("ts").alias("ts_us"), "price")


@query(
    "price_history",
    """WITH p AS (SELECT user_id::VARCHAR AS asin, ts, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 30), s AS (SELECT *, min(price) OVER w AS lo, max(price) OVER w AS hi FROM p WINDOW w AS (PARTITION BY asin))
SELECT asin, epoch_us(ts) AS ts_us, price, floor((price - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 1e6 + 0.5) / 1e6 AS scaled FROM s""",
)
def price_history(spark, sf_dir):
    """The last 30 snapshots, scaled."""
    return stores.price_history(_prices(spark, sf_dir)).select("asin", F.unix_micros("ts").alias("ts_us"), "price", half_up(F.col("scaled"), 6).alias("scaled"))


@query(
    "price_progress",
    """WITH p AS (SELECT user_id, arg_min(value, ts) AS f, arg_max(value, ts) AS l, avg(value) * 0.8::DOUBLE AS t FROM events GROUP BY user_id)
SELECT user_id, l - f AS delta, CASE WHEN f - t > 0 THEN least(100, floor((f - l) / (f - t) * 100 + 0.5)) WHEN l <= t THEN 100 ELSE 0 END::INT AS progress FROM p""",
)
def price_progress(spark, sf_dir):
    """Change since the first price and progress to a target."""
    p = _events(spark, sf_dir).groupBy("user_id").agg(F.min_by("value", "ts").alias("f"), F.max_by("value", "ts").alias("l"), (F.avg("value") * 0.8).alias("t"))
    return p.select("user_id", (F.col("l") - F.col("f")).alias("delta"), stores.price_progress(F.col("f"), F.col("l"), F.col("t")).cast("int").alias("progress"))


@query(
    "price_as_of",
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT user_id::VARCHAR AS asin, epoch_us(e.ts) AS at_us, p.value AS price FROM e ASOF LEFT JOIN p USING (user_id, ts)""".replace("ASOF LEFT JOIN p USING (user_id, ts)", "ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts").replace("SELECT user_id::VARCHAR AS asin, epoch_us(e.ts)", "SELECT e.user_id::VARCHAR AS asin, epoch_us(e.ts)"),
)
def price_as_of(spark, sf_dir):
    """The last price at or before an event (as-of join, J14)."""
    e = _events(spark, sf_dir).select("event_type", F.col("user_id").cast("string").alias("asin"), "ts", "value")
    out = stores.price_as_of(e.where("event_type = 'error'").select("asin", F.col("ts").alias("at")), e.where("event_type = 'view'").select("asin", "ts", F.col("value").alias("price")))
    return out.select("asin", F.unix_micros("at").alias("at_us"), "price")


@query("last_write", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def last_write(spark, sf_dir):
    """The last value of each key (ST10)."""
    return stores.last_write(_events(spark, sf_dir), "user_id", "ts", "event_type")


@query("capacity_eviction", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def capacity_eviction(spark, sf_dir):
    """The five newest entries of each user (ST7)."""
    return stores.newest(_events(spark, sf_dir), 5, "ts", "user_id").select("user_id", "event_id")


@query("cache_expiry", "SELECT event_id FROM events WHERE epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-20 00:00:00') - 86400000000")
def cache_expiry(spark, sf_dir):
    """Entries younger than a day (ST8, ST9)."""
    return stores.fresh(_events(spark, sf_dir), "ts", F.timestamp_seconds(F.lit(1705708800)), 24).select("event_id")


@query("insert_absent", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 = 0")
def insert_absent(spark, sf_dir):
    """Insert what is not there; two overlapping sets hold all customers."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return stores.insert_absent(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 <> 0 OR c_custkey % 3 = 0"), "c_custkey")


@query("remove_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def remove_keys(spark, sf_dir):
    """Difference by key."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return stores.remove_keys(table(spark, sf_dir, "customer").select("c_custkey"), gone, "c_custkey")


def _purchases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_totalprice").alias("price"), (k % 101).cast("int").alias("trust_score"), F.when(k % 4 > 0, k % 6).cast("int").alias("satisfaction"), (k % 5 == 0).alias("prompted"), F.col("o_orderdate").alias("purchased_at"), k.alias("id"))


@query(
    "purchase_stats",
    """WITH p AS (SELECT o_totalprice AS price, o_orderkey % 101 AS trust, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 6 END AS s FROM orders), a AS (SELECT count(*)::BIGINT AS n, sum(price) AS spent, avg(CASE WHEN s >= 4 THEN trust END) AS g, avg(CASE WHEN s <= 2 THEN trust END) AS r FROM p)
SELECT n, floor(spent / 1000 + 0.5) AS spent_k, floor(g * 10 + 0.5) / 10 AS liked_trust, floor(r * 10 + 0.5) / 10 AS regretted_trust, least(70.0, floor(r + 10 + 0.5))::DOUBLE AS suggested_min FROM a""",
)
def purchase_stats(spark, sf_dir):
    """Purchases liked and regretted."""
    out = stores.purchase_stats(_purchases(spark, sf_dir))
    return out.select("n", half_up(F.col("spent") / 1000).alias("spent_k"), "liked_trust", "regretted_trust", "suggested_min")


@query("unrated_purchases", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0 AND NOT (o_orderkey % 4 > 0) AND date_diff('day', o_orderdate::DATE, DATE '2000-01-01') > 30")
def unrated_purchases(spark, sf_dir):
    """Purchases to ask about."""
    return stores.unrated(_purchases(spark, sf_dir), F.lit("2000-01-01").cast("date")).select("id")


@query(
    "budgets",
    """WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), r AS (SELECT c_custkey AS recipient, c_acctbal * 100 AS budget, floor(coalesce(t, 0) * 100 + 0.5) / 100 AS spent FROM customer LEFT JOIN s ON c_custkey = o_custkey)
SELECT recipient, budget, floor(spent + 0.5) AS spent_rounded, spent > budget AS over FROM r""",
)
def budgets(spark, sf_dir):
    """Spending against budgets."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recipient"), (F.col("c_acctbal") * 100).alias("budget"), F.col("c_custkey").alias("shortlist"))
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("list_name"), F.col("o_totalprice").alias("price"))
    return stores.budgets(people, items).select("recipient", "budget", half_up(F.col("spent")).alias("spent_rounded"), "over")


@query(
    "cheapest_locales",
    """WITH l AS (SELECT p_partkey AS k, p_retailprice AS home, unnest([{'locale': 'de', 'p': p_retailprice * (0.7 + p_partkey % 5 * 0.1), 'r': 1.09}, {'locale': 'jp', 'p': p_retailprice * (110 + p_partkey % 7 * 20), 'r': 0.0066},
  {'locale': 'uk', 'p': p_retailprice * (0.6 + p_partkey % 3 * 0.2), 'r': 1.27}], recursive := true) FROM part), u AS (SELECT *, floor(p::DOUBLE * r::DOUBLE * 100 + 0.5) / 100 AS usd FROM l WHERE locale <> 'uk' OR k % 4 > 0)
SELECT k::VARCHAR AS asin, locale, usd, greatest(0, floor((home - usd) * 100 + 0.5) / 100)::DOUBLE AS savings, n FROM (SELECT *, count(*) OVER (PARTITION BY k)::BIGINT AS n FROM u) QUALIFY row_number() OVER (PARTITION BY k ORDER BY usd, locale) = 1""",
)
def cheapest_locales(spark, sf_dir):
    """The cheapest of an item's locales, the saving, and how many have a price."""
    k, home = F.col("p_partkey"), F.col("p_retailprice")
    local = {"de": home * (0.7 + k % 5 * 0.1), "jp": home * (110 + k % 7 * 20), "uk": home * (0.6 + k % 3 * 0.2)}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("locale"), v.cast("double").alias("local_price")) for n, v in local.items())))
    p = table(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("asin"), home.alias("home_price"), each.alias("l")).select("p_partkey", "asin", "home_price", "l.*").where("locale <> 'uk' OR p_partkey % 4 > 0")
    rates = spark.createDataFrame([("de", 1.09), ("uk", 1.27), ("jp", 0.0066)], "locale string, rate double")
    return stores.cheapest_locale(p, rates).join(p.groupBy("asin").agg(F.count("*").alias("n")), "asin").select("asin", "locale", "usd", "savings", "n")


@query("quiet_hours", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 7 AS quiet FROM events")
def quiet_hours(spark, sf_dir):
    """Quiet hours across midnight."""
    return _events(spark, sf_dir).select("event_id", filters.quiet(F.col("ts"), 22, 7).alias("quiet"))


@query("backoff", "SELECT n::BIGINT AS failures, CASE WHEN n < 5 THEN least(30000, 1000 * pow(2, n))::BIGINT END AS delay_ms FROM range(8) t(n)")
def backoff(spark, sf_dir):
    """Delay after failures."""
    return spark.range(8).select(F.col("id").alias("failures"), scoring.backoff_ms(F.col("id")).alias("delay_ms"))


@query("severity_and_age", "SELECT n::BIGINT AS n, CASE WHEN n <= 0 THEN 'none' WHEN n / 15.0 >= 0.7 THEN 'high' WHEN n / 15.0 >= 0.4 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN n * 9000 < 60 THEN 'just now' WHEN n * 9000 < 3600 THEN floor(n * 9000 / 60)::INT || 'm ago' WHEN n * 9000 < 86400 THEN floor(n * 9000 / 3600)::INT || 'h ago' ELSE floor(n * 9000 / 86400)::INT || 'd ago' END AS age FROM range(16) t(n)")
def severity_and_age(spark, sf_dir):
    """Severity of a deduction and an age in words."""
    return spark.range(16).select(F.col("id").alias("n"), scoring.severity(F.col("id"), F.lit(15)).alias("severity"), scoring.age_bucket(F.col("id") * 9000).alias("age"))


@query("page_titles", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]+)<', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\s'))::INT AS n_links, regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>([^<]+)<')""")
def page_titles(spark, sf_dir):
    """Titles, links and hosts of raw pages."""
    out = html.page_fields(table(spark, sf_dir, "pages")).where("title_strategy = 0")
    return out.select("page_id", "title", "n_links", "host")


@query(
    "page_fields",
    r"""WITH t AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x,
  NOT regexp_matches(lower(html), 'captcha|robot check|enter the characters you see|automated access') AS ok, [regexp_extract(html, '(?is)<h1[^>]*>([^<]+)<', 1), regexp_extract(html, '(?is)<title[^>]*>([^<]+)<', 1), regexp_extract(html, '(?i)property="og:title"\s+content="([^"]+)"', 1)] AS heads,
  regexp_extract(html, 'class="[^"]*offscreen[^"]*"[^>]*>([^<]+)<|"price(?:Amount)?"\s*:\s*"?([0-9][0-9.,]*)|data-price="([^"]+)"', 0) AS money FROM pages),
f AS (SELECT *, list_position(list_transform(heads, lambda h: h <> ''), true) - 1 AS k FROM t)
SELECT page_id, ok, CASE WHEN ok THEN trim(heads[k + 1]) END AS title, CASE WHEN ok THEN coalesce(k, -1) END::INT AS title_strategy, CASE WHEN ok THEN regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1) END AS host,
  CASE WHEN ok THEN upper(nullif(coalesce(nullif(regexp_extract(url, '(?i)/(?:dp|gp/product|gp/aw/d)/([A-Z0-9]{10})', 1), ''), regexp_extract(url, '(?i)(?:^|[^A-Za-z0-9_])([A-Z0-9]{10})(?:$|[^A-Za-z0-9_])', 1)), '')) END AS item_id,
  CASE WHEN ok THEN try_cast(replace(regexp_extract(money, '([0-9][0-9,]*\.?[0-9]*)', 1), ',', '') AS DOUBLE) END AS price, CASE WHEN ok THEN nullif(trim(regexp_extract(x, '(?i)country of origin\s*:?\s*([A-Za-z ]+?)(?:[.,;]|$)', 1)), '') END AS country,
  CASE WHEN ok THEN len(regexp_extract_all(html, '(?i)<a\s')) END::INT AS n_links, CASE WHEN ok THEN length(x) END::INT AS text_chars FROM f""",
)
def page_fields(spark, sf_dir):
    """Fields of raw pages as they come, with the fall-back that gave the title."""
    out = html.page_fields(table(spark, sf_dir, "pages"))
    return out.select("page_id", "ok", "title", "title_strategy", "host", "item_id", "price", "country", "n_links", "text_chars")


@query(
    "listing_completeness",
    r"""WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages),
f AS (SELECT page_id, regexp_matches(html, '(?i)dimensions?') AS a, regexp_matches(html, '(?i)weight') AS b, regexp_matches(html, '(?i)materials?|fabric') AS c, regexp_matches(html, '(?i)manufacturer') AS d, regexp_matches(html, '(?i)model (?:number|name)') AS e,
  regexp_matches(html, '(?i)warranty') AS f, regexp_matches(html, '(?i)ingredients') AS g, regexp_matches(html, '(?i)country of origin') AS h, regexp_matches(html, '(?i)<table') AS i, len(regexp_extract_all(html, '(?i)<img')) >= 3 AS j, len(regexp_extract_all(html, '(?i)<li')) >= 3 AS k, length(x) > 50 AS l FROM t),
s AS (SELECT page_id, floor((a::INT * 5 + b::INT * 5 + c::INT * 2 + d::INT * 5 + e::INT * 2 + f::INT * 2 + g::INT * 2 + h::INT * 2 + i::INT * 2 + j::INT * 10 + k::INT * 10 + l::INT * 10) * 100.0 / 57 + 0.5)::INT AS score,
  ((NOT a)::INT + (NOT b)::INT + (NOT d)::INT + (NOT j)::INT + (NOT k)::INT + (NOT l)::INT)::INT AS missing_important FROM f)
SELECT page_id, score, missing_important, CASE WHEN score >= 80 THEN 'complete' WHEN score >= 55 THEN 'adequate' WHEN score >= 30 THEN 'sparse' ELSE 'poor' END AS label FROM s""",
)
def listing_completeness(spark, sf_dir):
    """How complete a page is."""
    return table(spark, sf_dir, "pages").select("page_id", html.completeness(F.col("html")).alias("c")).select("page_id", "c.score", "c.missing_important", "c.label")


@query(
    "page_literals",
    """SELECT * FROM (VALUES (1, 'B08N5WRWNW', 29.99::DOUBLE, 'China', false), (2, NULL, 1234.5::DOUBLE, 'Vietnam', false), (3, 'B000000001', NULL, NULL, true)) t(id, item, price, country, blocked)""",
)
def page_literals(spark, sf_dir):
    """Item id, price, country, robot check of literal pages."""
    rows = spark.createDataFrame(
        [(1, "https://x.example/dp/b08n5wrwnw?a=1", '<span class="a-offscreen">$29.99</span> Country of Origin: PRC.', "prc"), (2, "https://x.example/list", '{"price": "1,234.50"}', "Vietnam"), (3, "item B000000001", "Enter the characters you see below", None)],
        "id int, url string, html string, c string",
    )
    return rows.select("id", parse.item_id(F.col("url")).alias("item"), parse.price_in_html(F.col("html")).alias("price"), parse.country(F.col("c")).alias("country"), parse.blocked_page(F.col("html")).alias("blocked"))


@query("offer_literals", "SELECT * FROM (VALUES (1, 'percent', 10.0::DOUBLE, 1234::BIGINT, 'Kitchen', 2, 5, 12.99::DOUBLE), (2, 'amount', 5.0::DOUBLE, NULL, NULL, 3, 0, NULL), (3, NULL, NULL, 7::BIGINT, 'Toys & Games', NULL, 0, NULL)) t(id, coupon, value, rank, category, buy, sellers, low)")
def offer_literals(spark, sf_dir):
    """Coupons, ranks, multi-buy and other sellers of literals."""
    rows = spark.createDataFrame(
        [(1, "Save 10% with coupon", "#1,234 in Kitchen (See Top 100)", "Buy 2, save 5%", "New (5) from $12.99"), (2, "$5 off coupon", "none", "3 for $20", "Used"), (3, "no offer", "#7 in Toys & Games", "Buy 1, get nothing", "")],
        "id int, a string, b string, c string, d string",
    )
    x = rows.select("id", parse.parse_coupon(F.col("a")).alias("c"), parse.parse_rank(F.col("b")).alias("r"), parse.parse_multi_buy(F.col("c")).alias("m"), parse.parse_other_sellers(F.col("d")).alias("o"))
    return x.select("id", F.col("c.type").alias("coupon"), F.col("c.value").alias("value"), "r.rank", "r.category", F.col("m.min_quantity").alias("buy"), F.col("o.count").alias("sellers"), F.col("o.min_price").alias("low"))


@query("seller_literals", "SELECT * FROM (VALUES ('retailer.com', NULL, 'retailer'), ('Acme', 'Retailer', 'fba'), ('Acme', 'Acme', 'third-party'), ('Acme', NULL, 'unknown')) t(sold_by, ships_from, fulfillment)")
def seller_literals(spark, sf_dir):
    """Who sells and who ships."""
    rows = spark.createDataFrame([("retailer.com", None), ("Acme", "Retailer"), ("Acme", "Acme"), ("Acme", None)], "sold_by string, ships_from string")
    return rows.select("sold_by", "ships_from", parse.classify_seller(F.col("sold_by"), F.col("ships_from"), "retailer")["fulfillment"].alias("fulfillment"))


@query("search_urls", "SELECT * FROM (VALUES ('red mug', 'plastic,glass', 'kitchen', 26.0::DOUBLE)) t(query, excluded, department, price_max)")
def search_urls(spark, sf_dir):
    """A pushed-down search URL, read back."""
    url = html.search_url("https://shop.example/s", "red mug", ("plastic", "glass"), "kitchen", 20.0)
    back = spark.createDataFrame([(url,)], "u string").select(html.parse_search_url(F.col("u")).alias("p"))
    return back.select("p.query", F.array_join("p.excluded", ",").alias("excluded"), "p.department", "p.price_max")


def _order_items(orders):
    """Orders as items of their customer's list."""
    return orders.select(F.col("o_custkey").cast("string").alias("list_name"), F.col("o_orderkey").alias("added_at"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.lit(None).cast("double").alias("price"))


@query("shortlist_markdown", "WITH t AS (SELECT o_custkey::VARCHAR AS list_name, o_orderkey, 'Order ' || o_orderkey AS title FROM orders) SELECT list_name, '# ' || list_name || chr(10) || string_agg('- ' || title, chr(10) ORDER BY o_orderkey) AS markdown FROM t GROUP BY list_name")
def shortlist_markdown(spark, sf_dir):
    """Lists as Markdown (X5, X6; lists of all customers)."""
    return sinks.markdown_lists(_order_items(table(spark, sf_dir, "orders")))


@query("media_counts", "SELECT * FROM (VALUES ('a', 1::BIGINT, 1::BIGINT, 1::BIGINT, 2::BIGINT)) t(asin, images, videos, verified, with_media)")
def media_counts(spark, sf_dir):
    """Media of reviews, once per thumbnail."""
    rows = [("a", 1, "image", "t1", True), ("a", 1, "image", "t1", True), ("a", 2, "video", "t1", False)]
    return html.media_counts(spark.createDataFrame(rows, "asin string, review_idx int, kind string, thumbnail string, verified boolean"))


@query("learned_brands", "SELECT DISTINCT word FROM (SELECT lower(p_brand) AS word FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'known')")
def learned_brands(spark, sf_dir):
    """Words confirmed as brands."""
    words = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise("x").alias("word"), F.col("p_brand").alias("brand"))
    return stores.learn_brands(spark.createDataFrame([("known",)], "word string"), words)


@query("streamed_events", "SELECT count(DISTINCT user_id) FILTER (user_id % 5 > 0)::BIGINT AS keyed, count(*) FILTER (user_id % 5 = 0)::BIGINT AS unkeyed FROM events")
def streamed_events(spark, sf_dir):
    """Events through a stateful stream, each key once and rows without a key all, as in batch (ST1, ST3)."""
    from ..sources.storage import scratch_path
    from ..streaming.incremental import unseen

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = scratch_path(spark, "stream")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = stream.select(F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("key"), F.col("ts").cast("timestamp").alias("at"))
    job = unseen(keyed, "key", "at").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(keyed.schema).parquet(f"{base}/out").agg(F.count("key").alias("keyed"), F.count_if(F.col("key").isNull()).alias("unkeyed"))


@query(
    "brand_words",
    """SELECT * FROM (VALUES (1, 'Acme', 'mug'), (2, 'Zeta', 'Zeta'), (3, 'Nova', 'Nova'), (4, 'Unknown', 'wireless'), (5, 'Wireless', 'Wireless'), (6, 'Unknown', NULL)) t(id, brand, candidate)""",
)
def brand_words(spark, sf_dir):
    """Brand cascade and candidates on literals."""
    from ..functions import brands

    rows = spark.createDataFrame(
        [(1, "Visit the Acme Store", "mug-blue", "Blue mug", ""), (2, None, "Zeta-lamp", "Lamp", ""), (3, None, "", "Nova, red", ""), (4, None, "wireless-mouse", "best mouse", ""), (5, None, "", "Wireless mouse", "wireless"), (6, None, "", "best mouse", "")],
        "id int, byline string, slug string, title string, learned string",
    )
    plain, taught = brands.brand_of(F.col("byline"), F.col("slug"), F.col("title")), brands.brand_of(F.col("byline"), F.col("slug"), F.col("title"), learned=("wireless",))
    return rows.select("id", F.when(F.col("learned") != "", taught).otherwise(plain).alias("brand"), brands.brand_candidate(F.col("slug"), F.col("title")).alias("candidate"))


@query("first_reviews", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) <= 10")
def first_reviews(spark, sf_dir):
    """The first ten reviews of each item in page order."""
    from ..operators.ranking import top_k

    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return top_k(rows, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 10).drop("rank")


@query(
    "alternatives",
    """WITH p AS (SELECT p_partkey AS pos, p_retailprice AS price, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 101 END, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 89 END)::INT AS score FROM part), s AS (SELECT * FROM p WHERE score IS NOT NULL AND price > 0),
k AS (SELECT pos AS pick FROM s WHERE score >= 70 ORDER BY score / price DESC, pos LIMIT 1)
SELECT pos, score, CASE WHEN pos = pick THEN 'top-pick' WHEN score < 60 THEN 'see-alternative' ELSE 'plain' END AS role FROM s, k""",
)
def alternatives(spark, sf_dir):
    """Scores with a fall-back, the pick, and who should look at it."""
    from ..operators.ranking import alternatives as run

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("asin"), F.col("p_retailprice").alias("price"))
    trust = part.where("pos % 2 = 0").select("asin", (F.col("pos") % 101).cast("int").alias("score"))
    quality = part.where("pos % 3 = 0").select("asin", (F.col("pos") % 89).cast("int").alias("score"))
    return run(part, trust, quality)


@query("score_dimensions", "WITH p AS (SELECT p_partkey AS pos, (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT + 1 AS n FROM part) SELECT pos, CASE WHEN n >= 2 THEN n ELSE 0 END::INT AS n FROM p")
def score_dimensions(spark, sf_dir):
    """Dimensions of a listing that are known, shown from two on."""
    p = F.col("p_partkey")
    rows = scoring.score_rows(a=F.when(p % 2 == 0, p % 100), b=F.when(p % 3 == 0, p % 100), c=F.when(p % 5 == 0, p % 100), d=p % 100)
    return table(spark, sf_dir, "part").select(p.alias("pos"), F.size(rows).alias("n"))


@query("moved_brands", "SELECT * FROM (VALUES ('trusted', 'a'), ('trusted', 'b'), ('trusted', 'c'), ('blocked', 'd')) t(list, brand)")
def moved_brands(spark, sf_dir):
    """A brand enters one list and leaves the other."""
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "brand string")
    trusted, blocked = stores.move_brand(make("a", "b"), make("c", "d"), make("b", "c"))
    return trusted.select(F.lit("trusted").alias("list"), "brand").unionByName(blocked.select(F.lit("blocked").alias("list"), "brand"))


@query("time_windows", "SELECT event_type, count(*)::BIGINT AS windows, sum(n)::BIGINT AS events FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def time_windows(spark, sf_dir):
    """Tumbling windows over events, as the streaming counters give them."""
    days = _events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return days.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))
