"""Queries that read generated pages: every listing is written as mark-up in one of several layouts and read back; the SQL knows the
values from the tables and never sees the mark-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import half_up
from ..operators import departments, review_scores, topics
from ..sources import cards
from ..sources.storage import materialize
from ..sources.tables import listings, reviews, text_reviews, union_pages
from .listing_queries import LISTINGS
from .registry import query
from .review_queries import REVIEWS, TAGGED, TEXTS, _tagged

def _pos():
    return F.col("pos")


def _pick(*choices):
    """The choice at pos modulo their number."""
    out = F
    for k, c in enumerate(choices[:-1]):
        out = out.when(_pos() % len(choices) == k, c)
    return out.otherwise(choices[-1])


def _html(*parts):
    """Mark-up of text and columns; a null part is left out with nothing in its place."""
    return F.concat(*(F.coalesce(p, F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts))


def _item():
    return F.concat(F.lit("B"), F.lpad(_pos().cast("string"), 9, "0"))


def _result_cards(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("size", F.col("dept"))
    shown = F.when(_pos() % 7 == 6, F.concat(F.lit("ACME "), F.col("title"))).otherwise(F.col("title"))
    slug = F.when(_pos() % 7 == 5, F.concat(F.lit("Zeta"), F.col("size").cast("string"), F.lit("-thing"))).otherwise(F.lit("wireless-thing"))
    count, money = F.col("review_count") * 97, lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    counted = F.when(
        count > 0,
        _pick(
            _html('<a href="/x#customerReviews"><span>', F.format_number(count, 0), "</span></a>"), _html('<span class="s-underline-text">', count.cast("string"), "</span>"),
            _html('<i aria-label="', F.format_number(count, 0), ' ratings"></i>'),
        ),
    )
    stars = F.when(F.col("rating") > 0, _pick(_html('<i aria-label="', F.col("rating").cast("string"), ' out of 5 stars"></i>'), _html('<span class="a-icon-alt">', F.col("rating").cast("string"), " out of 5 stars</span>")))
    made = _pick(
        _html('<a href="/s?k=x">', F.col("brand"), "</a>"), _html("<span>Visit the ", F.col("brand"), " Store</span>"), _html("<span>by ", F.col("brand"), "</span>"),
        _html('<p></p><h5 class="s-line-clamp-1"><span>Shop ', F.col("brand"), "</span></h5>"), _html('<p></p><a href="?field=brandtextbin" aria-label="', F.col("brand"), '">x</a>'), F.lit(""), F.lit(""),
    )
    priced = F.when(F.col("price").isNotNull(), _pick(_html('<span class="a-price"><span class="a-offscreen">', money(F.col("price")), "</span></span>"), _html('<span class="a-price-whole">', money(F.col("price")), "</span>")))
    struck = F.when(
        F.col("list_price") > F.col("price"),
        _pick(
            _html('<span data-strikethroughprice="1">', money(F.col("list_price")), "</span>"), _html('<span class="a-was a-text-price"><span class="a-offscreen">', money(F.col("list_price")), "</span></span>"),
            _html('<span class="a-text-strike">', money(F.col("list_price")), "</span>"),
        ),
    )
    ad = F.when(F.col("is_sponsored"), _pick(F.lit('<b data-sponsored="true"></b>'), F.lit('<b aria-label="Sponsored listing"></b>'), F.lit('<span class="a-color-secondary">Sponsored</span>'), F.lit('<b class="x sponsored-label"></b>')))
    badge = F.when(F.col("has_deal_badge"), _pick(F.lit('<span class="a-badge-text">Limited time deal</span>'), F.lit('<b class="x-dealBadge-y"></b>')))
    value = F.format_number(F.col("coupon.value"), 0)
    clip = F.when(F.col("coupon.type") == "percent", _html('<span class="s-coupon-unclipped">Save ', value, "% with coupon</span>")).when(F.col("coupon.type") == "amount", _html('<span class="s-coupon-unclipped">Save $', value, " with coupon</span>"))
    plan = F.format_number("sns_percent", 0)
    subscribe = F.when(plan.isNotNull(), F.when(_pos() % 8 == 0, _html('<b class="subscribe-box">up to ', plan, "%</b>")).otherwise(_html("<b>Save an extra ", plan, "% with Subscribe &amp; Save</b>")))
    head = _html("<div", F.when(_pos() % 2 == 0, _html(' data-asin="', _item(), '"')), '><h2 class="t"><a href="/', slug, "/dp/", _item(), '"><span> ', shown, " </span></a></h2>")
    return materialize(rows.select("pos", _html(head, made, stars, counted, priced, struck, ad, badge, clip, subscribe, "</div>").alias("html")), "result-cards")


ITEM = "'B' || lpad(pos::VARCHAR, 9, '0')"
MONEY = "floor({} * 100 + 0.5) / 100"


@query(
    "result_cards",
    LISTINGS + f"""SELECT pos, {ITEM} AS asin, CASE WHEN pos % 7 = 6 THEN 'ACME ' ELSE '' END || title AS title,
  CASE pos % 7 WHEN 2 THEN 'Brand' WHEN 5 THEN 'Zeta' || p_size WHEN 6 THEN 'ACME' ELSE brand END AS brand, {MONEY.format("price")} AS price, CASE WHEN list_price > price THEN {MONEY.format("list_price")} END AS list_price,
  rating::DOUBLE AS rating, review_count * 97 AS review_count, is_sponsored, has_deal_badge, coupon_type, coupon_value, sns::INT AS sns_percent FROM listings""",
)
def result_cards(spark, sf_dir):
    """Cards of the main store, in several layouts of each field."""
    return cards.read_cards(_result_cards(spark, sf_dir)).withColumns({"coupon_type": F.col("coupon.type"), "coupon_value": F.col("coupon.value")}).drop("coupon")


def _discount_cards(spark, sf_dir):
    rows = listings(spark, sf_dir)
    money = F.concat(F.lit("$"), (F.col("dept") % 20).cast("string"), F.lit(".99"))
    shown = _pick(_html('<img alt="', F.col("title"), '">'), _html('<a href="/x/dp/', _item(), '" aria-label="', F.col("title"), '"></a>'), _html('<a href="/gp/product/', _item(), '"></a><h3>', F.col("title"), "</h3>"))
    count = F.when(F.col("review_count") > 0, _pick(_html("<span>(", F.format_number(F.col("review_count") * 97, 0), ")</span>"), _html('<i aria-label="', F.format_number(F.col("review_count") * 97, 0), ' reviews"></i>'), _html("<span>", (F.col("review_count") * 97).cast("string"), " ratings</span>")))
    stars = F.when(F.col("rating") > 0, _pick(_html('<i aria-label="', F.col("rating").cast("string"), ' out of 5"></i>'), _html('<i aria-label="', F.col("rating").cast("string"), ' stars"></i>')))
    priced = _pick(_html("<span>", money, "</span>"), _html('<i aria-label="now ', money, '"></i>'), _html('<span class="a-price"><span class="a-offscreen">', money, "</span></span>"))
    made = _pick(_html('<b class="x-brand">by ', F.col("brand"), "</b>"), _html("<b>by ", F.col("brand"), "</b>"), F.lit(""), F.lit(""))
    ad = F.when(F.col("is_sponsored"), _pick(F.lit("<span>Ad</span>"), F.lit('<b data-is-sponsored="true"></b>')))
    return materialize(rows.select("pos", _html("<div", F.when(_pos() % 3 == 0, _html(' data-asin="', _item(), '"')), ">", shown, count, stars, priced, made, ad, "</div>").alias("html")), "discount-cards")


@query(
    "discount_cards",
    LISTINGS + f"""SELECT pos, {ITEM} AS asin, title, CASE pos % 4 WHEN 0 THEN brand WHEN 1 THEN 'Brand' ELSE 'Unknown' END AS brand, p_size % 20 + 0.99::DOUBLE AS price, rating::DOUBLE AS rating, review_count * 97 AS review_count, is_sponsored FROM listings""",
)
def discount_cards(spark, sf_dir):
    """Cards of the second source, with its own field rules."""
    return cards.read_discount_cards(_discount_cards(spark, sf_dir))


@query(
    "two_sources",
    LISTINGS + f"""SELECT {ITEM} AS asin, 'main' AS seen_in, {MONEY.format("price")} AS price FROM listings WHERE pos % 3 <> 1 UNION ALL SELECT {ITEM}, 'discount', p_size % 20 + 0.99::DOUBLE FROM listings WHERE pos % 3 = 1""",
)
def two_sources(spark, sf_dir):
    """Both sources in one scan, the first card of each id kept: the discount section adds what the main store lacks."""
    main, discount = cards.read_cards(_result_cards(spark, sf_dir).where(_pos() % 3 != 1)), cards.read_discount_cards(_discount_cards(spark, sf_dir))
    return union_pages([main.withColumn("seen_in", F.lit("main")), discount.withColumn("seen_in", F.lit("discount"))]).select("asin", "seen_in", "price")


def _review_pages(spark, sf_dir):
    """asin, html: a product's bars and all its reviews; every fourth product lacks one bar."""
    rows = reviews(spark, sf_dir)
    verified = F.when(F.col("verified"), F.when(F.col("review_idx") % 2 == 0, F.lit('<b data-hook="avp-badge"></b>')).otherwise(F.lit("<b>Verified Purchase</b>")))
    votes = F.when(F.col("helpful_votes") > 0, _html('<span data-hook="helpful-vote-statement">', F.col("helpful_votes").cast("string"), F.when(F.col("helpful_votes") == 1, F.lit(" person")).otherwise(F.lit(" people")), " found this helpful</span>"))
    dated = F.when(F.col("review_idx") % 5 > 0, _html('<span data-hook="review-date">Reviewed in the United States on ', F.date_format("ts", "MMMM d, yyyy"), "</span>"))
    one = _html('<div data-hook="review"><i data-hook="review-star-rating"><span>', F.col("rating").cast("string"), " out of 5 stars</span></i>", dated, '<span data-hook="review-body"><span>Review ', F.col("review_idx").cast("string"), "</span></span>", verified, votes, "</div>")
    share = lambda k: F.floor(F.count_if(F.col("rating") == k) * 100 / F.count("*"))
    bar = lambda k: _html('<tr aria-label="', share(k).cast("string"), '% have it"><td><a href="?filterByStar=x">', F.lit(str(k)), "</a></td></tr>") if k % 2 else _html('<tr><td><a href="?filterByStar=x"><b class="a-size-base">', share(k).cast("string"), "%</b></a></td></tr>")
    last = F.when(F.first("asin").cast("long") % 4 > 0, bar(1))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("review_idx", "helpful_votes", "rating", "ts", "verified", one.alias("html")))), lambda r: r["html"]), "")
    return materialize(rows.groupBy("asin").agg(_html("<table>", bar(5), bar(4), bar(3), bar(2), last, "</table>", said).alias("html")), "review-pages")


@query(
    "review_pages",
    REVIEWS + """, n AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY idx, votes, rating, t, verified) - 1 AS place FROM r)
SELECT asin, place::INT AS place, 'Review ' || idx AS text, rating::DOUBLE AS rating, CASE WHEN idx % 5 > 0 THEN t // 86400000000 * 86400 ELSE 0 END::BIGINT AS day, verified, votes::BIGINT AS helpful_votes FROM n WHERE place < 10""",
)
def review_pages(spark, sf_dir):
    """The first ten reviews of each product's page, with defaults for what is missing."""
    read = _review_pages(spark, sf_dir).select("asin", F.posexplode(cards.page_reviews(F.col("html"))).alias("place", "r"))
    return read.select("asin", "place", "r.text", "r.rating", F.unix_timestamp("r.ts").alias("day"), "r.verified", "r.helpful_votes")


@query(
    "page_histograms",
    REVIEWS + """SELECT asin, """ + ", ".join(f"CASE WHEN asin::BIGINT % 4 > 0 THEN floor(count(*) FILTER (rating = {k}) * 100 / count(*)) END::INT AS {b}" for k, b in zip((5, 4, 3, 2, 1), cards.BARS)) + " FROM r GROUP BY asin",
)
def page_histograms(spark, sf_dir):
    """The bars of each product's page; null unless all five are there."""
    return _review_pages(spark, sf_dir).select("asin", cards.histogram(F.col("html")).alias("h")).select("asin", *(F.col(f"h.{b}").alias(b) for b in cards.BARS))


@query(
    "document_fields",
    LISTINGS + """SELECT pos, CASE WHEN pos % 7 < 6 THEN brand END AS brand, CASE pos % 6 WHEN 4 THEN 'Retailer' WHEN 5 THEN NULL ELSE seller_name END AS seller_name,
  CASE pos % 6 WHEN 0 THEN 'third-party' WHEN 1 THEN 'fba' WHEN 2 THEN 'third-party' WHEN 3 THEN 'third-party' WHEN 4 THEN 'retailer' END AS fulfillment FROM listings WHERE has_seller""",
)
def document_fields(spark, sf_dir):
    """Brand and seller of product pages, each in six layouts."""
    rows = listings(spark, sf_dir).where("seller IS NOT NULL")
    b, s = F.col("brand"), F.col("seller.seller_name")
    brand = _pick(
        _html('<a id="bylineInfo">Visit the ', b, " Store</a>"), _html('<a id="bylineInfo"> Brand: ', b, "</a>"), _html('<a id="bylineInfo">', b, "</a>"), _html('<a class="x" id="brand">', b, "</a>"),
        _html('<tr class="a-spacing-small po-brand"><td>Brand</td><td class="po-break-word"><span>', b, "</span></td></tr>"), _html("<tr><th> Brand </th><td>", b, "</td></tr>"), F.lit("<p>none</p>"),
    )
    seller = _pick(
        _html('<div id="merchant-info"> Ships from and sold by ', s, ".</div>"), _html('<div id="merchant-info">Sold by ', s, " and Fulfilled by Retailer.</div>"),
        _html('<span>Ships from</span><span class="tabular-buybox-text">Depot</span><span>Sold by</span><span class="tabular-buybox-text">', s, "</span>"), _html('<a href="/x?seller=A1">', s, "</a>"),
        F.lit('<div id="merchant-info">Ships from and sold by Retailer.</div>'), F.lit("<p>nobody</p>"),
    )
    pages = materialize(rows.select("pos", _html("<body>", brand, seller, "</body>").alias("html")), "documents")
    read = pages.select("pos", cards.document_brand(F.col("html")).alias("brand"), cards.document_seller(F.col("html"), "retailer").alias("s"))
    return read.select("pos", "brand", "s.seller_name", "s.fulfillment")


NODES = ", ".join(f"({k}, '{n}', '{name.replace(chr(39), chr(39) * 2)}', {w.get('durability', 1.0)}::DOUBLE, {w.get('size-fit', 1.0)}::DOUBLE)" for k, (n, name, _, w) in enumerate(departments.PROFILES))


@query(
    "departments",
    f"""WITH d(k, node, name, durability, fit) AS (VALUES {NODES})
SELECT p_partkey AS pos, CASE p_partkey % 5 WHEN 3 THEN '999' WHEN 4 THEN NULL ELSE node END AS department_id, CASE WHEN p_partkey % 5 < 3 THEN name END AS label,
  CASE WHEN p_partkey % 5 < 3 THEN durability ELSE 1.0 END AS durability, CASE WHEN p_partkey % 5 < 3 THEN fit ELSE 1.0 END AS size_fit FROM part JOIN d ON k = p_partkey // 5 % 10""",
)
def department_queries(spark, sf_dir):
    """The department of a search page by node, alias or breadcrumb, and its topic weights."""
    at = lambda values: F.get(F.array(*(F.lit(v) for v in values)), (F.floor(_pos() / 5) % 10).cast("int"))
    node, name, alias = (at([p[i] for p in departments.PROFILES]) for i in (0, 1, 2))
    base = F.lit("https://shop.example/s?k=x")
    url = _pick(F.concat(base, F.lit("&rh=p_1%3A2%2Cn%3A"), node), F.concat(base, F.lit("&i="), alias, F.lit("&page=2")), base, F.concat(base, F.lit("&rh=n%3A999")), F.concat(base, F.lit("&i=nothing")))
    crumb = F.when(_pos() % 5 == 2, F.concat(F.lit("All > "), F.upper(name), F.lit(" > More"))).otherwise(F.lit(""))
    read = listings(spark, sf_dir).select("pos", departments.department(url, crumb).alias("d"))
    weight = lambda t: departments.topic_weight(F.col("d.department_id"), F.lit(t))
    return read.select("pos", "d.department_id", "d.label", weight("durability").alias("durability"), weight("size-fit").alias("size_fit"))


@query(
    "department_topics",
    TAGGED + f""", n AS (SELECT asin, CASE topic WHEN 'articles' THEN 'durability' WHEN 'links' THEN 'size-fit' ELSE topic END AS topic, floor(sum(weight * rating) / sum(weight) * 10 + 0.5) / 10 AS avg_rating FROM x GROUP BY 1, 2), d(k, node, name, durability, fit) AS (VALUES {NODES})
SELECT asin, topic, avg_rating, CASE topic WHEN 'durability' THEN durability WHEN 'size-fit' THEN fit ELSE 1.0 END AS weight, avg_rating * CASE topic WHEN 'durability' THEN durability WHEN 'size-fit' THEN fit ELSE 1.0 END AS weighted_avg_rating FROM n JOIN d ON k = length(asin) % 10""",
)
def department_topics(spark, sf_dir):
    """Topic scores weighed by the ten department profiles."""
    scores = topics.topic_scores(_tagged(spark, sf_dir)).where("asin IS NOT NULL")
    named = scores.withColumn("topic", F.when(F.col("topic") == "articles", "durability").when(F.col("topic") == "links", "size-fit").otherwise(F.col("topic")))
    node = F.get(F.array(*(F.lit(p[0]) for p in departments.PROFILES)), F.length("asin") % 10)
    of = named.select("asin").distinct().withColumn("department_id", node)
    return departments.weighted_topics(named, of).select("asin", "topic", "avg_rating", "weight", "weighted_avg_rating")


@query("local_prices", LISTINGS + f"SELECT pos, CASE WHEN pos % 4 = 2 THEN floor(price) ELSE {MONEY.format('price')} END AS price FROM listings")
def local_prices(spark, sf_dir):
    """Prices of other countries' pages, with their signs."""
    rows = listings(spark, sf_dir).where("pos IS NOT NULL")
    money = F.format_number("price", 2)
    swapped = F.translate(money, ",.", ".,")
    html = _pick(
        _html('<span class="a-offscreen"> EUR ', swapped, "</span>"), _html('{"priceAmount": ', F.regexp_replace(money, ",", ""), "}"),
        _html('<span class="a-offscreen">¥', F.format_number(F.floor("price"), 0), "</span>"), _html('<i class="a-price-whole">', F.format_number(F.floor("price"), 0), '</i><i class="a-price-fraction">', F.substring(money, -2, 2), "</i>"),
    )
    read = cards.local_price(F.when(F.col("price").isNotNull(), html), _pick(F.lit("EUR"), F.lit("GBP"), F.lit("JPY"), F.lit("USD")))
    return rows.select("pos", half_up(read, 2).alias("price"))


@query(
    "short_labels",
    LISTINGS + """SELECT pos, CASE WHEN pos % 2 = 0 THEN 'Best of ' || (pos % 5 + 2) || ' similar listings (' || (55 + pos % 46) || '% match)'
    ELSE 'Similar to "' || CASE WHEN length(title || title) > 40 THEN left(title || title, 39) || '…' ELSE title || title END || '" (' || (55 + pos % 46) || '% match)' END AS duplicate,
  nullif(concat_ws(' · ', CASE WHEN disc > 0 THEN 'Save ' || floor(disc + 0.5)::INT || '%' END, CASE WHEN pos % 3 = 0 THEN 'Good Deal' END, CASE WHEN pos % 7 = 0 THEN 'Buy 2, save 5%' END), '') AS line,
  CASE WHEN pos % 6 + pos % 4 = 0 THEN 50.0 ELSE pos % 6 * 100.0::DOUBLE / (pos % 6 + pos % 4) END::DOUBLE AS positive,
  CASE WHEN pos < 60 THEN pos || 'm' WHEN pos % 60 = 0 THEN pos // 60 || 'h' ELSE pos // 60 || 'h ' || pos % 60 || 'm' END AS saved, length(asin) = 10 AS valid, CASE WHEN pos % 2 = 0 THEN 'b.example' ELSE 'a.example' END AS domain FROM listings""",
)
def short_labels(spark, sf_dir):
    """Labels of duplicates, price lines, shares of pros, time saved, checked ids and domains."""
    disc = F.when(F.col("list_price") > F.col("price"), (F.col("list_price") - F.col("price")) / F.col("list_price") * 100).otherwise(0.0)
    line = labels.price_line(disc, F.when(_pos() % 3 == 0, F.lit("Good Deal")), F.when(_pos() % 7 == 0, F.lit("Buy 2, save 5%")))
    return listings(spark, sf_dir).select(
        "pos", labels.duplicate_label(_pos() % 2 == 0, _pos() % 5 + 2, (55 + _pos() % 46) / 100.0, F.concat("title", "title")).alias("duplicate"), line.alias("line"), labels.sentiment_split(_pos() % 6, _pos() % 4).alias("positive"),
        labels.time_saved(_pos()).alias("saved"), labels.valid_item_id(F.col("asin")).alias("valid"),
        labels.valid_domain(F.when(_pos() % 2 == 0, F.lit("b.example")).otherwise(F.lit("c.example")), ("a.example", "b.example")).alias("domain"),
    )


@query(
    "trust_positives",
    TEXTS.replace("FROM documents", ", doc_id % 3 > 0 AS verified, doc_id % 2 AS votes, 1700000000 + doc_id * 40000 AS t FROM documents") + r""", w AS (SELECT asin, count(DISTINCT word) AS n FROM (SELECT asin, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM r) WHERE length(word) > 3 GROUP BY asin),
g AS (SELECT asin, count(*) AS n, avg(verified::INT) AS v, avg((rating = 4)::INT) * 100 AS four, avg((votes > 0)::INT) AS helped, max(t) - min(t) AS span,
  avg(((regexp_matches(text, '(?i)the |der |les '))::INT + (regexp_matches(text, '(?i) and | und | et '))::INT + (regexp_matches(text, '(?i) in | on | at '))::INT >= 2)::INT) AS several FROM r GROUP BY asin)
SELECT g.asin, concat_ws(',', CASE WHEN g.n >= 3 AND v >= 0.8 THEN 'verified' END, CASE WHEN g.n >= 3 AND w.n / g.n > 30 THEN 'vocabulary' END, CASE WHEN four BETWEEN 12 AND 30 THEN 'distribution' END, CASE WHEN g.n >= 3 AND several >= 0.3 THEN 'balanced' END,
  CASE WHEN g.n >= 3 AND helped >= 0.3 THEN 'helpful' END, CASE WHEN g.n >= 3 AND span >= 7776000 THEN 'spread' END) AS positives FROM g LEFT JOIN w ON g.asin IS NOT DISTINCT FROM w.asin""",
)
def trust_positives(spark, sf_dir):
    """The six good signs beside the trust score."""
    rows = text_reviews(spark, sf_dir).withColumns({"text": F.coalesce("text", F.lit("")), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("review_idx") * 40000), "verified": F.col("review_idx") % 3 > 0, "helpful_votes": F.col("review_idx") % 2})
    many = sum((F.col("text").rlike(p).cast("int") for p in ("(?i)the |der |les ", "(?i) and | und | et ", "(?i) in | on | at ")), F.lit(0))
    return review_scores.positive_signals(rows.withColumn("n_topics", many)).select("asin", F.array_join("positives", ",").alias("positives"))
