"""Queries over whole pages of many cards: containers found by ordered rules with overrides, by links, and how often fall-backs were needed.

Result pages hold forty generated cards each, in five ways, among decoys (comments, scripts, navigation, elements left open, cards in cards);
the SQL knows the cards from the tables. `page_paragraphs` reads the given pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import cards, page_cards
from ..sources.tables import listings, table
from .listing_queries import LISTINGS
from .page_queries import ITEM, MONEY, _discount_cards, _html, _result_cards
from .registry import query

PER_PAGE = 40
HEAD = "<!DOCTYPE html><html><head><title>a <div data-asin='no' data-index='0'></title><script>var x = '<div data-component-type=\"s-search-result\"></div>';</script></head><body><!-- <div class=\"s-result-item\" data-asin=\"no\"></div> -->"
NAV = '<nav><ul><li><div><a href="/x/dp/B999999999"><img src="n"></a></div><li><a href="/gp/product/B888888888">more</a></ul></nav><main><div class="grid"><p>Results<br><div></div>'
FOOT = '</div></main><footer><div><a href="/x/dp/B777777777"><img src="f"></a></div></footer><p>open <b>ends</body></html>'


def _pages(cards_of, kind: str):
    """page_id, kind, html: forty cards a page, in order."""
    by_page = cards_of.groupBy(F.floor(F.col("pos") / PER_PAGE).cast("long").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda c: c["html"]), "\n").alias("shown"))
    return by_page.select("page_id", F.lit(kind).alias("kind"), F.concat(F.lit(HEAD + NAV), "shown", F.lit(FOOT)).alias("html"))


def _search_pages(spark, sf_dir):
    """Pages of the main store: a container of each selector by page, one of an override, and one that no rule knows; every tenth card of a page by class holds another."""
    page, item = F.floor(F.col("pos") / PER_PAGE), F.concat(F.lit("B"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    start = (
        F.when(page % 5 == 0, F.lit('<div data-component-type="s-search-result"'))
        .when(page % 5 == 1, _html('<div data-index="', (F.col("pos") % PER_PAGE).cast("string"), '" data-asin="', item, '"'))
        .when(page % 5 == 2, _html('<DIV data-asin="', item, '" class=\'col s-result-item\''))
        .when(page % 5 == 3, F.lit('<li class="tile new-card"'))
        .otherwise(F.lit("<section"))
    )
    end = F.when(page % 5 == 3, F.lit("</li>")).when(page % 5 == 4, F.lit("</section>")).otherwise(F.lit("</div>"))
    inner = F.when((page % 5 == 2) & (F.col("pos") % 10 == 0), F.lit('<div class="s-result-item" data-asin="BINNER0000"><i>x</div>')).otherwise(F.lit(""))
    made = _result_cards(spark, sf_dir)
    body = F.regexp_replace(F.regexp_replace("html", "^<div[^>]*>", ""), "</div>$", "")
    return _pages(made.select("pos", F.concat(start, F.lit(">"), body, F.lit('<br><img src="i">'), inner, end).alias("html")), "search")


def _rules(spark):
    """The built-in rules, patched: a container that is new to the store, and a title that no card has."""
    patch = spark.createDataFrame([("search", {"card": ["li:hover(", "li.new-card"], "title": ["h2.new-title"]}), ("article", {"card": ["article > section", "article p"], "strong": ["b"]})], "kind string, rules map<string, array<string>>")
    return page_cards.overridden(page_cards.rule_table(spark), patch)


SEARCH_PAGES = LISTINGS + """, s AS (SELECT *, pos // 40 AS page, CASE pos // 40 % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 END AS rule FROM listings WHERE pos // 40 % 5 < 4),
c AS (SELECT page, pos, 0 AS inner_card, rule FROM s UNION ALL SELECT page, pos, 1, rule FROM s WHERE rule = 4 AND pos % 10 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos, inner_card) - 1 AS place FROM c)"""


@query(
    "search_page_cards",
    SEARCH_PAGES + f""" SELECT n.page AS page_id, place::INT AS place, n.rule::INT AS rule, CASE WHEN inner_card = 1 THEN 'BINNER0000' ELSE {ITEM.replace("pos", "n.pos")} END AS asin,
  CASE WHEN inner_card = 0 THEN CASE WHEN n.pos % 7 = 6 THEN 'ACME ' ELSE '' END || title END AS title, CASE WHEN inner_card = 0 THEN {MONEY.format("price")} END AS price,
  CASE WHEN inner_card = 0 THEN review_count * 97 ELSE 0 END AS review_count, CASE WHEN inner_card = 0 THEN 1 END::INT AS title_rule FROM n JOIN s ON n.pos = s.pos""",
)
def search_page_cards(spark, sf_dir):
    """Whole result pages split into cards, nested ones too, by the first rule that finds any; then the cards' fields."""
    found = page_cards.page_cards(_search_pages(spark, sf_dir), _rules(spark))
    html = F.col("html")
    return found.select(
        "page_id", "place", "rule", cards.card_id(html).alias("asin"), cards.title(html).alias("title"), cards.price(html).alias("price"), cards.review_count(html).alias("review_count"), F.col("found")["title"]["rule"].alias("title_rule")
    )


@query(
    "rule_fallbacks",
    SEARCH_PAGES + """, f AS (SELECT 'card' AS field, rule FROM n WHERE place = 0 UNION ALL SELECT 'title', 1 FROM n WHERE inner_card = 0
  UNION ALL SELECT 'price', 1 FROM n JOIN s ON s.pos = n.pos WHERE inner_card = 0 AND price IS NOT NULL AND n.pos % 2 = 1
  UNION ALL SELECT 'list_price', CASE n.pos % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END FROM n JOIN s ON s.pos = n.pos WHERE inner_card = 0 AND list_price > price AND n.pos % 3 > 0)
SELECT 'search' AS kind, field, rule::INT AS rule, count(*)::BIGINT AS n FROM f GROUP BY field, rule""",
)
def rule_fallbacks(spark, sf_dir):
    """How often a page's container or a card's field was found by a selector other than the first."""
    return page_cards.fallback_counts(page_cards.page_cards(_search_pages(spark, sf_dir), _rules(spark)))


@query(
    "discount_page_cards",
    LISTINGS + """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT - 1 AS place, rule, asin, title, price FROM (
  SELECT pos // 40 AS page_id, pos, CASE pos // 40 % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 8 END::INT AS rule, 'B' || lpad(pos::VARCHAR, 9, '0') AS asin, title, p_size % 20 + 0.99::DOUBLE AS price FROM listings)""",
)
def discount_page_cards(spark, sf_dir):
    """Whole pages of the discount section: cards by test id, by class, or by links to products outside of navigation."""
    page, item = F.floor(F.col("pos") / PER_PAGE), F.concat(F.lit("B"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    start = F.when(page % 3 == 0, F.lit('<div data-testid="x-product-card-7">')).when(page % 3 == 1, F.lit('<article class="c ProductCard__a">')).otherwise(F.lit("<div>"))
    end = F.when(page % 3 == 1, F.lit("</article>")).otherwise(F.lit("</div>"))
    link = F.when(page % 3 == 2, _html('<span><a href="/thing/dp/', item, '/ref=x"><b>see</b></a></span><img src="p"><span><a href="/gp/product/', item, '">again</a></span>'))
    body = F.regexp_replace(F.regexp_replace("html", "^<div[^>]*>", ""), "</div>$", "")
    given = F.when((F.col("pos") % 3 == 0) | (page % 3 < 2), _html('<i data-asin="', item, '"></i>'))
    pages = _pages(_discount_cards(spark, sf_dir).select("pos", _html(start, given, link, body, end).alias("html")), "discount")
    found = page_cards.page_cards(pages, page_cards.rule_table(spark))
    read = cards.read_discount_cards(found.select(F.struct("page_id", "place", "rule").alias("pos"), "html"))
    return read.select("pos.page_id", "pos.place", "pos.rule", "asin", "title", "price")


@query(
    "page_paragraphs",
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
p AS (SELECT page_id, unnest(string_split(x, '<p>')[2:]) AS y, unnest(range(len(string_split(x, '<p>')) - 1)) AS place FROM a),
t AS (SELECT page_id, place, string_split(y, '</p>')[1] AS y FROM p)
SELECT page_id, place::INT AS place, 1 AS rule, length(trim(regexp_replace(regexp_replace(y, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')))::INT AS chars, contains(y, '<b>') AS strong FROM t""",
)
def page_paragraphs(spark, sf_dir):
    """Paragraphs of the given pages' articles, closed or not, as cards of a kind that only the overrides know, and whether one has a strong part."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("article").alias("kind"), "html")
    found = page_cards.page_cards(pages, _rules(spark))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"\s+", " "))
    return found.select("page_id", "place", "rule", F.length(text).alias("chars"), F.col("found")["strong"].isNotNull().alias("strong"))


OFFERS = ("Special deal. Buy {n}, get 15% off when you check out. More", "Today only. Buy {n}, save $5.00 on this. End", "{n} for $19.99 on all colours", "Now: save 20%   when you buy {n} or more", "Purchase {n} or more and save", "Quantity discount: buy {n} and more. Yes", "{n}+ items get 10% at checkout", "Buy {n} and get one free", "no offer")
PLACES = ('<div id="tp_feature_div">{}</div>', '<div><div id="ppd"><p>x</p><b>{}</b></div></div>', '<ul id="detail-bullets"><li>{}</li></ul>', '<div id="elsewhere">{}</div>')
RANKS = (
    '<table id="prodDetails"><tr><th>Weight</th><td>#5 in Nothing</td></tr><tr><th>Best Sellers Rank</th><td>#{n} in Home &amp; Kitchen (See Top 100 in Home)</td></tr></table>',
    '<div id="detailBullets_feature_div"><span>Best Sellers Rank:</span>\n #{n} in Toys, Games\n<span>Reviews</span></div>',
    '<div id="detailBulletsWrapper_feature_div"><ul><li>Amazon Best Sellers #{n} in Books</ul></div>', '<div id="ppd"><p>Best Seller Rank</p> #{n} in Mugs</div>', "<p>#{n} in Kitchen</p>", "<p>Best Sellers Rank</p>",
)


def _filled(patterns, at, number):
    """The pattern at a place, with a number in it."""
    return F.replace(F.get(F.array(*(F.lit(p) for p in patterns)), at.cast("int")), F.lit("{n}"), number)


@query(
    "document_offers",
    LISTINGS + """, q AS (SELECT pos, pos % 9 AS p, pos // 9 % 4 AS place, CASE WHEN pos % 31 = 0 THEN 1 WHEN pos % 37 = 0 THEN 101 ELSE 2 + pos % 99 END AS n FROM listings),
o AS (SELECT pos, n, CASE p WHEN 0 THEN 'Buy ' || n || ', get 15% off when you check out' WHEN 1 THEN 'Buy ' || n || ', save $5' || '.00 on this' WHEN 2 THEN n || ' for $19.99 on all colours' WHEN 3 THEN 'Now: save 20% when you buy ' || n || ' or more'
  WHEN 4 THEN 'Purchase ' || n || ' or more and save' WHEN 5 THEN 'Quantity discount: buy ' || n || ' and more' WHEN 6 THEN n || '+ items get 10% at checkout' END AS said, place FROM q)
SELECT pos, CASE WHEN said IS NOT NULL AND place < 3 AND n BETWEEN 2 AND 100 THEN CASE WHEN place = 1 THEN CASE WHEN pos % 9 < 2 THEN '' ELSE 'x' END ELSE '' END || said END AS offer, CASE WHEN said IS NOT NULL AND place < 3 AND n BETWEEN 2 AND 100 THEN n END::INT AS quantity,
  CASE WHEN ok THEN pos * 37 % 100000 + 1 END::BIGINT AS rank, CASE WHEN ok THEN CASE pos % 6 WHEN 0 THEN 'Home & Kitchen' WHEN 1 THEN 'Toys, Games' WHEN 2 THEN 'Books' WHEN 3 THEN 'Mugs' END END AS category
FROM (SELECT *, pos % 6 < 4 AND NOT (pos % 6 = 3 AND place = 1) AND NOT (pos % 6 = 1 AND place = 2) AS ok FROM o)""",
)
def document_offers(spark, sf_dir):
    """Quantity offers by seven patterns in their sections, and best-seller ranks near their heading; offers and ranks elsewhere, or out of bounds, are none."""
    pos = F.col("pos")
    n = F.when(pos % 31 == 0, 1).when(pos % 37 == 0, 101).otherwise(2 + pos % 99).cast("string")
    offer = F.replace(F.get(F.array(*(F.lit(p) for p in PLACES)), (F.floor(pos / 9) % 4).cast("int")), F.lit("{}"), _filled(OFFERS, pos % 9, n))
    rank = _filled(RANKS, pos % 6, F.format_number("bsr_rank", 0))
    pages = listings(spark, sf_dir).where("pos IS NOT NULL").select(pos.alias("page_id"), F.concat(F.lit("<body>"), offer, rank, F.lit("</body>")).alias("html"))
    read = page_cards.document_offers(pages)
    return read.select(F.col("page_id").alias("pos"), F.col("multi_buy.text").alias("offer"), F.col("multi_buy.min_quantity").alias("quantity"), "bsr.rank", "bsr.category")


ORIGINS = (
    '<table><tr class="x po-country_of_origin"><td>Country</td><td class="po-break-word"> {} </td></tr></table>', '<table id="prodDetails"><tr><th>Colour</th><td>red</td></tr><tr><th> Country of Origin </th><td>{}</td></tr></table>',
    '<div id="detailBullets_feature_div"><ul><li><span class="a-list-item"><b>Country of Origin</b> \u200f:\u200e {}</span></li></ul></div>', '<table class="prodDetTable"><tr><td>Country of Origin</td><td><b>{}</b></td></tr></table>',
    "<p>Country of Origin: {}</p>",
)
NATIONS = ("PRC", "U.S.A.", "Viet Nam", "korea, republic of", "Ruritania")
CLEAN = ("China", "United States", "Vietnam", "South Korea", "Ruritania")
SELLERS = ('<div id="olp-upd-new">New ({n}) from $12.50</div>', '<div id="aod-ingress-bouncer">{n} new from $1,012.50</div>', '<div id="olp_feature_div">Used</div><div id="ppd">{n} other offers from $7</div>', "<p>New ({n}) from $1.00</p>")


@query(
    "product_details",
    LISTINGS + f"""SELECT pos, CASE WHEN pos % 11 > 1 THEN brand END AS brand, CASE WHEN pos % 11 > 1 AND pos % 5 < 4 THEN CASE pos // 5 % 5 {" ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLEAN))} END END AS country,
  (CASE WHEN pos % 11 > 1 AND pos % 4 < 3 THEN pos % 7 ELSE 0 END)::INT AS other_sellers, CASE WHEN pos % 11 > 1 AND pos % 7 > 0 THEN CASE pos % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 1012.5 WHEN 2 THEN 7 END END::DOUBLE AS other_min_price,
  CASE WHEN pos % 11 > 1 AND pos % 3 = 0 THEN 3 END::INT AS quantity, pos % 11 > 1 AS read FROM listings""",
)
def product_details(spark, sf_dir):
    """Fields of whole product pages: brand, country by four strategies and its common name, other sellers, offers; nulls where a page is missing or a robot check."""
    pos = F.col("pos")
    at = lambda choices, k: F.get(F.array(*(F.lit(c) for c in choices)), k.cast("int"))
    origin = F.replace(at(ORIGINS, pos % 5), F.lit("{}"), at(NATIONS, F.floor(pos / 5) % 5))
    sellers = F.replace(at(SELLERS, pos % 4), F.lit("{n}"), (pos % 7).cast("string"))
    offer = F.when(pos % 3 == 0, F.lit('<div id="tp_feature_div">Buy 3, save $5 now.</div>')).otherwise(F.lit(""))
    page = F.concat(F.lit('<body><a id="bylineInfo">Visit the '), F.col("brand"), F.lit(" Store</a>"), origin, sellers, offer, F.lit("</body>"))
    pages = listings(spark, sf_dir).select(pos.alias("page_id"), F.when(pos % 11 == 1, F.lit("<p>Enter the characters you see below</p>")).when(pos % 11 > 1, page).alias("html"))
    read = page_cards.product_details(pages, "retailer")
    return read.select(F.col("page_id").alias("pos"), "brand", "country", "other_sellers", "other_min_price", F.col("multi_buy.min_quantity").alias("quantity"), F.col("completeness").isNotNull().alias("read"))
