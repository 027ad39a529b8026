"""Cases of the page readers beyond what the queries generate: cascades, defaults, missing parts."""

from pyspark.sql import functions as F

from wareflow.functions import labels
from wareflow.operators import departments
from wareflow.sources import cards


def one(spark, column, html=""):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first().x


def test_card_defaults(spark):
    df = spark.createDataFrame([(1, "<div></div>"), (2, None)], "pos long, html string")
    for r in cards.read_cards(df).collect():
        assert (r.review_count, r.rating, r.price, r.list_price, r.is_sponsored, r.has_deal_badge, r.sns_percent, r.asin) == (0, 0.0, None, None, False, False, None, None)
    assert [r.brand for r in cards.read_cards(df).collect()] == ["Unknown", "Unknown"]
    assert [r.price for r in cards.read_discount_cards(df).collect()] == [None, None]


def test_card_cascades(spark):
    html = F.col("html")
    assert one(spark, cards.review_count(html), '<a href="#customerReviews"><span>none</span></a><span class="s-underline-text">1.2K</span>') == 1200
    assert one(spark, cards.sponsored(html), '<span class="a-color-secondary">Sponsored by X</span>') is True
    assert one(spark, cards.sponsored(html), '<span class="a-color-secondary">Adapter</span>') is False
    assert one(spark, cards.list_price(html), '<span class="a-text-price a-size-mini"><span class="a-offscreen">$9</span></span>') is None
    assert one(spark, cards.subscribe_percent(html), "<p>Subscribe and Save gives 15 % off</p>") == 15
    assert one(spark, cards.coupon(html), '<span class="s-coupon-x">$5 off today</span>').value == 5.0
    assert one(spark, cards.brand(html, F.lit("the lamp")), "<div><span>by The Owner</span></div>") == "Unknown"


def test_histogram_needs_all_bars(spark):
    bar = '<tr aria-label="{}%"><td><a href="?filterByStar=x">s</a></td></tr>'
    assert one(spark, cards.histogram(F.col("html")), "".join(bar.format(k) for k in (50, 25, 12, 8))) is None
    assert tuple(one(spark, cards.histogram(F.col("html")), "".join(bar.format(k) for k in (50, 25, 12, 8, 5)))) == (50, 25, 12, 8, 5)


def test_page_reviews_are_ten_with_defaults(spark):
    page = "".join(f'<div data-hook="review"><span data-hook="review-body">t{k}</span></div>' for k in range(14))
    got = one(spark, cards.page_reviews(F.col("html")), page)
    assert [r.text for r in got] == [f"t{k}" for k in range(10)]
    assert (got[0].rating, got[0].verified, got[0].helpful_votes, got[0].ts.timestamp()) == (0.0, False, 0, 0.0)
    assert one(spark, cards.page_reviews(F.col("html")), None) == []


def test_seller_of_documents(spark):
    seller = cards.document_seller(F.col("html"), "retailer")
    assert tuple(one(spark, seller, '<p id="merchant-info">Ships from and sold by Retailer.com.</p>')) == ("Retailer.com", "retailer")
    assert one(spark, seller, "<p>nothing</p>") is None


def test_departments(spark):
    of = lambda url, crumb="": tuple(one(spark, departments.department(F.lit(url), F.lit(crumb))))
    assert of("https://s/?k=a&rh=n%3A172282%2Cp_36%3A1") == ("172282", "Electronics")
    assert of("https://s/?k=a&rh=n%3A5") == ("5", None) and of("https://s/?k=a&i=grocery") == ("16310101", "Grocery & Gourmet Food")
    assert of("https://s/?k=a", "Any > Toys & Games") == ("2619525011", "Toys & Games") and of("https://s/?k=a") == (None, None)
    assert one(spark, departments.topic_weight(F.lit("172282"), F.lit("value"))) == 1.0


def test_short_texts(spark):
    assert one(spark, labels.quote(F.lit('"' + "a" * 130 + '"'))) == "a" * 119 + "…"
    assert one(spark, labels.price_line(F.lit(0.0), F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert one(spark, labels.sentiment_split(F.lit(0), F.lit(0))) == 50.0 and one(spark, labels.time_saved(F.lit(125))) == "2h 5m"
    assert one(spark, labels.valid_item_id(F.lit("B08N5WRWN"))) is False and one(spark, labels.valid_domain(F.lit("evil"), ("a", "b"))) == "a"


def test_local_prices(spark):
    price = lambda html, c: one(spark, cards.local_price(F.lit(html), F.lit(c)))
    assert price('class="a-offscreen"> 1.234,56 €', "EUR") == 1234.56 and price('class="a-offscreen">₹1,23,456.78', "INR") == 123456.78
    assert price('"priceAmount": 12.5', "GBP") == 12.5 and price('a-price-whole">1,234<x a-price-fraction">50<', "USD") == 1234.5 and price("none", "USD") is None
