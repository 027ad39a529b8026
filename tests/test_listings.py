from pyspark.sql import functions as F

from wareflow.functions.numbers import half_up
from wareflow.functions.text import suspicious_brand
from wareflow.operators import dedup, filters, ranking, scoring
from wareflow.sources.tables import union_pages

SCHEMA = (
    "pos long, asin string, title string, brand string, price double, list_price double, rating double, review_count long, is_sponsored boolean, has_deal_badge boolean, "
    "sns_percent double, review_quality int, country_of_origin string, brand_certain boolean, coupon struct<type: string, value: double>, "
    "seller struct<seller_name: string, fulfillment: string, other_sellers_count: int, other_sellers_min_price: double>"
)
DEFAULT = dict(
    asin="B08N5WRWNW", title="Test Product Title", brand="TestBrand", price=29.99, list_price=None, rating=4.0, review_count=100, is_sponsored=False, has_deal_badge=False,
    sns_percent=None, review_quality=None, country_of_origin=None, brand_certain=True, coupon=None, seller=None,
)


def make(spark, *rows):
    names = [c.split(" ")[0] for c in ("pos", *DEFAULT)]
    return spark.createDataFrame([tuple({"pos": i, **DEFAULT, **r}[n] for n in names) for i, r in enumerate(rows)], SCHEMA).cache()


def test_half_up_rounds_towards_plus_infinity(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (1.005,)], "x double").select(half_up(F.col("x")), half_up(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [-2.0, 3.0, 1.0]


def test_price_orders_put_null_last(spark):
    df = make(spark, {"price": 5.0}, {"price": None}, {"price": 1.0}, {"price": 9.0})
    assert [r.pos for r in ranking.sort_listings(df, "price-low").collect()] == [2, 0, 3, 1]
    assert [r.pos for r in ranking.sort_listings(df, "price-high").collect()] == [3, 0, 2, 1]


def test_value_order(spark):
    df = make(spark, {"rating": 4.0, "review_count": 50, "price": 100.0}, {"rating": 4.5, "review_count": 500, "price": 10.0})
    assert ranking.sort_listings(df, "value").first().pos == 1


def test_variants_keep_most_reviews_then_rating(spark):
    df = make(spark, {"title": "Case Black", "review_count": 500, "rating": 3.5}, {"title": "Case White", "review_count": 100, "rating": 4.8}, {"title": "Mug Red", "rating": 3.5}, {"title": "Mug Blue", "rating": 4.5})
    hidden = {r.pos for r in dedup.variant_duplicates(df, ("color",)).where("is_duplicate").collect()}
    assert hidden == {1, 2}
    assert dedup.variant_duplicates(df, ()).where("is_duplicate").count() == 0


def test_fuzzy_groups_need_one_brand(spark):
    t = "wireless bluetooth headphones noise cancelling over ear"
    df = make(spark, {"title": t, "asin": "1"}, {"title": t + " pro", "asin": "2", "review_count": 900}, {"title": t, "asin": "3", "brand": "Other"}, {"title": "usb speaker", "asin": "4"})
    got = {r.pos: r.is_best for r in dedup.duplicate_groups(df).collect()}
    assert got == {0: False, 1: True}


def test_dimming_ends_the_chain(spark):
    df = make(spark, {"review_quality": 5})
    spec = filters.FilterSpec(brand_mode="dim", min_review_quality=50)
    assert df.select(filters.filter_result(spec)).first()[0] == "dim"
    assert df.select(filters.filter_result(spec, F.lit(True))).first()[0] == "hide"


def test_unknown_values_pass(spark):
    df = make(spark, {"price": None, "rating": 0.0})
    spec = filters.FilterSpec(price_min=1, price_max=2, min_rating=4.5, seller_filter="fba", min_review_quality=90, origin_exclude=("China",))
    assert df.select(filters.filter_result(spec)).first()[0] == "show"


def test_filtering_twice_changes_nothing(spark):
    df = make(spark, *({"price": float(i), "review_count": i} for i in range(20)))
    spec = filters.FilterSpec(min_reviews=5, price_max=15)
    once = df.where(filters.filter_result(spec) == "show")
    assert sorted(r.pos for r in once.where(filters.filter_result(spec) == "show").collect()) == sorted(r.pos for r in once.collect())


def test_great_and_suspicious_deals(spark):
    df = make(
        spark, {"price": 29.99, "list_price": 49.99, "coupon": ("percent", 10.0), "has_deal_badge": True, "review_quality": 80}, {"price": 9.99, "list_price": 49.99, "review_count": 5},
        {"price": 19.99, "list_price": 59.99}, {"price": 25.0, "list_price": 50.0}, {"price": 25.0, "list_price": 50.0, "has_deal_badge": True}, {},
    )
    got = [r.s for r in df.orderBy("pos").select(scoring.deal_score().alias("s")).collect()]
    assert got[0].label == "Great Deal"
    assert [s and s.n_warnings for s in got] == [0, 1, 1, 1, 0, None]
    history = df.where("pos = 0").select(scoring.deal_score(F.lit(25.0)).alias("s")).first().s
    assert history.n_warnings == 1


def test_savings_stack(spark):
    df = make(spark, {"price": 80.0, "list_price": 100.0, "coupon": ("percent", 10.0), "sns_percent": 5.0}, {"price": 40.0, "list_price": 50.0, "has_deal_badge": True}, {"has_deal_badge": True})
    a, b, c = (r.s for r in df.orderBy("pos").select(scoring.savings_stack().alias("s")).collect())
    assert [round(x.amount, 2) for x in a.layers] == [20.0, 8.0, 3.6] and a.effective_price == 68.4 and a.color == "green"
    assert b.layers[1].amount == 0 and b.effective_price == 40.0 and c is None


def test_sales_and_margins(spark):
    one = spark.range(1)
    assert one.select(scoring.monthly_sales(F.lit(1000), F.lit("?")).alias("s")).first().s.estimate == 500
    m = one.select(scoring.margin(F.lit(29.99), F.lit(10.0), F.lit(1.0)).alias("m"), scoring.margin(F.lit(15.0), F.lit(10.0), F.lit(1.0)).alias("n")).first()
    assert m.m.fulfilment_fee == 3.86 and abs(m.m.profit - 11.63) < 0.02 and m.m.viable and not m.n.viable


def test_suspicious_brand_bounds(spark):
    rows = spark.createDataFrame([("Apple",), ("XKQZ",), ("",), (None,)], "b string").select(suspicious_brand(F.col("b"))).collect()
    assert rows[0][0] == 0.0 and rows[1][0] >= 0.5 and rows[2][0] == rows[3][0] == 1.0


def test_pages_keep_first_and_all_without_id(spark):
    a, b = make(spark, {"asin": "x"}, {"asin": None}), make(spark, {"asin": "x"}, {"asin": None}, {"asin": "y"})
    assert sorted(str(r.asin) for r in union_pages([a, b]).collect()) == ["None", "None", "x", "y"]


def test_estimates_at_a_half_are_those_of_sql(spark):
    import duckdb

    knots = ", ".join(f"({k}, {r}, {s})" for k, (r, s) in enumerate(scoring.SALES_CURVES["default"]))
    sql = f"""WITH k(i, r, s) AS (VALUES {knots}) SELECT rank, floor(arg_min(a.s * pow(b.s::DOUBLE / a.s, ln(rank / a.r::DOUBLE) / ln(b.r::DOUBLE / a.r)), a.r) + 0.5)::INT
      FROM (SELECT unnest([1, 79999, 80000, 80001, 250000, 400000, 1000000]) AS rank) JOIN k a ON rank >= a.r JOIN k b ON b.i = a.i + 1 AND rank <= b.r GROUP BY rank ORDER BY rank"""
    ranks = spark.createDataFrame([(r,) for r in (1, 79999, 80000, 80001, 250000, 400000, 1000000)], "rank long")
    got = ranks.select("rank", scoring.monthly_sales(F.col("rank"), F.lit("none"))["estimate"]).orderBy("rank").collect()
    assert list(map(tuple, got)) == duckdb.sql(sql).fetchall()
    assert [r[1] for r in got][2:6] == [12, 12, 4, 2]
