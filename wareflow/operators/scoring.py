"""Scorecards over listings: savings, deals, sellers, listings, warnings, resale. Each is one expression tree without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp, first_of, half_up, half_up_int, label
from ..functions.parse import is_retailer

RETAILER = "retailer"
#: Brands that are often counterfeited.
PREMIUM_BRANDS = (
    "apple", "samsung", "sony", "bose", "nike", "adidas", "lego", "dyson", "nintendo", "playstation", "xbox", "microsoft", "logitech", "anker", "beats", "jbl",
    "north face", "patagonia", "yeti", "kitchenaid", "instant pot", "vitamix", "breville", "cuisinart", "dewalt", "makita", "milwaukee", "bosch", "stanley",
)
#: Monthly sales by best-seller rank.
SALES_CURVES = {
    "default": ((1, 10000), (10, 5000), (50, 3000), (100, 2000), (250, 1200), (500, 800), (1000, 500), (2500, 250), (5000, 150), (10000, 80), (25000, 40), (50000, 20), (100000, 10), (250000, 4), (500000, 2), (1000000, 1)),
    "Electronics": ((1, 8000), (10, 4000), (50, 2500), (100, 1500), (250, 900), (500, 600), (1000, 400), (2500, 200), (5000, 100), (10000, 60), (25000, 30), (50000, 15), (100000, 8), (250000, 3), (500000, 1)),
    "Home & Kitchen": ((1, 12000), (10, 6000), (50, 3500), (100, 2500), (250, 1500), (500, 1000), (1000, 600), (2500, 300), (5000, 180), (10000, 100), (25000, 50), (50000, 25), (100000, 12), (250000, 5), (500000, 2)),
    "Toys & Games": ((1, 9000), (10, 4500), (50, 2800), (100, 1800), (250, 1000), (500, 700), (1000, 450), (2500, 220), (5000, 130), (10000, 70), (25000, 35), (50000, 18), (100000, 9), (250000, 3), (500000, 1)),
}
#: What an estimate has to be above a half to be rounded up.
HALF = 1e-9
#: Fulfilment fee by weight in pounds, up to each bound; beyond the last 0.40 for each further pound begun.
FEES, FEE_STEP = ((0.25, 3.22), (0.5, 3.40), (1.0, 3.86), (1.5, 4.08), (2.0, 4.76), (3.0, 5.40)), 0.40


def signal(points: Column | int, kind: str, when: Column) -> Column:
    """A struct<type, points>, or null where the condition does not hold."""
    p = F.lit(points) if isinstance(points, int) else points
    return F.when(when, F.struct(F.lit(kind).alias("type"), p.cast("int").alias("points")))


def total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda a, s: a + s["points"])


def discount_percent() -> Column:
    cheaper = F.coalesce(F.col("list_price") > F.col("price"), F.lit(False))
    return F.when(cheaper, (F.col("list_price") - F.col("price")) / F.col("list_price") * 100).otherwise(0.0)


def coupon_percent() -> Column:
    v, p = F.col("coupon.value"), F.col("price")
    return F.coalesce(F.when(F.col("coupon.type") == "percent", v).when((F.col("coupon.type") == "amount") & (p > 0) & (v > 0), v / (p + v)  * 100), F.lit(0.0))


def savings_stack() -> Column:
    """struct<layers, total_percent, total_amount, effective_price, base_price, color>; null without a real saving.

    Mark-down, then coupon on the running price, then subscription on what remains; a deal badge adds a layer of 0.
    """
    p, lp, c, sns = F.col("price"), F.col("list_price"), F.col("coupon"), F.col("sns_percent")
    marked = F.coalesce(lp > p, F.lit(False))
    base = F.when(marked, lp).otherwise(p)
    off_coupon = F.coalesce(F.when(c["type"] == "percent", p * c["value"] / 100).when(c["type"] == "amount", F.least(c["value"], p)), F.lit(0.0))
    after = p - off_coupon
    off_sns = F.coalesce(F.when(sns > 0, after * (sns / 100)), F.lit(0.0))
    paid = F.greatest(F.lit(0.0), after - off_sns)

    def layer(kind: str, percent: Column, amount: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), percent.cast("double").alias("percent"), amount.cast("double").alias("amount")))

    layers = F.array_compact(
        F.array(
            layer("list-discount", discount_percent(), lp - p, marked),
            layer("coupon", F.when(c["type"] == "percent", c["value"]).otherwise(off_coupon / p * 100), off_coupon, off_coupon > 0),
            layer("subscribe-save", sns, off_sns, off_sns > 0),
            layer("deal-badge", F.lit(0), F.lit(0), F.coalesce("has_deal_badge", F.lit(False))),
        )
    )
    percent = (base - paid) / base * 100
    real = marked | (off_coupon > 0) | (off_sns > 0)
    color = F.when(percent >= 30, "green").when(percent >= 15, "amber").otherwise("gray")
    return F.when(
        (p > 0) & real,
        F.struct(layers.alias("layers"), percent.alias("total_percent"), (base - paid).alias("total_amount"), half_up(paid, 2).alias("effective_price"), base.alias("base_price"), color.alias("color")),
    )


def deal_signals(reference_price: Column | None = None) -> Column:
    """The signals of a deal as array<struct<type, points>>; reference_price is a tracked earlier price."""
    p, lp, badge = F.col("price"), F.col("list_price"), F.coalesce("has_deal_badge", F.lit(False))
    d, c, quality, sns = discount_percent(), coupon_percent(), F.col("review_quality"), F.col("sns_percent")
    marked, markup = F.coalesce(lp > p, F.lit(False)), F.try_divide(lp, p)
    has_coupon = F.coalesce((F.col("coupon.type") == "percent") | (c > 0), F.lit(False))
    found = [
        signal(F.least(F.lit(40), half_up_int(d * 0.8)), "discount", marked),
        signal(F.least(F.lit(20), half_up_int(c * 0.5)), "coupon", has_coupon),
        signal(F.least(F.lit(15), half_up_int(sns * 0.4)), "coupon", sns > 0),
        signal(15, "deal-badge", badge),
        signal(10, "review-trust", (quality >= 70) & (d >= 15)),
        signal(-15, "suspicious", (d >= 40) & (F.col("review_count") < 20) & ~badge),
        signal(-10, "suspicious", (d >= 40) & (quality < 40)),
        signal(F.when(markup >= 2.5, -20).otherwise(-10), "manipulation", marked & ((markup >= 2.5) | ((markup >= 2.0) & ~badge))),
        signal(-8, "manipulation", F.col("coupon").isNotNull() & p.isNotNull() & lp.isNull() & (c >= 30)),
        signal(-12, "manipulation", (d >= 20) & (c >= 20) & (d + c >= 60)),
    ]
    if reference_price is not None:
        found += [
            signal(-15, "manipulation", (reference_price > 0) & lp.isNotNull() & (p > reference_price * 1.05)),
            signal(-10, "manipulation", (reference_price > 0) & (lp > reference_price * 1.3) & (reference_price > p)),
        ]
    return F.array_compact(F.array(*found))


def deal_score(reference_price: Column | None = None) -> Column:
    """struct<score, label, effective_discount, n_warnings>; null without any deal signal."""
    signals = deal_signals(reference_price)
    score = clamp(total(signals)).cast("int")
    odd = F.exists(signals, lambda s: s["type"] == "manipulation")
    suspect = F.exists(signals, lambda s: s["type"].isin("manipulation", "suspicious"))
    name = first_of((odd & (score < 25), "Inflated Pricing"), (suspect & (score < 20), "Suspicious Discount"), (score >= 60, "Great Deal"), (score >= 35, "Good Deal"), rest="Normal Price")
    d, c, s = discount_percent(), coupon_percent(), F.coalesce(F.greatest(F.col("sns_percent"), F.lit(0.0)), F.lit(0.0))
    extra = c + s * (1 - c / 100)
    effective = F.when(d >= 99, 99).otherwise(F.least(F.lit(99), half_up_int(d + extra * (1 - d / 100))))
    any_signal = (F.coalesce("list_price", F.lit(0.0)) > 0) | F.col("coupon").isNotNull() | F.coalesce("has_deal_badge", F.lit(False)) | (F.coalesce("sns_percent", F.lit(0.0)) > 0)
    warnings = F.size(F.filter(signals, lambda x: x["type"] == "manipulation"))
    return F.when(any_signal, F.struct(score.alias("score"), name.alias("label"), effective.cast("int").alias("effective_discount"), warnings.alias("n_warnings")))


def _seller() -> tuple[Column, Column, Column, Column, Column]:
    name, kind = F.col("seller.seller_name"), F.col("seller.fulfillment")
    own = (kind == RETAILER) | is_retailer(name, RETAILER)
    brand = F.coalesce("brand", F.lit(""))
    alike = F.contains(F.lower(name), F.lower(brand)) | F.contains(F.lower(brand), F.lower(name))
    return name, kind, own, brand, alike


def seller_trust() -> Column:
    """struct<score, label, fulfillment, brand_match, name_quality, review_price>: points around 50; null without a seller."""
    name, kind, own, brand, alike = _seller()
    t, p, n = F.trim(name), F.col("price"), F.col("review_count")
    fulfilment = F.when(kind == RETAILER, 25).when(kind == "fba", 10).otherwise(-10)
    match = F.when(F.length(brand) < 2, 0).when(own, 10).when(alike, 15).otherwise(-5)
    quality = (
        F.when(own, 5).when(F.length(t) <= 2, -8).when(t.rlike(r"(?i)^(?=.*[0-9])[a-z0-9]{10,}$"), -10).when(t.rlike(r"(?i)^[a-z]{13,}$"), -6)
        .when(t.rlike(r"^[A-Z\s]{11,}$"), -3).otherwise(5)
    )
    ratio = F.try_divide(n.cast("double"), p)
    odd = F.when(F.coalesce(p <= 0, F.lit(True)) | (n < 100), 0).when((p < 10) & (ratio > 2000), -8).when((p < 15) & (ratio > 500), -4).otherwise(0)
    score = clamp(50 + fulfilment + match + quality + odd).cast("int")
    name_of = label(score, [(70, "trusted"), (45, "neutral"), (25, "caution")], "risky")
    return F.when(F.col("seller").isNotNull(), F.struct(score.alias("score"), name_of.alias("label"), fulfilment.alias("fulfillment"), match.alias("brand_match"), quality.alias("name_quality"), odd.alias("review_price")))


def listing_integrity() -> Column:
    """struct<score, label, seller_count, brand_listing, undercut, fulfillment_risk>: points around 50; null without a seller."""
    _, kind, own, brand, alike = _seller()
    others, p, low = F.coalesce("seller.other_sellers_count", F.lit(0)), F.col("price"), F.col("seller.other_sellers_min_price")
    count = F.when(own, 15).when(others >= 3, 10).when((others == 0) & (F.length(brand) > 2) & ~alike, -10).otherwise(0)
    listing = F.when(own | (F.length(brand) < 2), 5).when(alike, 15).when(F.col("review_count") >= 1000, -12).when(F.col("review_count") >= 100, -6).otherwise(-3)
    below = F.try_divide(low - p, low)
    undercut = F.when(F.coalesce((p <= 0) | (low <= 0), F.lit(True)), 0).when((below > 0.4) & ~own, -10).when((below > 0.2) & ~own, -4).when(below < -0.1, 5).otherwise(0)
    premium, dear = F.lower(brand).isin(*PREMIUM_BRANDS), F.coalesce(p >= 50, F.lit(False))
    risk = F.when(kind.isin(RETAILER, "fba"), 10).when(premium & dear, -8).when(premium | dear, -4).otherwise(0)
    score = clamp(50 + count + listing + undercut + risk).cast("int")
    name_of = label(score, [(70, "verified"), (45, "normal"), (25, "warning")], "alert")
    return F.when(F.col("seller").isNotNull(), F.struct(score.alias("score"), name_of.alias("label"), count.alias("seller_count"), listing.alias("brand_listing"), undercut.alias("undercut"), risk.alias("fulfillment_risk")))


def red_flags(trust: Column, quality_label: Column, seller: Column, integrity: Column, missing: Column, deal_label: Column) -> Column:
    """struct<verdict, flags, positives> from six inputs, any of them null: the first three flags and two positives are shown."""
    def listed(*pairs: tuple[str, Column]) -> Column:
        return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))

    flags = listed(("review-trust", trust < 60), ("review-quality", quality_label == "suspicious"), ("seller", seller < 50), ("listing", integrity < 45), ("fields", missing >= 3), ("price", deal_label.isin("Inflated Pricing", "Suspicious Discount")))
    positives = listed(("review-trust", trust >= 80), ("review-quality", quality_label == "authentic"), ("seller", seller >= 75), ("deal", deal_label == "Great Deal"))
    verdict = F.when(F.size(flags) >= 3, "high-risk").when(F.size(flags) >= 1, "caution").otherwise("low-risk")
    return F.struct(verdict.alias("verdict"), F.slice(flags, 1, 3).alias("flags"), F.slice(positives, 1, 2).alias("positives"))


def score_rows(**scores: Column) -> Column:
    """array<struct<dimension, score>> of the dimensions that are known; empty unless at least two are."""
    rows = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("dimension"), c.cast("int").alias("score"))) for n, c in scores.items())))
    return F.when(F.size(rows) >= 2, rows).otherwise(F.slice(rows, 1, 0))


def monthly_sales(rank: Column, category: Column) -> Column:
    """struct<estimate, confidence>: log-log interpolation between the knots around the rank.

    Halves are rounded down: at ranks 80,000 and 400,000 the default curve is at 12.5 and 2.5, which the floats of the SQL miss from below
    and Spark's hit. HALF is far above the noise of floats and far below the step from one rank to the next.
    """
    def on(curve: tuple) -> Column:
        out = F.when(rank < curve[0][0], F.lit(float(curve[0][1])))
        for (r1, s1), (r2, s2) in zip(curve, curve[1:]):
            out = out.when(rank <= r2, half_up(s1 * F.pow(F.lit(s2 / s1), F.log(rank / float(r1)) / math.log(r2 / r1)) - HALF))
        return out.otherwise(F.lit(1.0))

    special = F
    for name, curve in SALES_CURVES.items():
        if name != "default":
            special = special.when(category == name, on(curve))
    estimate = special.otherwise(on(SALES_CURVES["default"]))
    last = F
    for name, curve in SALES_CURVES.items():
        if name != "default":
            last = last.when(category == name, F.lit(curve[-1][0]))
    confidence = F.when(rank > last.otherwise(F.lit(SALES_CURVES["default"][-1][0])), "low").when(rank <= 10000, "high").when(rank <= 100000, "medium").otherwise("low")
    return F.struct(estimate.cast("int").alias("estimate"), confidence.alias("confidence"))


def margin(price: Column, cost: Column, weight: Column) -> Column:
    """struct<referral_fee, fulfilment_fee, profit, margin_percent, viable>."""
    referral = half_up(price * 0.15, 2)
    fee = F
    for bound, value in FEES:
        fee = fee.when(weight <= bound, F.lit(value))
    fee = fee.otherwise(FEES[-1][1] + F.ceil(weight - 3) * FEE_STEP)
    profit = half_up(price - cost - referral - fee, 2)
    percent = F.when(price > 0, half_up_int(profit / price * 100)).otherwise(0)
    return F.struct(referral.alias("referral_fee"), fee.alias("fulfilment_fee"), profit.alias("profit"), percent.alias("margin_percent"), (percent >= 20).alias("viable"))


def competition() -> Column:
    n, kind = F.coalesce("seller.other_sellers_count", F.lit(0)), F.col("seller.fulfillment")
    level = F.when(n <= 2, "low").when(n <= 5, "medium").otherwise("high")
    return F.struct((n + 1).alias("sellers"), level.alias("level"), F.coalesce(kind.isin("fba", RETAILER), F.lit(False)).alias("has_fba"), F.coalesce(kind == RETAILER, F.lit(False)).alias("has_retailer"))


def margin_scenarios(price: Column) -> Column:
    """Margins at costs of 25, 33 and 50 % of the price, one pound."""
    return F.array(*(margin(price, price * share, F.lit(1.0)) for share in (0.25, 0.33, 0.50)))


def severity(deduction: Column, most: Column) -> Column:
    share = F.try_divide(deduction.cast("double"), most.cast("double"))
    return F.when(deduction <= 0, "none").when(share >= 0.7, "high").when(share >= 0.4, "medium").otherwise("low")


def age_bucket(seconds: Column) -> Column:
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(
        F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago"))
    )


def backoff_ms(failures: Column) -> Column:
    """Delay before the next attempt; null (skip) from five failures on."""
    return F.when(failures < 5, F.least(F.lit(30000.0), 1000.0 * F.pow(F.lit(2.0), failures)).cast("long"))
