"""Predicate chain over listings: show, dim or hide, with explanation and attribution.

The chain is one CASE expression: the first predicate that does not show decides, and dimming ends the chain. Unknown values pass
unless a predicate says otherwise. Brand lists are DataFrames joined as semi-join flags, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suspicious_brand


@dataclass(frozen=True)
class FilterSpec:
    """Parameters of a filter run; the defaults filter nothing."""

    hide_sponsored: bool = False
    exclude_tokens: tuple[str, ...] = ()
    excluded_brands: tuple[str, ...] = ()
    min_reviews: int = 0
    min_rating: float | None = None
    price_min: float | None = None
    price_max: float | None = None
    use_effective_price: bool = False
    brand_mode: str = "off"
    seller_filter: str = "any"
    min_review_quality: int = 0
    origin_include: tuple[str, ...] = ()
    origin_exclude: tuple[str, ...] = ()
    hide_unknown_origin: bool = False
    ignored_categories: tuple[str, ...] = ()


#: Preset bundles of fetch parameters, by bandwidth.
BANDWIDTH_PRESETS = {
    "low": {"pages": 1, "fetch_reviews": False, "fetch_details": False},
    "balanced": {"pages": 2, "fetch_reviews": True, "fetch_details": False},
    "high": {"pages": 5, "fetch_reviews": True, "fetch_details": True},
}


def infer_preset(values: dict) -> str:
    """The name of the preset that has these values, or custom."""
    return next((name for name, v in BANDWIDTH_PRESETS.items() if v == values), "custom")


def tokens(text: str, newlines: bool = True) -> tuple[str, ...]:
    """A typed list: parts between commas (and line ends), trimmed, without empty ones."""
    return tuple(t.strip() for t in (text.replace("\n", ",") if newlines else text).split(",") if t.strip())


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def has_token(wanted: tuple[str, ...]) -> Column:
    text = F.lower(F.concat_ws(" ", "title", "brand"))
    return _any([F.contains(text, F.lit(t.strip().lower())) for t in wanted if t.strip()])


def has_brand(wanted: tuple[str, ...]) -> Column:
    return F.coalesce(_any([F.contains(F.lower("brand"), F.lit(b.lower())) for b in wanted if b]), F.lit(False)) & (F.coalesce("brand", F.lit("")) != "")


def seller_passes(kind: str) -> Column:
    f = F.col("seller.fulfillment")
    allowed = {"retailer": ("retailer",), "fba": ("retailer", "fba"), "third-party": ("third-party",)}.get(kind)
    return F.lit(True) if allowed is None else F.col("seller").isNull() | F.coalesce(f.isin(*allowed), F.lit(False))


def origin_passes(spec: FilterSpec) -> Column:
    origin = F.lower("country_of_origin")
    known = F.coalesce(F.col("country_of_origin"), F.lit("")) != ""
    shown = ~_any([F.contains(origin, F.lit(c.lower())) for c in spec.origin_exclude])
    if spec.origin_include:
        shown = shown & _any([F.contains(origin, F.lit(c.lower())) for c in spec.origin_include])
    return F.when(~known, F.lit(not spec.hide_unknown_origin)).otherwise(shown)


def price_of(spec: FilterSpec) -> Column:
    return F.coalesce("effective_price", "price") if spec.use_effective_price else F.col("price")


def brand_verdict(mode: str, trusted: Column, blocked: Column) -> Column:
    """show, dim or hide by the mode; blocked brands are hidden in every mode but off."""
    empty = F.coalesce(F.col("brand"), F.lit("")) == ""
    rest = {
        "trusted-only": F.when(trusted, "show").otherwise("hide"),
        "hide": F.when(trusted, "show").when(suspicious_brand(F.col("brand")) >= 0.5, "hide").otherwise("show"),
        "dim": F.when(trusted, "show").otherwise("dim"),
    }.get(mode)
    if rest is None:
        return F.lit("show")
    return F.when(empty, "hide" if mode == "trusted-only" else "show").when(blocked, "hide").otherwise(rest)


def predicates(spec: FilterSpec) -> list[tuple[str, Column]]:
    """(name, hides) in the order of evaluation; the brand mode stands between price and seller."""
    p, rating = price_of(spec), F.col("rating")
    if spec.ignored_categories:
        rating = F.coalesce("adjusted_rating", "rating")
    hides: list[tuple[str, Column]] = [
        ("sponsored", F.lit(spec.hide_sponsored) & F.col("is_sponsored")),
        ("keyword", has_token(spec.exclude_tokens)),
        ("brand", has_brand(spec.excluded_brands)),
        ("reviews", F.col("review_count") < spec.min_reviews),
        ("rating", F.lit(False) if spec.min_rating is None else (F.col("rating") > 0) & (rating < spec.min_rating)),
        ("price", F.coalesce((F.lit(False) if spec.price_min is None else p < spec.price_min) | (F.lit(False) if spec.price_max is None else p > spec.price_max), F.lit(False))),
        ("brand-mode", F.lit(False)),
        ("seller", ~seller_passes(spec.seller_filter)),
        ("quality", F.coalesce(F.col("review_quality") < spec.min_review_quality, F.lit(False))),
    ]
    by_origin = spec.origin_include or spec.origin_exclude or spec.hide_unknown_origin
    return [*hides, ("origin", ~origin_passes(spec) if by_origin else F.lit(False))]


def filter_result(spec: FilterSpec, trusted: Column | None = None, blocked: Column | None = None) -> Column:
    """The verdict on a listing."""
    verdict = brand_verdict(spec.brand_mode, F.lit(False) if trusted is None else trusted, F.lit(False) if blocked is None else blocked)
    out = F
    for name, hides in predicates(spec):
        out = out.when(verdict != "show", verdict) if name == "brand-mode" else out.when(hides, F.lit("hide"))
    return out.otherwise(F.lit("show"))


def hidden_by(spec: FilterSpec) -> Column:
    """Attribution of hidden rows to the first of a few coarse reasons; its own order, null prices by the raw price."""
    p = F.col("price")
    return (
        F.when(F.lit(spec.hide_sponsored) & F.col("is_sponsored"), "sponsored")
        .when(F.col("review_count") < spec.min_reviews, "reviews")
        .when((F.col("rating") > 0) & (F.col("rating") < (spec.min_rating or 0)), "rating")
        .when(F.coalesce((p < (spec.price_min or 0)) | (p > (spec.price_max or float("inf"))), F.lit(False)), "price")
        .otherwise("other")
    )


def explain(spec: FilterSpec) -> Column:
    """array<struct<filter, passed>>: the checks shown to a user. Not the chain: an excluded brand is equality here, rating 0 fails,
    prices are raw."""
    p = F.col("price")
    rows = [
        ("reviews", F.col("review_count") >= spec.min_reviews, spec.min_reviews > 0),
        ("rating", F.col("rating") >= (spec.min_rating or 0), spec.min_rating is not None),
        ("price", F.coalesce((p >= (spec.price_min or 0)) & (p <= (spec.price_max or float("inf"))), F.lit(True)), spec.price_min is not None or spec.price_max is not None),
        ("brand", ~F.lower("brand").isin(*[b.lower() for b in spec.excluded_brands] or [""]), bool(spec.excluded_brands)),
        ("trusted", F.col("brand_certain"), spec.brand_mode != "off"),
        ("sponsored", ~F.col("is_sponsored"), spec.hide_sponsored),
    ]
    used = [F.struct(F.lit(n).alias("filter"), c.alias("passed")) for n, c, on in rows if on]
    return F.array(*used) if used else F.expr("array()").cast("array<struct<filter: string, passed: boolean>>")


def with_brand_flags(df: DataFrame, allowed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Adds is_trusted and is_blocked. A brand is trusted if it is listed, if it begins with a listed one (three letters or more) and
    a space or hyphen, or if a listed one begins with it (three letters or more) and a space. The prefixes of a brand, and those of
    the list's entries, are exploded, so every test is an equi-join."""
    brand = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    brands = df.select(brand.alias("b")).distinct().where("b <> '' AND b <> 'unknown'")
    entries = allowed.select(F.lower(F.trim("brand")).alias("e")).where("e <> ''").distinct()
    ends = F.filter(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("b") - 1)), lambda i: (i < F.length("b")) & F.substr(F.col("b"), i + 1, F.lit(1)).isin(" ", "-"))
    begun = brands.select("b", F.explode(F.transform(ends, lambda i: F.substr(F.col("b"), F.lit(1), i))).alias("e"))
    heads = F.filter(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("e") - 1)), lambda i: (i < F.length("e")) & (F.substr(F.col("e"), i + 1, F.lit(1)) == " "))
    longer = entries.select(F.explode(F.transform(heads, lambda i: F.substr(F.col("e"), F.lit(1), i))).alias("b"))
    trusted = brands.join(entries, F.col("b") == F.col("e"), "left_semi").unionByName(begun.join(entries, "e", "left_semi").select("b")).unionByName(brands.join(longer, "b", "left_semi")).distinct()
    no = blocked.select(F.lower(F.trim("brand")).alias("nb")).distinct().withColumn("is_blocked", F.lit(True))
    marked = df.withColumn("__brand", brand).join(trusted.withColumn("is_trusted", F.lit(True)), F.col("__brand") == F.col("b"), "left").join(no, F.col("__brand") == F.col("nb"), "left")
    return marked.drop("__brand", "b", "nb").withColumn("is_trusted", F.coalesce("is_trusted", F.lit(False))).withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))


def pushed_price_bound(price_max: float, coupon_buffer: float = 1.3) -> Column:
    """What a source may drop before coupons are known; the exact predicate runs on the rest."""
    return F.col("price").isNull() | (F.col("price") <= price_max * coupon_buffer)


def quiet(ts: Column, start_hour: int, end_hour: int) -> Column:
    """Whether a time lies in quiet hours; they may span midnight, and equal hours mean none."""
    h = F.hour(ts)
    if start_hour == end_hour:
        return F.lit(False)
    return h.between(start_hour, end_hour - 1) if start_hour < end_hour else (h >= start_hour) | (h < end_hour)
