"""Fields of raw pages by regular expressions on the string column: no parser, no Python, whatever the mark-up leaves unclosed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.numbers import half_up_int, label

#: Fields of a complete listing and the pattern that shows each.
FIELDS = {
    "dimensions": r"(?i)dimensions?", "weight": r"(?i)weight", "materials": r"(?i)materials?|fabric", "manufacturer": r"(?i)manufacturer", "model-number": r"(?i)model (?:number|name)",
    "warranty": r"(?i)warranty", "ingredients": r"(?i)ingredients", "origin": r"(?i)country of origin", "spec-table": r"(?i)<table",
}
EXPECTED = {
    "default": (("description", "images", "bullet-points"), ("dimensions", "weight", "manufacturer")),
    "Electronics": (("dimensions", "weight", "manufacturer", "model-number", "spec-table"), ("warranty", "description", "images", "bullet-points")),
    "Home & Kitchen": (("dimensions", "weight", "materials"), ("description", "images", "bullet-points", "warranty")),
    "Grocery": (("ingredients", "weight"), ("description", "images", "manufacturer", "bullet-points")),
}


def first_group(html: Column, *patterns: str) -> Column:
    """The first group of the first pattern that is found, trimmed; null if none is."""
    return F.coalesce(*(F.when(html.rlike(p), F.trim(F.regexp_extract(html, p, 1))) for p in patterns))


def fallback_used(html: Column, *patterns: str) -> Column:
    """Number of the first pattern that is found (from 0), -1 if none is: a measure of how pages drift."""
    out = F
    for k, p in enumerate(patterns):
        out = out.when(html.rlike(p), F.lit(k))
    return out.otherwise(F.lit(-1))


def plain_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


TITLE = (r"(?is)<h1[^>]*>([^<]+)<", r"(?is)<title[^>]*>([^<]+)<", r'(?i)property="og:title"\s+content="([^"]+)"')


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, price, rank, seller fields, country, links and text length of each page; a blocked page gives nulls."""
    html, text = F.col("html"), plain_text(F.col("html"))
    ok = ~parse.blocked_page(F.coalesce(html, F.lit("")))
    wide = pages.select("page_id", "url", html, text.alias("text"), ok.alias("ok"))
    values = {
        "title": first_group(html, *TITLE), "title_strategy": fallback_used(html, *TITLE), "host": F.try_parse_url("url", F.lit("HOST")), "item_id": parse.item_id(F.col("url")),
        "price": parse.price_in_html(html), "rank": parse.parse_rank(F.col("text")), "coupon": parse.parse_coupon(F.col("text")),
        "country": parse.country(first_group(F.col("text"), r"(?i)country of origin\s*:?\s*([A-Za-z ]+?)(?:[.,;]|$)")), "n_links": F.regexp_count(html, F.lit(r"(?i)<a\s")), "text_chars": F.length("text"),
    }
    return wide.select("page_id", "ok", *(F.when(F.col("ok"), v).alias(k) for k, v in values.items()))


def completeness(html: Column, department: str = "default") -> Column:
    """struct<score, present, missing_important, label>: required fields weigh 10, recommended 5, others 2."""
    required, recommended = EXPECTED.get(department, EXPECTED["default"])
    found = {k: html.rlike(p) for k, p in FIELDS.items()} | {
        "images": F.regexp_count(html, F.lit(r"(?i)<img")) >= 3, "bullet-points": F.regexp_count(html, F.lit(r"(?i)<li")) >= 3, "description": F.length(plain_text(html)) > 50,
    }
    points = {k: 10 if k in required else 5 if k in recommended else 2 for k in found}
    earned = sum((F.when(c, points[k]).otherwise(0) for k, c in found.items()), F.lit(0))
    score = half_up_int(earned * 100.0 / sum(points.values()))
    missing = sum((F.when(~c, 1).otherwise(0) for k, c in found.items() if points[k] > 2), F.lit(0))
    present = sum((c.cast("int") for c in found.values()), F.lit(0))
    return F.struct(score.alias("score"), present.alias("present"), missing.alias("missing_important"), label(score, [(80, "complete"), (55, "adequate"), (30, "sparse")], "poor").alias("label"))


def search_url(base: str, query: str, exclude: tuple[str, ...] = (), department: str | None = None, price_max: float | None = None, sort: str | None = None, coupon_buffer: float = 1.3) -> str:
    """A search URL that pushes predicates to the source: exclusions, department, a widened price bound in cents, order."""
    from urllib.parse import urlencode

    words = " ".join([query, *(f"-{t}" for t in exclude)])
    parts = {"k": words} | ({"i": department} if department else {}) | ({"high-price": str(round(price_max * coupon_buffer * 100))} if price_max else {}) | ({"s": sort} if sort else {})
    return f"{base}?{urlencode(parts)}"


def parse_search_url(url: Column) -> Column:
    """struct<query, excluded, department, price_max>: the reverse of search_url, for a column of URLs."""
    words = F.split(F.url_decode(F.regexp_extract(url, r"[?&]k=([^&#]*)", 1)), " ")
    return F.struct(
        F.array_join(F.filter(words, lambda w: ~w.startswith("-")), " ").alias("query"), F.transform(F.filter(words, lambda w: w.startswith("-")), lambda w: F.substr(w, F.lit(2))).alias("excluded"),
        F.nullif(F.regexp_extract(url, r"[?&]i=([^&#]*)", 1), F.lit("")).alias("department"), (F.regexp_extract(url, r"[?&]high-price=([0-9]+)", 1).try_cast("double") / 100).alias("price_max"),
    )


def media_counts(items: DataFrame) -> DataFrame:
    """asin, images, videos, verified, with_media: media (asin, review_idx, kind, thumbnail, verified) counted once per review and thumbnail."""
    once = items.dropDuplicates(["asin", "review_idx", "thumbnail"])
    return once.groupBy("asin").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if("verified").alias("verified"), F.count_distinct("review_idx").alias("with_media"))


def large_image(url: Column) -> Column:
    """The full-size address of a thumbnail: without the size part before the extension."""
    return F.regexp_replace(url, r"\._[^/]*_\.(jpg|png|webp)$", ".$1")
