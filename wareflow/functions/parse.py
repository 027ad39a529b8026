"""Text to values: counts, ratings, prices, item ids, sellers, ranks, offers, countries, URLs. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import first_of, half_up, let

#: Aliases of countries.
COUNTRIES = {
    "usa": "United States", "us": "United States", "united states": "United States", "united states of america": "United States",
    "china": "China", "cn": "China", "prc": "China", "uk": "United Kingdom", "united kingdom": "United Kingdom", "great britain": "United Kingdom",
    "south korea": "South Korea", "korea": "South Korea", "republic of korea": "South Korea", "japan": "Japan", "jp": "Japan",
    "germany": "Germany", "deutschland": "Germany", "u.s.a.": "United States", "u.s.a": "United States", "u.s.": "United States", "u.k.": "United Kingdom", "people's republic of china": "China", "p.r.c.": "China",
    "korea, republic of": "South Korea", "taiwan, province of china": "Taiwan", "viet nam": "Vietnam",
}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def parse_count(text: Column) -> Column:
    """'1,234', '12.5K', '1.2M' as a whole number; 0 if it is none."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit(""))
    short = r"^([0-9.]+)\s*([kKmMbB])$"
    unit = F.lower(F.regexp_extract(clean, short, 2))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1e9)
    big = half_up(F.regexp_extract(clean, short, 1).try_cast("double") * scale)
    plain = F.regexp_extract(clean, r"^([+-]?[0-9]+)", 1).try_cast("long")
    return F.coalesce(F.when(clean.rlike(short), big.cast("long")).otherwise(plain), F.lit(0)).cast("long")


def parse_rating(text: Column) -> Column:
    """'4.5 out of 5 stars', '4.5/5', '3.7' as a double; 0 if it is none."""
    ratio = r"(?i)([0-9.]+)\s*(?:out of|/)\s*[0-9.]+"
    found = F.when(text.rlike(ratio), F.regexp_extract(text, ratio, 1)).otherwise(F.regexp_extract(F.trim(text), r"^([+-]?[0-9]*\.?[0-9]+)", 1))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def parse_price(text: Column) -> Column:
    """A price with either decimal sign: the later of comma and dot is the decimal one. Null if there is none."""
    digits = F.regexp_replace(text, "[^0-9.,]", "")
    comma, dot = F.locate(",", F.reverse(digits)), F.locate(".", F.reverse(digits))
    decimal_comma = (comma > 0) & ((dot == 0) | (comma < dot))
    european = F.regexp_replace(F.replace(digits, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    number = F.when(decimal_comma, european).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return F.regexp_extract(number, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")


def item_id(text: Column) -> Column:
    """The ten-character item id of a URL or a text, in capitals."""
    by_path = r"(?i)/(?:dp|gp/product|gp/aw/d)/([A-Z0-9]{10})"
    bare = r"(?i)(?:^|[^A-Za-z0-9_])([A-Z0-9]{10})(?:$|[^A-Za-z0-9_])"
    return F.upper(F.coalesce(_found(text, by_path), _found(text, bare)))


def parse_coupon(text: Column) -> Column:
    """'Save 10%', 'Save $5', '$5 off coupon' as struct<type, value>."""
    percent = _found(text, r"(?i)save\s+([0-9]+(?:\.[0-9]+)?)%").try_cast("double")
    amount = F.coalesce(_found(text, r"(?i)save\s+\$([0-9]+(?:\.[0-9]+)?)"), _found(text, r"(?i)\$([0-9]+(?:\.[0-9]+)?)\s+off")).try_cast("double")
    return first_of(
        (percent.isNotNull(), F.struct(F.lit("percent").alias("type"), percent.alias("value"))),
        (amount.isNotNull(), F.struct(F.lit("amount").alias("type"), amount.alias("value"))),
    )


def parse_rank(text: Column) -> Column:
    """'#1,234 in Kitchen (See Top 100)' as struct<rank, category>, wherever it stands; on pages the heading decides (rank_by_heading)."""
    pattern = r"#([0-9,]+)\s+in\s+([^(\n#]+)"
    rank = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("long")
    return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.trim(F.regexp_extract(text, pattern, 2)).alias("category")))


#: Patterns of quantity offers, tried in this order; the group is the quantity.
MULTI_BUY = (
    r"(?i)buy\s+(\d+)[,\s]+(?:get|save)\s+\d+%?\s*off", r"(?i)buy\s+(\d+)[,\s]+save\s+\$?[\d.]+", r"(?i)(\d+)\s+for\s+\$[\d.]+", r"(?i)save\s+\d+%?\s+when\s+you\s+buy\s+(\d+)",
    r"(?i)purchase\s+(\d+)\s+or\s+more", r"(?i)quantity\s+discount[:\s]+buy\s+(\d+)", r"(?i)(\d+)\+\s+items?\s+(?:get|save)\s+\d+%",
)
FEWEST, MOST, LONGEST_OFFER = 2, 100, 80


def parse_multi_buy(text: Column) -> Column:
    """'Buy 2, save 10%', '3 for $20': struct<text, min_quantity> of the first pattern whose quantity is from 2 to 100; the text is its sentence, up to 80 characters."""

    def offer(clean: Column, pattern: str) -> Column:
        hit = let(F.struct(F.regexp_substr(clean, F.lit(pattern)).alias("said"), F.regexp_extract(clean, pattern, 1).try_cast("int").alias("quantity")), lambda m: F.when(m["quantity"].between(FEWEST, MOST), m))
        return let(hit, lambda m: F.when(m.isNotNull(), F.struct(sentence(clean, m["said"]).alias("text"), m["quantity"].alias("min_quantity"))))

    def sentence(clean: Column, said: Column) -> Column:
        at = F.position(F.lower(said), F.lower(clean))
        lead = F.substring_index(F.substr(clean, F.lit(1), at), ".", -1)
        rest = F.substring_index(F.substr(clean, at + F.length(said)), ".", 1)
        return F.substring(F.trim(F.concat(lead, F.substr(said, F.lit(2)), rest)), 1, LONGEST_OFFER)

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda clean: F.coalesce(*(offer(clean, p) for p in MULTI_BUY)))


#: The heading near which a best-seller rank stands, and the rank.
RANK_HEADING, RANK = r"(?i)best\s*sellers?\s*rank", r"#([\d,]+)\s+in\s+([A-Za-z][A-Za-z &',()-]+)"


def rank_by_heading(text: Column, heading: str = RANK_HEADING) -> Column:
    """struct<rank, category> of a text that names the rank's heading: '#1,234 in Home & Kitchen (See Top 100)'; null without the heading or a rank."""
    hit = F.struct(F.replace(F.regexp_extract(text, RANK, 1), F.lit(","), F.lit("")).try_cast("long").alias("rank"), F.regexp_replace(F.trim(F.regexp_extract(text, RANK, 2)), r"\s*\(.*$", "").alias("category"))
    return F.when(text.rlike(heading), let(hit, lambda h: F.when(h["rank"].isNotNull(), h)))


def parse_other_sellers(text: Column) -> Column:
    """'New (5) from $12.99': struct<count, min_price>; count 0 if there is none."""
    count = F.coalesce(_found(text, r"(?i)\(([0-9]+)\)\s+from"), _found(text, r"(?i)([0-9]+)\s+(?:new|used|other)[^$]*from"))
    price = F.regexp_replace(_found(text, r"(?i)from\s+\$([0-9,]+(?:\.[0-9]+)?)"), "^([^,]*),", "$1")
    return F.struct(F.coalesce(count.try_cast("int"), F.lit(0)).alias("count"), price.try_cast("double").alias("min_price"))


def some_other_sellers(text: Column) -> Column:
    """parse_other_sellers of a text that counts any; null otherwise."""
    return let(parse_other_sellers(text), lambda o: F.when(o["count"] > 0, o))


def is_retailer(name: Column, retailer: str) -> Column:
    """Whether a seller's name is the retailer's own (alone, or with a domain or legal form)."""
    return F.lower(F.trim(name)).rlike(rf"^{retailer}(\.[a-z.]+)?( (services|llc|inc\.?))?$")


def classify_seller(sold_by: Column, ships_from: Column, retailer: str) -> Column:
    """struct<seller_name, fulfillment> from who sells and who ships."""
    return F.struct(
        sold_by.alias("seller_name"),
        first_of((is_retailer(sold_by, retailer), "retailer"), (is_retailer(ships_from, retailer), "fba"), (ships_from.isNotNull(), "third-party"), rest="unknown").alias("fulfillment"),
    )


def country(text: Column) -> Column:
    """Canonical name of a country; unknown names keep their spelling."""
    table = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    clean = F.trim(F.regexp_replace(text, r"[\s\u200E\u200F\u00A0]+", " "))
    return F.coalesce(F.element_at(table, F.lower(clean)), clean)


def review_date(text: Column) -> Column:
    """'Reviewed in X on January 2, 2024' as a timestamp; the epoch if there is no date."""
    return F.coalesce(F.try_to_timestamp(_found(text, r"on\s+([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})"), F.lit("MMMM d, yyyy")), F.timestamp_seconds(F.lit(0)))


def search_query(url: Column) -> Column:
    """The k parameter of a search URL, decoded."""
    return F.url_decode(F.regexp_extract(url, r"[?&]k=([^&#]*)", 1))


def price_in_html(html: Column) -> Column:
    """A price in raw page text: the offscreen span, else a JSON field, else a data attribute."""
    return parse_price(
        F.coalesce(_found(html, r'class="[^"]*offscreen[^"]*"[^>]*>([^<]+)<'), _found(html, r'"price(?:Amount)?"\s*:\s*"?([0-9][0-9.,]*)'), _found(html, r'data-price="([^"]+)"'))
    )


def blocked_page(html: Column) -> Column:
    """Whether a page is a robot check and not content."""
    return F.lower(html).rlike("captcha|robot check|enter the characters you see|automated access")
