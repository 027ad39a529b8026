"""Readers of result cards and review pages by regular expressions on the string column.

Each field is a cascade: the first pattern that gives a value wins. Two kinds of card are read, those of the main store and those of its
discount section, which have rules of their own; both give the same columns, so `union_pages` takes either.

Nulls and missing fields: a null page has no field; counts and ratings that are absent are 0, other fields null, the brand Unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.brands import GENERIC, brand_word, first_word
from ..functions.numbers import first_of, let
from .html import plain_text

#: Reviews read from a page at most, and bars of a histogram.
MOST_REVIEWS, BARS = 10, ("five", "four", "three", "two", "one")
MONEY = r"\$([0-9]+(?:\.[0-9]{1,2})?)"


def found(text: Column, pattern: str) -> Column:
    """The trimmed first group of the first match; null if there is none or it is empty."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def tag(name: str, attribute: str = "") -> str:
    """Pattern of an opening tag that has the attribute text."""
    return rf"(?is)<{name}\b[^>]*{attribute}[^>]*>"


def title(html: Column) -> Column:
    return found(html, tag("h2") + r"(?:\s*<(?:a|span)\b[^>]*>)*([^<]+)<")


def review_count(html: Column) -> Column:
    """The link to the reviews, else an underlined count, else a label that names ratings or reviews."""
    link = found(html, tag("a", r'href="[^"]*customerReviews') + r"(?:\s*<span[^>]*>)?([^<]+)<")
    underlined = found(html, tag("span", r's-underline-text') + r"\s*([0-9,.]+[kKmMbB]?)\s*<")
    named = found(html, r'(?i)aria-label="[^"]*?([0-9][0-9,.]*[kKmMbB]?)\s*(?:rating|review)')
    counts = [F.nullif(let(c, parse.parse_count), F.lit(0).cast("long")) for c in (link, underlined, named)]
    return F.coalesce(*counts, F.lit(0).cast("long"))


def rating(html: Column) -> Column:
    label = F.coalesce(found(html, r'(?i)aria-label="([0-9.]+\s*(?:out of|/)\s*5[^"]*)"'), found(html, tag("span", "a-icon-alt") + r"([^<]+)<"))
    return F.coalesce(let(label, parse.parse_rating), F.lit(0.0))


def price(html: Column) -> Column:
    return let(F.coalesce(found(html, tag("span", 'class="a-price"') + r"\s*<span[^>]*a-offscreen[^>]*>([^<]+)<"), found(html, tag("span", "a-price-whole") + r"([^<]+)<")), parse.parse_price)


def list_price(html: Column) -> Column:
    """The price struck through, else the price that was, else one in a struck span."""
    struck = found(html, tag("span", "data-strikethroughprice") + r"(?:\s*<span[^>]*>)?([^<]+)<")
    was = found(html, r'(?is)<span class="(?![^"]*a-size-mini)[^"]*a-text-price[^"]*"[^>]*>\s*<span[^>]*a-offscreen[^>]*>([^<]+)<')
    return let(F.coalesce(struck, was, found(html, tag("span", "a-text-strike") + r"([^<]+)<")), parse.parse_price)


def coupon(html: Column) -> Column:
    """struct<type, value> of the coupon element."""
    return let(found(html, tag("span", "s-coupon") + r"([^<]+)<"), parse.parse_coupon)


def deal_badge(html: Column) -> Column:
    marked = html.rlike(r'(?i)class="[^"]*dealBadge') | html.rlike(r"(?i)<[^>]+data-deal-badge")
    return F.coalesce(marked | html.rlike(r"(?is)<span[^>]*(?:a-badge-text|dealLabel|a-size-mini)[^>]*>[^<]*limited time deal"), F.lit(False))


def subscribe_percent(html: Column) -> Column:
    """Discount of a subscription: its own element, else one of three phrases of the text."""
    plan = r"(?:subscribe\s*(?:&amp;|&|and)\s*save|S&S)"
    own = found(html, r'(?is)<[^>]+(?:s-subscribe-and-save|(?:class|id)="[^"]*subscribe)[^>]*>[^%]*?([0-9]+)\s*%')
    phrases = (r"(?i)save\s+(?:an?\s+)?(?:extra\s+)?([0-9]+)\s*%\s*(?:with\s+)?(?:subscribe|S&S)", rf"(?i)([0-9]+)\s*%\s*(?:with\s+)?{plan}", rf"(?i){plan}[^%]*?([0-9]+)\s*%")
    said = let(plain_text(html), lambda text: F.when(text.rlike(rf"(?i){plan}"), F.coalesce(*(found(text, p) for p in phrases))))
    return F.coalesce(own, said).try_cast("int")


def sponsored(html: Column) -> Column:
    marked = html.rlike(r'(?i)data-(?:is-)?sponsored="true"') | html.rlike(r'(?i)class="[^"]*sponsored-label') | html.rlike(r'(?i)aria-label="[^"]*\bsponsored\b')
    return F.coalesce(marked | html.rlike(r"(?is)<span[^>]*(?:a-color-secondary|label-popover-default)[^>]*>\s*(?:sponsored\b[^<]*|ad\s*)<"), F.lit(False))


#: Fixed value: the store's own name, which is no brand after "by".
RETAILER = "amazon"


def brand(html: Column, shown: Column, generic: tuple[str, ...] = GENERIC, retailer: str = RETAILER) -> Column:
    """Seven strategies: link under the title, the store's phrase, 'by', the brand row, a labelled link, the address, the title's first word."""
    link = found(html, r'(?is)</h2>\s*<a\b[^>]*href="[^"]*(?:/s\?|field-brandtextbin)[^>]*>([^<]+)<')
    said = let(
        plain_text(html),
        lambda text: F.struct(found(text, r"(?i)visit the\s+(.+?)\s+store").alias("store"), found(text, r"\bby\s+([A-Z][A-Za-z&'.+-]+(?:\s+[A-Z][A-Za-z&'.+-]+){0,2})").alias("by")),
    )
    row = found(html, r'(?is)<(?:div class="a-row a-size-base">\s*<span class="a-size-base-plus a-color-base"|h5 class="s-line-clamp-1">\s*<span)[^>]*>([^<]+)<')
    row = F.trim(F.regexp_replace(row, r"(?i)^visit\s+the\s+|\s+(?:store|shop)$|^shop\s+|^by\s+|^see\s+all\s+.*$", ""))
    labelled = F.coalesce(found(html, r'(?is)<a\b[^>]*brandtextbin[^>]*aria-label="([^"]+)"'), found(html, r'(?is)<a\b[^>]*aria-label="([^"]*brand[^"]*)"'))
    slug = F.get(F.split(found(html, r'(?i)href="[^"]*?/([^/"]+)/dp/'), "-"), F.lit(0))
    short = lambda c: F.length(c).between(1, 59)

    def first(p: Column) -> Column:
        by, row, slug, head = p["said"]["by"], p["row"], p["slug"], p["head"]
        return first_of(
            (short(p["link"]), p["link"]),
            (p["said"]["store"].isNotNull(), p["said"]["store"]),
            ((F.length(by) > 1) & ~by.rlike(rf"(?i)^(?:{retailer}|the|this|that|an?)\b"), by),
            (short(row) & ~F.lower(row).contains("result") & ~row.rlike(r"(?i)^(?:\$|[0-9]|see )"), row),
            (short(p["labelled"]), p["labelled"]),
            (brand_word(slug, generic), slug),
            (brand_word(head, generic) & head.rlike("^[A-Z]"), head),
            rest="Unknown",
        )

    return let(F.struct(link.alias("link"), said.alias("said"), row.alias("row"), labelled.alias("labelled"), slug.alias("slug"), first_word(shown).alias("head")), first)


def card_id(html: Column) -> Column:
    return F.coalesce(found(html, r'(?i)data-asin="([^"]+)"'), parse.item_id(found(html, r'(?is)<h2[^>]*>\s*<a[^>]*href="([^"]+)"')))


def read_cards(cards: DataFrame) -> DataFrame:
    """pos, asin, title, brand, price, list_price, rating, review_count, is_sponsored, has_deal_badge, coupon, sns_percent of (pos, html)."""
    html = F.col("html")
    shown = cards.select("pos", "html", title(html).alias("title"))
    return shown.select(
        "pos", card_id(html).alias("asin"), "title", brand(html, F.col("title")).alias("brand"), price(html).alias("price"), list_price(html).alias("list_price"), rating(html).alias("rating"),
        review_count(html).alias("review_count"), sponsored(html).alias("is_sponsored"), deal_badge(html).alias("has_deal_badge"), coupon(html).alias("coupon"), subscribe_percent(html).alias("sns_percent"),
    )


def read_discount_cards(cards: DataFrame) -> DataFrame:
    """pos, asin, title, brand, price, rating, review_count, is_sponsored of the discount section's cards (pos, html)."""
    html, text = F.col("html"), plain_text(F.col("html"))
    long = lambda c: F.when(F.length(c) > 5, c)
    heading = found(html, r'(?is)<(?:h[2-4]\b[^>]*|[a-z]+ [^>]*class="[^"]*(?:title|name)[^"]*"[^>]*)>([^<]+)<')
    shown = F.coalesce(long(found(html, r'(?is)<img\b[^>]*alt="([^"]+)"')), long(found(html, r'(?is)<a\b[^>]*/dp/[^>]*aria-label="([^"]+)"')), heading, F.lit(""))
    named = F.coalesce(found(html, r'(?i)aria-label="[^"]*?([0-9][0-9,.]*)\s*(?:review|rating)'), found(html, r"(?i)>\s*([0-9][0-9,.]*)\s*(?:review|rating)"), found(html, r">\s*\(([0-9][0-9,.]*)\)\s*<"))
    stars = F.coalesce(found(html, r'(?i)aria-label="([0-9.]+)\s*(?:out of|/)\s*5'), found(html, r'(?i)aria-label="([0-9.]+)\s*star'))
    money = F.coalesce(let(found(html, tag("span", "a-offscreen") + r"([^<]+)<"), parse.parse_price), found(html, rf">\s*{MONEY}\s*<").try_cast("double"), found(html, rf'aria-label="[^"]*{MONEY}').try_cast("double"))
    own = F.regexp_replace(found(html, r'(?is)<[^>]+(?:class|data-testid)="[^"]*brand[^"]*"[^>]*>([^<]+)<'), r"(?i)^by\s+", "")
    maker = F.coalesce(own, found(text, r"\bby\s+([A-Za-z0-9][A-Za-z0-9 &'.+-]{1,30})"), F.lit("Unknown"))
    ad = F.lower(text).rlike(r"\b(?:sponsored|ad)\b") | html.rlike(r'(?i)data-(?:is-)?sponsored="true"') | html.rlike(r'(?i)aria-label="[^"]*\bsponsored\b')
    count = F.coalesce(F.regexp_replace(named, "[,.]", "").try_cast("long"), F.lit(0).cast("long"))
    link = F.coalesce(found(html, r'(?i)href="([^"]*/dp/[^"]+)"'), found(html, r'(?i)href="([^"]*/gp/product/[^"]+)"'))
    return cards.select(
        "pos", F.coalesce(found(html, r'(?i)data-asin="([^"]+)"'), parse.item_id(link)).alias("asin"), shown.alias("title"), maker.alias("brand"), money.alias("price"),
        F.coalesce(stars.try_cast("double"), F.lit(0.0)).alias("rating"), count.alias("review_count"), F.coalesce(ad, F.lit(False)).alias("is_sponsored"),
    )


def histogram(html: Column) -> Column:
    """struct of the five bars' percentages; null unless all five rows are there."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(?:(?!</tr>).)*filterByStar(?:(?!</tr>).)*</tr>"), F.lit(0))
    share = lambda r: F.coalesce(F.regexp_extract(r, r'aria-label="[^"]*?([0-9]+)%', 1).try_cast("int"), F.regexp_extract(r, r">[^<]*?([0-9]+)%", 1).try_cast("int"), F.lit(0))
    shares = F.transform(rows, share)
    return F.when(F.size(shares) >= len(BARS), F.struct(*(F.get(shares, F.lit(k)).alias(b) for k, b in enumerate(BARS))))


def page_reviews(html: Column, most: int = MOST_REVIEWS) -> Column:
    """array<struct<text, rating, ts, verified, helpful_votes>>: the first reviews of a page; what is missing is empty, 0, the epoch or false."""
    parts = F.slice(F.split(F.coalesce(html, F.lit("")), r'(?i)data-hook="review"'), 2, most)
    field = lambda p, hook: found(p, rf'(?is)data-hook="{hook}"[^>]*>(?:\s*<span[^>]*>)?([^<]*)<')
    return F.transform(
        parts,
        lambda p: F.struct(
            F.coalesce(field(p, "review-body"), F.lit("")).alias("text"),
            F.coalesce(F.regexp_extract(field(p, "review-star-rating"), r"(?i)([0-9.]+)\s+out\s+of\s+5", 1).try_cast("double"), F.lit(0.0)).alias("rating"),
            let(F.coalesce(field(p, "review-date"), F.lit("")), parse.review_date).alias("ts"),
            (p.rlike(r'(?i)data-hook="avp-badge"') | p.rlike(r"(?i)verified\s+purchase")).alias("verified"),
            F.coalesce(F.replace(F.regexp_extract(field(p, "helpful-vote-statement"), r"(?i)([0-9,]+)\s+(?:people|person)", 1), F.lit(","), F.lit("")).try_cast("long"), F.lit(0).cast("long")).alias("helpful_votes"),
        ),
    )


def document_brand(html: Column) -> Column:
    """The brand of a product page: byline (store phrase, label or plain), brand link, overview row, specification row, bullet."""
    byline = found(html, r'(?is)id="bylineInfo"[^>]*>([^<]+)<')
    plain = F.when(F.length(byline).between(1, 59) & ~byline.rlike(r"(?i)visit|store|brand:"), byline)
    return F.coalesce(
        found(byline, r"(?i)visit the\s+(.+?)\s+store"), found(byline, r"(?i)brand:\s*(.+)"), plain, found(html, r'(?is)<a\b[^>]*id="brand"[^>]*>([^<]+)<'),
        found(html, r'(?is)<tr class="[^"]*po-brand[^"]*">.*?po-break-word[^>]*>(?:\s*<span[^>]*>)?([^<]+)<'), found(html, r"(?is)<th[^>]*>\s*brand\s*</th>\s*<td[^>]*>([^<]+)<"),
        found(html, r"(?is)a-list-item[^>]*>(?:\s*<span[^>]*>)?\s*brand\s*:\s*(?:</span>\s*<span[^>]*>)?([^<]+)<"),
    )


def document_seller(html: Column, retailer: str) -> Column:
    """struct<seller_name, fulfillment> of a product page: the merchant line, else the rows of the buy box, else the seller's link; null if none."""
    line = found(html, r'(?is)id="merchant-info"[^>]*>([^<]+)<')
    both, sold, ships = found(line, r"(?i)ships from and sold by\s+(.+?)\.?$"), found(line, r"(?i)sold by\s+(.+?)(?:\s+and\s+(?:fulfilled|ships)|\.?$)"), found(line, r"(?i)(?:fulfilled by|ships from)\s+(.+?)\.?$")
    row = lambda label: found(html, rf"(?is)<span[^>]*>\s*{label}\s*</span>\s*<span[^>]*tabular-buybox-text[^>]*>([^<]+)<")
    link = found(html, r'(?is)<a\b[^>]*(?:id="sellerProfileTriggerId"|href="[^"]*seller=)[^>]*>([^<]+)<')
    seller = F.coalesce(both, sold, row("sold by"), link)
    sender = F.coalesce(both, ships, row("ships from"), F.when(link.isNotNull(), F.lit("")))
    return F.when(seller.isNotNull(), parse.classify_seller(seller, sender, retailer))


def local_price(html: Column, currency: Column) -> Column:
    """A price of another country's page: the offscreen span, else the JSON field, else whole and fraction; signs by currency."""

    def number(text: Column) -> Column:
        clean = F.regexp_replace(text, r"\s", "")
        comma, dot = F.locate(",", clean), F.length(clean) - F.locate(".", F.reverse(clean)) + 1
        continental = (currency == "EUR") & (comma > 0) & ((F.locate(".", clean) == 0) | (comma > dot))
        return F.replace(F.when(continental, F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(clean), F.lit(","), F.lit("")).try_cast("double")

    spoken = found(html, r'class="a-offscreen">\s*[^0-9<]*([0-9.,]+)')
    whole, part = found(html, r"a-price-whole[^>]*>([0-9.,]+)"), found(html, r"a-price-fraction[^>]*>([0-9]+)")
    return F.coalesce(number(spoken), found(html, r'"priceAmount":\s*([0-9.]+)').try_cast("double"), number(whole) + F.coalesce(part.try_cast("double"), F.lit(0.0)) / 100)
