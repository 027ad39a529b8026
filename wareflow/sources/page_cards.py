"""Whole pages to cards: elements found by ordered selectors that are data, in one Arrow pass.

A page is scanned tag by tag with a stack of open elements; comments, scripts and styles are passed over, void elements never open, and an end tag closes
what was left open inside its element. An element is a slice of the page. For each page the first selector that finds anything gives the cards, in the order of
the page, nested ones too; an invalid selector is passed over. Pages of the discount section in which none finds anything are searched by links:
from each link to a product, outside of navigation, header and footer, up to the first block within six steps that holds an image, unless it shows
more than one product (there is no layout here whose height would tell a card from the whole page). Other fields of a card are looked up in it by their own selectors.

Rules are a table (kind of page, map of field to selectors; the field `card` names the cards). Overrides go before the built-in selectors
of their field. Each card says which selector found it, and each field too, so drifting pages show in `fallback_counts`.

Nulls: a null page, or one of a kind without rules, has no card. Elements that are never closed end with their parent. Pages are handled one by
one; the memory of a task is that of its longest page.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections import Counter
from html import unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse

#: Built-in selectors by kind of page and field, tried in this order.
SELECTORS = {
    "search": {
        "card": ('div[data-component-type="s-search-result"]', "div[data-asin][data-index]", "div.s-result-item[data-asin]"),
        "title": ("h2 a span", "h2 span.a-text-normal", "h2.a-text-normal > span", "h2 > span"),
        "rating": ('i[class*="a-icon-star"] span.a-icon-alt', 'a[aria-label*="out of 5 stars"]', 'span[aria-label*="star"]'),
        "price": ("span.a-price span.a-offscreen", "span.a-price-whole"),
        "review_link": ('a[href*="customerReviews"]', 'a[href*="#reviews"]'),
        "list_price": ("[data-strikethroughprice] .a-text-strike", "span.a-text-price:not(.a-size-mini) span.a-offscreen", "span.a-text-strike"),
    },
    "discount": {
        "card": (
            '[data-testid*="product-card"]', '[data-component-type*="product"]', '[class*="product-card"]', '[class*="ProductCard"]', '[class*="product_card"]',
            '[data-testid*="grid-item"]', '[class*="grid-item"]', '[class*="GridItem"]',
        )
    },
}
PRODUCT_LINKS, SKIPPED = ('a[href*="/dp/"]', 'a[href*="/gp/product/"]'), ("nav", "header", "footer", "#navbar", "#nav-main")
MOST_STEPS = 6
#: Fixed values of HTML: elements that never have content, that hold no mark-up, and that stand in lines of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd label mark q s samp small span strong sub sup time u var".split())
#: Start tags that end an open element of the named kind (unless it is outside of the nearest of the stops).
ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",)), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",))}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: An end tag or a start tag; what has more than 1,000 quoted values or one of over 20,000 characters is text, so that broken quotes cost linear time.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^'"<>]*+(?:(?:"[^"]{0,20000}+"|'[^']{0,20000}+')[^'"<>]*+){0,1000}+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
COMPOUND = re.compile(r"""\s*(>?)\s*([A-Za-z][A-Za-z0-9]*|\*)?((?:[.#][\w-]+|\[[^\]]+\]|:not\([.#\[][^)]*\))*)""")
TEST = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?=)["']?([^"'\]]*)["']?)?\]|:not\(([^)]*)\)""")
PRODUCT_ID = re.compile(r"/(?:dp|gp/product)/([A-Za-z0-9]+)")


class Page:
    """Elements of a page in the order of their start tags: name, attributes, place, end, parent (-1: none)."""

    def __init__(self, html: str):
        self.html = html
        self.name, self.written, self.start, self.inner, self.stop, self.parent = [], [], [], [], [], []
        self._attributes: dict[int, dict[str, str]] = {}
        stack: list[int] = []
        self._open = Counter()
        at = 0
        while found := TAG.search(html, at):
            at = found.end()
            closing, name = found.group(1), (found.group(2) or "").lower()
            if not name:
                continue
            if closing:
                self._close(stack, name, found.start(), found.end())
                continue
            if name in ENDS:
                self._end_open(stack, *ENDS[name], found.start())
                if name in ("dt", "dd"):
                    self._end_open(stack, name, ("dl",), found.start())
            elif name in BLOCKS_END_P:
                self._end_open(stack, "p", ("button", "table"), found.start())
            k = len(self.name)
            for column, value in zip((self.name, self.written, self.start, self.inner, self.stop, self.parent), (name, found.group(3), found.start(), found.end(), -1, stack[-1] if stack else -1), strict=True):
                column.append(value)
            if name in VOID or found.group(3).endswith("/"):
                self.stop[k] = found.end()
            elif name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = self.stop[k] = end.end() if end else len(html)
            else:
                stack.append(k)
                self._open[name] += 1
        for k in stack:
            self.stop[k] = len(html)

    def _cut(self, stack: list[int], depth: int, begin: int) -> None:
        """Ends the elements of the stack from a depth on."""
        for k in stack[depth:]:
            self.stop[k] = begin
            self._open[self.name[k]] -= 1
        del stack[depth:]

    def _close(self, stack: list[int], name: str, begin: int, end: int) -> None:
        """Closes the innermost open element of that name and what is open inside it; an end tag without one is passed over."""
        if self._open[name]:
            depth = len(stack) - 1
            while self.name[stack[depth]] != name:
                depth -= 1
            k = stack[depth]
            self._cut(stack, depth, begin)
            self.stop[k] = end

    def _end_open(self, stack: list[int], name: str, stops: tuple[str, ...], begin: int) -> None:
        """Ends the innermost open element of that name, unless one of the stops is open inside it."""
        if self._open[name]:
            depth = len(stack) - 1
            while self.name[stack[depth]] != name:
                if self.name[stack[depth]] in stops:
                    return
                depth -= 1
            self._cut(stack, depth, begin)

    def attributes(self, k: int) -> dict[str, str]:
        """Attributes of an element; the first of a name counts."""
        if k not in self._attributes:
            found: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(self.written[k]):
                found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
            self._attributes[k] = found
        return self._attributes[k]

    def outer(self, k: int) -> str:
        return self.html[self.start[k] : self.stop[k]]

    def text(self, k: int, as_is: bool = False) -> str:
        """Text of an element without tags and raw content, its references resolved, white space collapsed unless it is wanted as it is."""
        parts, at, end = [], self.inner[k], self.stop[k]
        while (found := TAG.search(self.html, at, end)) is not None:
            parts.append(self.html[at : found.start()])
            at = found.end()
            name = (found.group(2) or "").lower()
            if name in RAW and not found.group(1):
                close = re.compile(rf"</{name}\s*>", re.I).search(self.html, at, end)
                at = close.end() if close else end
        parts.append(self.html[at:end])
        text = unescape("".join(parts))
        return text if as_is else " ".join(text.split())

    def inside(self, k: int) -> range:
        """The elements within an element."""
        return range(k + 1, bisect.bisect_left(self.start, self.stop[k], k + 1))

    def above(self, k: int):
        k = self.parent[k]
        while k >= 0:
            yield k
            k = self.parent[k]


@functools.lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple | None:
    """Steps of a selector from right to left as (name, tests, is the next one to the left a parent); None if it is not understood."""
    steps, at, text = [], 0, selector.strip()
    while at < len(text):
        found = COMPOUND.match(text, at)
        if not found.group(2) and not found.group(3):
            return None
        tests = tests_of(found.group(3))
        steps.append((found.group(2) if found.group(2) != "*" else None, tests, found.group(1) == ">"))
        at = found.end()
        if at < len(text) and not text[at].isspace() and text[at] != ">":
            return None
    return tuple(reversed(steps)) or None


def tests_of(text: str) -> tuple:
    """(attribute, kind of test, value) of a compound's classes, ids, attributes and negations."""
    out = []
    for mark, word, attribute, how, value, negated in TEST.findall(text):
        if negated:
            out.append(("", "not", tests_of(negated)))
        elif mark:
            out.append(("class", "word", word) if mark == "." else ("id", "=", word))
        else:
            out.append((attribute.lower(), how or "has", value))
    return tuple(out)


def passes(attributes: dict[str, str], tests: tuple) -> bool:
    for attribute, how, value in tests:
        if how == "not":
            if passes(attributes, value):
                return False
            continue
        has = attributes.get(attribute)
        ok = has is not None and (
            how == "has" or (how == "=" and has == value) or (how == "word" and value in has.split()) or (how == "*=" and value != "" and value in has) or (how == "^=" and value != "" and has.startswith(value)) or (how == "$=" and value != "" and has.endswith(value))
        )
        if not ok:
            return False
    return True


def fits(page: Page, k: int, steps: tuple) -> bool:
    """Whether an element is what a compiled selector names."""
    name, tests, parent_only = steps[0]
    if (name is not None and page.name[k] != name.lower()) or (tests and not passes(page.attributes(k), tests)):
        return False
    if len(steps) == 1:
        return True
    for up in page.above(k):
        if fits(page, up, steps[1:]):
            return True
        if parent_only:
            return False
    return False


def select(page: Page, selectors: list[str], within) -> tuple[int, list[int]]:
    """Number of the first selector that finds elements, and these; (-1, none) if none does."""
    for k, selector in enumerate(selectors):
        steps = compiled(selector)
        found = [e for e in within if fits(page, e, steps)] if steps else []
        if found:
            return k, found
    return -1, []


def cards_by_links(page: Page) -> list[int]:
    """The least blocks with an image around links to products, each once, in the order of their links."""
    links, skipped = [compiled(s) for s in PRODUCT_LINKS], [compiled(s) for s in SKIPPED]
    images = [k for k, name in enumerate(page.name) if name == "img"]
    shown = [k for k, name in enumerate(page.name) if name == "a" and any(fits(page, k, s) for s in links)]
    products = [m.group(1) if (m := PRODUCT_ID.search(page.attributes(k)["href"])) else "" for k in shown]
    other = [len(shown)] * len(shown)  # place of the next link to another product
    for j in range(len(shown) - 2, -1, -1):
        other[j] = other[j + 1] if products[j] == products[j + 1] else j + 1
    apart = []  # elements in navigation and the like
    for k, parent in enumerate(page.parent):
        apart.append((parent >= 0 and apart[parent]) or any(fits(page, k, s) for s in skipped))
    found: dict[int, None] = {}
    for link in shown:
        for up in [] if apart[link] else itertools.islice(page.above(link), MOST_STEPS):
            inside = page.inside(up)
            if page.name[up] not in INLINE and bisect.bisect_left(images, inside.start) < bisect.bisect_left(images, inside.stop):
                first, last = bisect.bisect_left(shown, inside.start), bisect.bisect_left(shown, inside.stop)
                if other[first] >= last:
                    found[up] = None
                break
    return list(found)


def rule_table(spark: SparkSession, selectors: dict[str, dict[str, tuple[str, ...]]] = SELECTORS) -> DataFrame:
    """kind, rules (map of field to selectors)."""
    rows = [(kind, {field: list(s) for field, s in fields.items()}) for kind, fields in selectors.items()]
    return spark.createDataFrame(rows, "kind string, rules map<string, array<string>>")


def overridden(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with the overrides (kind, rules) of their kind before the built-in selectors of each field; fields and kinds that only the overrides have are added."""
    none = F.array().cast("array<string>")
    patch = overrides.select(F.col("kind").alias("of"), F.col("rules").alias("patch"))
    both = rules.join(patch, F.col("kind") == F.col("of"), "full")
    empty = F.map_from_arrays(none, F.array().cast("array<array<string>>"))
    merged = F.map_zip_with(F.coalesce("patch", empty), F.coalesce("rules", empty), lambda _, new, old: F.concat(F.coalesce(new, none), F.coalesce(old, none)))
    return both.select(F.coalesce("kind", "of").alias("kind"), merged.alias("rules"))


def page_cards(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, kind, place (from 0), rule, html, found (map of field to struct<rule, text>) of every card of the pages (page_id, kind, html).

    rule counts the card selectors; a card found by links has their number. Fields that a card lacks are not in the map.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        entry = pa.struct([("rule", pa.int32()), ("text", pa.string())])
        shape = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("place", pa.int32()), ("rule", pa.int32()), ("html", pa.string()), ("found", pa.map_(pa.string(), entry))])
        for batch in batches:
            for k, (kind, html, rules_of) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("html").to_pylist(), batch.column("rules").to_pylist(), strict=True)):
                if html is None or not rules_of:
                    continue
                page, fields = Page(html), dict(rules_of)
                card_rules = fields.pop("card", [])
                rule, cards = select(page, card_rules, range(len(page.name)))
                if rule < 0 and kind == "discount":
                    rule, cards = len(card_rules), cards_by_links(page)
                if not cards:
                    continue
                columns = [[], [], []]
                for card in cards:
                    within, texts = page.inside(card), []
                    for field, selectors in fields.items():
                        which, elements = select(page, selectors, within)
                        if elements:
                            texts.append((field, {"rule": which, "text": page.text(elements[0])}))
                    for column, value in zip(columns, (rule, page.outer(card), texts), strict=True):
                        column.append(value)
                n = len(cards)
                ids = batch.column("page_id").take(pa.array([k] * n))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([kind] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], shape.field("found").type)], shape.names
                )

    ruled = pages.select("page_id", "kind", "html").join(rules.select(F.col("kind").alias("of"), "rules"), F.col("kind") == F.col("of"))
    return ruled.drop("of").mapInArrow(run, f"page_id {id_type}, kind string, place int, rule int, html string, found map<string, struct<rule: int, text: string>>")


def section_texts(pages: DataFrame, sections: dict[str, tuple[str, ...]], every: tuple[str, ...] = (), marked: tuple[str, ...] = ()) -> DataFrame:
    """page_id, texts (map of field to array): for each selector of a field, in order, the text of the first element it finds, or of all (fields in `every`); white space as it is. Fields in `marked` give the elements with their mark-up.

    A selector may be several with commas between; the first element that any of them names counts.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        shape = pa.map_(pa.string(), pa.list_(pa.string()))
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                page, texts = Page(html or ""), []
                for field, selectors in sections.items():
                    said = []
                    for selector in selectors:
                        steps = [compiled(s) for s in selector.split(",")]
                        hits = [k for k in range(len(page.name)) if any(s and fits(page, k, s) for s in steps)]
                        said += [page.outer(k) if field in marked else page.text(k, True) for k in (hits if field in every else hits[:1])]
                    texts.append((field, said))
                out.append(texts)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, shape)], ["page_id", "texts"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {id_type}, texts map<string, array<string>>")


#: Where a product's page states quantity offers and its best-seller rank.
OFFER_SECTIONS = (
    "#promoPriceBlockMessage_feature_div", "#sopp_feature_div", "#tp_feature_div", "#promoMessageId", '[data-feature-name="promotions"]', "#SNS_PromoMessage",
    "#ppd, #buyBoxAccordion, #desktop_buybox", "#detailBullets_feature_div, #detail-bullets",
)
RANK_TABLES, RANK_ROWS = ("#productDetails_detailBullets_sections1", "#prodDetails", "#productDetails_db_sections", "#detailBulletsWrapper_feature_div"), ("tr", "li", "span")
RANK_BULLETS, RANK_PAGE = ("#detailBullets_feature_div, #detail-bullets",), ("#detailBulletsWrapper_feature_div, #prodDetails, #ppd",)
ROW_HEADING = r"(?i)best\s*sellers?\s*rank|amazon\s*best\s*sellers"


#: Where a product's page names its country of origin, and other sellers.
COUNTRY_CELL, COUNTRY_BULLETS = ("tr.po-country_of_origin td.po-break-word",), ("#detailBullets_feature_div li span.a-list-item",)
COUNTRY_ROWS = (
    "#productDetails_techSpec_section_1 tr, #productDetails_detailBullets_sections1 tr, #productDetails_db_sections tr, #detailBulletsWrapper_feature_div tr, #prodDetails tr",
    "#productDetails_expanderTables_dep498 tr, .prodDetTable tr",
)
COUNTRY_SAID = r"(?i)Country of Origin\s*[:\u200F\u200E]+\s*(.+)"
SELLER_SECTIONS = (
    "#olp-upd-new, #olp-upd-new-used, .olp-text-box", "#buybox-see-all-buying-choices, #aod-ingress-bouncer, #all-offers-display-scroller", "#olp_feature_div", "#ppd, #buyBoxAccordion, #desktop_buybox",
)


def _first(field: str, parse_one) -> Column:
    """The first value that is not null among a field's texts."""
    return F.get(F.filter(F.transform(F.col("texts")[field], lambda t: parse_one(t)), lambda x: x.isNotNull()), F.lit(0))


def _country_of_row(row: Column) -> Column:
    """The last cell of a table row whose first one names the country of origin."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "&nbsp;", " "))
    head = F.lower(plain(F.regexp_extract(row, r"(?is)<t[hd]\b[^>]*>(.*?)(?:</t[hd]>|<t[hd]\b|$)", 1)))
    value = plain(F.regexp_extract(row, r"(?is).*<td\b[^>]*>(.*?)(?:</td>|</tr>|$)", 1))
    return F.when(F.contains(head, F.lit("country of origin")) & (value != ""), value)


def _offer_sections() -> dict[str, tuple[str, ...]]:
    rows = tuple(", ".join(f"{table} {row}" for row in RANK_ROWS) for table in RANK_TABLES)
    return {"offer": OFFER_SECTIONS, "rows": rows, "bullets": RANK_BULLETS, "page": RANK_PAGE}


def _offer() -> Column:
    return _first("offer", parse.parse_multi_buy)


def _rank() -> Column:
    return F.coalesce(_first("rows", lambda t: parse.rank_by_heading(t, ROW_HEADING)), _first("bullets", parse.rank_by_heading), _first("page", parse.rank_by_heading))


def document_offers(pages: DataFrame) -> DataFrame:
    """page_id, multi_buy (struct<text, min_quantity>), bsr (struct<rank, category>) of products' pages (page_id, html); null where a page states none.

    An offer is looked for section by section. A rank is looked for in rows of the detail tables that name its heading, then in the bullets, then in the whole detail section.
    """
    return section_texts(pages, _offer_sections(), every=("rows",)).select("page_id", _offer().alias("multi_buy"), _rank().alias("bsr"))


def product_details(pages: DataFrame, retailer: str, department: str = "default") -> DataFrame:
    """page_id and the eight fields of products' pages (page_id, html): brand, seller, country, other_sellers, other_min_price, multi_buy, bsr, completeness.

    A page that could not be read (null, empty or a robot check) gives nulls and no other sellers. A country is looked for in the overview, in rows of the detail
    tables, in the bullets, in the additional rows, and given its common name.
    """
    from .cards import document_brand, document_seller
    from .html import completeness

    sections = _offer_sections() | {"cell": COUNTRY_CELL, "specs": COUNTRY_ROWS[:1], "list": COUNTRY_BULLETS, "more": COUNTRY_ROWS[1:], "sellers": SELLER_SECTIONS}
    texts = section_texts(pages, sections, every=("rows", "specs", "list", "more"), marked=("specs", "more")).withColumnRenamed("page_id", "p")
    both = pages.select("page_id", "html").join(texts, F.col("page_id").eqNullSafe(F.col("p")))
    ok = (F.coalesce(F.length("html"), F.lit(0)) > 0) & ~F.coalesce(parse.blocked_page(F.col("html")), F.lit(True))
    said = lambda t: F.nullif(F.trim(F.regexp_extract(t, COUNTRY_SAID, 1)), F.lit(""))
    country = F.coalesce(_first("cell", lambda t: F.nullif(F.trim(t), F.lit(""))), _first("specs", _country_of_row), _first("list", said), _first("more", _country_of_row))
    others = _first("sellers", lambda t: parse.some_other_sellers(t))
    fields = {
        "brand": document_brand(F.col("html")), "seller": document_seller(F.col("html"), retailer), "country": parse.country(country), "other_min_price": others["min_price"],
        "multi_buy": _offer(), "bsr": _rank(), "completeness": completeness(F.col("html"), department),
    }
    return both.select("page_id", *(F.when(ok, v).alias(k) for k, v in fields.items()), F.when(ok, F.coalesce(others["count"], F.lit(0))).otherwise(0).alias("other_sellers"))


def fallback_counts(cards: DataFrame) -> DataFrame:
    """kind, field, rule, n: how often a selector other than the first found something; pages are counted once for their cards."""
    by_page = cards.where("place = 0").select("kind", F.lit("card").alias("field"), "rule")
    by_field = cards.select("kind", F.explode("found").alias("field", "hit")).select("kind", "field", "hit.rule")
    return by_page.unionByName(by_field).where("rule > 0").groupBy("kind", "field", "rule").agg(F.count("*").alias("n"))
