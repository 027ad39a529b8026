"""Containers of cards in whole pages: scanning with a stack, selectors, links, rules with overrides."""

import random

import pytest

from wareflow.sources import page_cards
from wareflow.sources.page_cards import Page, cards_by_links, compiled, fits


def found(html, selector):
    page = Page(html)
    return [page.outer(k) for k in range(len(page.name)) if fits(page, k, compiled(selector))]


def test_open_and_closed_elements():
    assert found("<div><p>a<p>b<div>c</div></div>", "p") == ["<p>a", "<p>b"]
    assert found("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul > li") == ["<li>a<ul><li>b</ul>", "<li>b", "<li>c"]
    assert found("<div><b>x</div>y", "b") == ["<b>x"]
    assert found("a</p></div><p>never closed <i>x", "p") == ["<p>never closed <i>x"]
    assert found('<img src="a>b"><br/><p>z</p>', "img") == ['<img src="a>b">']
    assert found("<dl><dt>a<dd>b<dt>c</dl>", "dt") == ["<dt>a", "<dt>c"]
    assert found("<table><tr><td>1<td>2<tr><td>3</table>", "td") == ["<td>1", "<td>2", "<td>3"]


def test_decoys():
    html = "<!-- <p>no</p> --><script>'<p>no</p>'</script><style>p{}</style><title><p></title><P CLASS='x y'>yes</P><!-- open <p>"
    assert found(html, "p") == ["<P CLASS='x y'>yes</P>"] and found(html, ".y") == found(html, "p")
    page = Page("<div>a <b>b</b><script>c</script>\n d</div>")
    assert page.text(0) == "a b d"


@pytest.mark.parametrize("selector,hits", [("[data-a]", 3), ('[data-a="xyz"]', 1), ('[data-a*="y"]', 2), ('[data-a^="x"]', 1), ('div[data-a$="z"]', 1), ("i:not(.q)", 1), ("div i", 2), ("div > i", 1), ("#w > b i.q", 1), ("*.q", 1), ("div.k.m", 1)])
def test_selectors(selector, hits):
    html = '<div data-a="xyz" class="m k" id="w"><b data-a="y"><i class="q"></i></b><i data-a></i></div>'
    assert len(found(html, selector)) == hits


@pytest.mark.parametrize("selector", ["li:hover(", "", ">", "a:nth-child(2)", "!"])
def test_selectors_that_are_not_understood(selector):
    assert compiled(selector) is None


def test_links():
    card = '<div><span><a href="/t/dp/{0}"><b>x</b></a></span><img src="i"><a href="/gp/product/{0}">y</a></div>'
    grid = "".join(card.format(f"B00000000{k}") for k in range(5))
    page = Page(f'<nav><div><a href="/dp/B1"><img></a></div></nav><div id="navbar"><p><a href="/dp/B2"><img></p></div><main>{grid}</main>')
    assert [page.outer(k) for k in cards_by_links(page)] == [card.format(f"B00000000{k}") for k in range(5)]
    two = Page('<div><a href="/dp/B1">a</a><a href="/dp/B2">b</a><img></div>')
    assert cards_by_links(two) == []
    deep = Page('<div><img>' + "<section><span>" * 4 + '<a href="/dp/B1">a</a></div>')
    assert len(cards_by_links(deep)) == 0 and len(cards_by_links(Page('<div><img><span><a href="/dp/B1">a</a></span></div>'))) == 1


def test_hostile_pages_are_linear():
    for html in ("<div" * 50_000, "<div>" * 20_000, "<a href='/dp/B1'>" * 3000 + "<img>", '<p a="' * 20_000, "</div>" * 50_000, "<!--" * 20_000):
        page = Page(html)
        assert len(page.name) == len(page.stop) and -1 not in page.stop
        cards_by_links(page)


def test_random_pages_nest():
    r = random.Random(2)
    for _ in range(200):
        html = "".join(r.choice(("<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "x", "<br>", "<a>", "</a>")) for _ in range(60))
        page = Page(html)
        for k, up in enumerate(page.parent):
            assert page.start[k] < page.stop[k] <= len(html)
            assert up < 0 or (page.start[up] < page.start[k] and page.stop[k] <= page.stop[up])


def test_rules_and_overrides(spark):
    rules = page_cards.rule_table(spark, {"a": {"card": ("p.x", "p"), "name": ("b",)}, "b": {"card": ("li",)}})
    patch = spark.createDataFrame([("a", {"card": ["p.new"], "more": ["i"]}), ("c", {"card": ["td"]})], "kind string, rules map<string, array<string>>")
    merged = {r.kind: r.rules for r in page_cards.overridden(rules, patch).collect()}
    assert merged == {"a": {"card": ["p.new", "p.x", "p"], "name": ["b"], "more": ["i"]}, "b": {"card": ["li"]}, "c": {"card": ["td"]}}
    pages = [(1, "a", "<p>one <b>B</b></p><p class=x>two<i>I</i></p>"), (2, "a", "<p class='new'>n</p>"), (3, "b", "<p>none</p>"), (4, "z", "<p>no rules</p>"), (5, "a", None), (6, None, "<p>"), (7, "a", "")]
    table = spark.createDataFrame(pages, "page_id long, kind string, html string")
    got = page_cards.page_cards(table, page_cards.overridden(rules, patch))
    assert sorted((r.page_id, r.place, r.rule, r.html, tuple(sorted((k, v.rule, v.text) for k, v in r.found.items()))) for r in got.collect()) == [
        (1, 0, 1, "<p class=x>two<i>I</i></p>", (("more", 0, "I"),)), (2, 0, 0, "<p class='new'>n</p>", ()),
    ]
    assert [tuple(r) for r in page_cards.fallback_counts(got).collect()] == [("a", "card", 1, 1)]
    assert page_cards.page_cards(table.limit(0), rules).count() == 0


OFFERS = [
        ("Buy 2, save 10% on this item.", 2, "Buy 2, save 10% on this item"), ("Special offer: Buy 3, get 15% off when you checkout.", 3, "Special offer: Buy 3, get 15% off when you checkout"),
        ("3 for $19.99 - mix and match", 3, "3 for $19.99 - mix and match"), ("First. Save 20% when you\n buy 4 or more. Last", 4, "Save 20% when you buy 4 or more"), ("Purchase 2 or more", 2, "Purchase 2 or more"),
        ("Quantity discount: buy 5", 5, "Quantity discount: buy 5"), ("3+ items get 10% off", 3, "3+ items get 10% off"), ("Buy 2 and get one free", None, None), ("Buy 1, save 10%", None, None), ("buy 101, save $5", None, None),
        ("Buy 1, save $5. 4 for $9", 4, "4 for $9"), ("x" * 100 + " 3 for $9", 3, "x" * 80), (None, None, None),
    ]


def test_quantity_offers(spark):
    from pyspark.sql import functions as F

    from wareflow.functions import parse

    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(OFFERS)], "k int, t string").select("k", parse.parse_multi_buy(F.col("t")).alias("m"))
    got = {r.k: (r.m.min_quantity, r.m.text) if r.m else (None, None) for r in df.collect()}
    assert got == {k: (quantity, said) for k, (_, quantity, said) in enumerate(OFFERS)}


RANKS = [
        ('<table id="prodDetails"><tr><th>Best Sellers Rank</th><td>#247 in Electronics (See Top 100)</td></tr></table>', 247, "Electronics"),
        ('<div id="detailBulletsWrapper_feature_div"><ul><li>Best Sellers Rank: #1,234 in Home &amp; Kitchen</li></ul></div>', 1234, "Home & Kitchen"),
        ('<div id="detail-bullets"><b>Best Sellers Rank</b>: #56 in Toys &amp; Games\n more</div>', 56, "Toys & Games"), ('<div id="ppd">Best Sellers Rank #89,012 in Beauty &amp; Personal Care</div>', 89012, "Beauty & Personal Care"),
        ('<div id="ppd">#5 in line</div>', None, None), ("<p>Best Sellers Rank #5 in Books</p>", None, None), ("", None, None), (None, None, None),
    ]


def test_ranks_need_their_heading(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _, _) in enumerate(RANKS)], "page_id int, html string")
    got = {r.page_id: (r.bsr.rank, r.bsr.category) if r.bsr else (None, None) for r in page_cards.document_offers(df).collect()}
    assert got == {k: (rank, category) for k, (_, rank, category) in enumerate(RANKS)}


def test_the_store_is_no_brand(spark):
    from pyspark.sql import functions as F

    from wareflow.sources import cards

    df = spark.createDataFrame([("<div><h2>Acme mug large</h2><span>by Amazon</span></div>",), ("<div><h2>mug</h2><i>by Acme Goods</i></div>",)], "html string")
    assert [r.b for r in df.select(cards.brand(F.col("html"), cards.title(F.col("html"))).alias("b")).collect()] == ["Acme", "Acme Goods"]
