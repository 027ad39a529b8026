import datetime
import json

from pyspark.sql import functions as F

from wareflow.operators import filters
from wareflow.sources import html, sinks, tables


def test_brand_list_skips_comments(spark, tmp_path):
    (tmp_path / "brands.txt").write_text("# list\n\n Acme \nZeta\nacme\n")
    assert sorted(r.brand for r in tables.brand_list(spark, str(tmp_path / "brands.txt")).collect()) == ["acme", "zeta"]


def test_recall_feed_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"RecallID": 7, "Title": "Swing", "Products": [{"Name": "Baby Swing"}], "Retailers": [{"Name": "Shop"}]}]))
    row = tables.recalls(spark, str(tmp_path / "r.json")).first()
    assert row.RecallID == 7 and row.Products[0].Name == "Baby Swing" and row.Hazards is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 'He said "x", ok', True, None), (None, "no id", False, 1.0)], "asin string, title string, is_sponsored boolean, price double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text == 'Title,Price,Item,Sponsored\n"He said ""x"", ok",,a,Yes\n'
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    assert "".join(p.read_text() for p in (tmp_path / "tsv").glob("*.txt")) == 'He said "x", ok\t\ta\tYes\n'
    sinks.write_json(df, str(tmp_path / "json"))
    assert len("".join(p.read_text() for p in (tmp_path / "json").glob("*.json")).splitlines()) == 2
    assert sinks.export_name("red / mug!", "csv", datetime.date(2024, 1, 2)) == "red-mug-2024-01-02.csv"


def test_parameters():
    assert filters.tokens("a, b\n,c ") == ("a", "b", "c") and filters.tokens("x\ny,z", newlines=False) == ("x\ny", "z")
    assert all(filters.infer_preset(v) == k for k, v in filters.BANDWIDTH_PRESETS.items()) and filters.infer_preset({}) == "custom"


def test_page_fields(spark):
    page = '<title>T</title><h1>Red &amp; Mug</h1><span class="a offscreen">$1,299.50</span> #12 in Mugs (See) Country of Origin: PRC. <a href="x">'
    rows = spark.createDataFrame([(1, "https://x.example/dp/B08N5WRWNW", page), (2, "https://x.example/", "Robot check"), (3, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.page_fields(rows).collect()}
    assert got[1].price == 1299.5 and got[1].item_id == "B08N5WRWNW" and got[1]["rank"]["rank"] == 12 and got[1].country == "China" and got[1].title_strategy == 0
    assert not got[2].ok and got[2].title is None and got[3].ok and got[3].title is None
    assert rows.select(html.large_image(F.lit("https://i/x._AC_SX_.jpg"))).first()[0] == "https://i/x.jpg"


def test_every_customer_has_a_shortlist(spark):
    from wareflow.plans import registry
    from wareflow.sources.tables import table

    lists = {}
    for r in table(spark, "/root/testdata/sf0.001", "orders").orderBy("o_orderkey").collect():
        lists.setdefault(str(r.o_custkey), []).append(f"- Order {r.o_orderkey}")
    got = {r.list_name: r.markdown for r in registry.queries()["shortlist_markdown"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: "\n".join([f"# {k}", *v]) for k, v in lists.items()} and any(int(k) > 50 for k in got)


def test_two_overlapping_inputs_cover_the_table(spark):
    from wareflow.plans import registry
    from wareflow.sources.tables import listings, table

    sf, queries = "/root/testdata/sf0.001", registry.queries()
    keys = sorted(r[0] for r in queries["insert_absent"](spark, sf).collect())
    assert keys == sorted(r[0] for r in table(spark, sf, "customer").select("c_custkey").collect())
    got = {r.asin for r in queries["page_union"](spark, sf).collect()} - {None}
    assert got == {r.asin for r in listings(spark, sf).select("asin").collect()} - {None}
