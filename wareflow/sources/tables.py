"""Sources: Parquet tables, and the listing and review views that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone are taken as UTC, which becomes the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def star(quantity):
    """A rating of 1 to 5 from a quantity of 1 to 50."""
    return (1 + F.floor((quantity - 1) / 10)).cast("double")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part, with prices and review figures from its order lines; attributes that the tables lack derive from keys."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.count("*").alias("n"), F.avg(star(F.col("l_quantity"))).alias("r"), F.min("l_suppkey").alias("s")
    )
    sellers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select("s_suppkey", "s_name", "n_name")
    pos = F.col("p_partkey")
    rows = part.join(lines, part.p_partkey == lines.l_partkey, "left").join(sellers, F.col("s") == F.col("s_suppkey"), "left")
    price = half_up(F.col("p_retailprice") * (1 - F.col("d")), 2)
    coupon = F.when(pos % 7 == 0, F.struct(F.lit("percent").alias("type"), (10.0 + pos % 3 * 10).cast("double").alias("value"))).when(pos % 11 == 0, F.struct(F.lit("amount").alias("type"), F.lit(5.0).alias("value")))
    kinds = F.array(*(F.lit(x) for x in ("retailer", "fba", "third-party", "unknown")))
    seller = F.when(
        F.col("s").isNotNull(),
        F.struct(
            F.col("s_name").alias("seller_name"), F.get(kinds, (F.col("s") % 4).cast("int")).alias("fulfillment"), (pos % 5).cast("int").alias("other_sellers_count"),
            F.when(pos % 5 > 0, half_up(price * (0.8 + (pos % 10) / 10.0), 2)).alias("other_sellers_min_price"),
        ),
    )
    return rows.select(
        pos.alias("pos"), pos.cast("string").alias("asin"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("list_price"), price.alias("price"), F.coalesce("n", F.lit(0)).cast("long").alias("review_count"),
        F.coalesce(half_up(F.col("r"), 1), F.lit(0.0)).alias("rating"), (F.col("p_type") == "PROMO").alias("is_sponsored"), (pos % 5 == 0).alias("has_deal_badge"),
        coupon.alias("coupon"), F.when(pos % 4 == 0, half_up(F.col("t") * 100, 0)).alias("sns_percent"), F.when(pos % 3 > 0, (pos % 101).cast("int")).alias("review_quality"),
        (pos % 3 != 0).alias("brand_certain"), F.col("n_name").alias("country_of_origin"), seller.alias("seller"), (pos * 37 % 100000 + 1).cast("long").alias("bsr_rank"),
        F.col("p_size").cast("int").alias("dept"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("asin"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_idx"), star(F.col("l_quantity")).alias("rating"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_returnflag") != "R").alias("verified"), (F.col("l_linenumber") - 1).cast("long").alias("helpful_votes"),
    )


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("asin"), F.col("doc_id").alias("review_idx"), "text", (1.0 + F.col("doc_id") % 5).cast("double").alias("rating"))


def brand_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of brands, one a line: trimmed, lower-case, without blank lines and comments."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("brand")).where((F.col("brand") != "") & ~F.col("brand").startswith("#")).distinct()


#: The recall feed's nested schema.
RECALL_SCHEMA = (
    "RecallID long, RecallNumber string, RecallDate string, Title string, Description string, URL string, ConsumerContact string, LastPublishDate string, "
    "Products array<struct<Name: string, Description: string, Model: string, NumberOfUnits: string>>, Images array<struct<URL: string, Caption: string>>, "
    "Injuries array<struct<Name: string>>, Hazards array<struct<Name: string, HazardType: string>>, Retailers array<struct<Name: string>>, "
    "ManufacturerCountries array<struct<Country: string>>, ProductUPCs array<string>"
)


def recalls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECALL_SCHEMA).option("multiLine", True).json(path)


def union_pages(pages: list[DataFrame]) -> DataFrame:
    """All pages of a scan, the first row of each id kept; rows without an id all stay."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("page", F.lit(k)) for k, p in enumerate(pages)))
    named = every.where("asin IS NOT NULL")
    first = named.groupBy("asin").agg(F.min(F.struct("page", "pos")).alias("first")).select(F.col("asin").alias("k"), "first.*").withColumnsRenamed({"page": "p", "pos": "q"})
    kept = named.join(first, (F.col("asin") == F.col("k")) & (F.col("page") == F.col("p")) & (F.col("pos") == F.col("q")), "left_semi")
    return kept.unionByName(every.where("asin IS NULL")).drop("page")
