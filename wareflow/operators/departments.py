"""Departments of search pages, and how much each review topic weighs in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Department node, name, index alias, and the weights that differ from 1.
PROFILES = (
    ("172282", "Electronics", "electronics", {"performance": 2.0, "durability": 1.5, "compatibility": 1.5, "ease-of-use": 1.2, "product-quality": 1.3, "size-fit": 0.3, "appearance": 0.5}),
    ("7141123011", "Clothing, Shoes & Jewelry", "fashion", {"size-fit": 2.0, "appearance": 1.5, "durability": 1.5, "product-quality": 1.3, "performance": 0.3, "compatibility": 0.3}),
    ("1055398", "Home & Kitchen", "garden", {"product-quality": 1.5, "ease-of-use": 1.5, "appearance": 1.2, "durability": 1.3, "size-fit": 1.0, "performance": 1.0}),
    ("165796011", "Baby", "baby-products", {"product-quality": 2.0, "ease-of-use": 1.5, "durability": 1.5, "packaging": 1.2, "performance": 1.0, "appearance": 0.5}),
    ("3375251", "Sports & Outdoors", "sporting", {"durability": 2.0, "performance": 1.5, "size-fit": 1.2, "product-quality": 1.3, "ease-of-use": 1.0, "appearance": 0.5}),
    ("16310101", "Grocery & Gourmet Food", "grocery", {"product-quality": 2.0, "packaging": 1.5, "shipping-delivery": 1.5, "value": 1.3, "performance": 0.3, "compatibility": 0.2, "size-fit": 0.3}),
    ("228013", "Tools & Home Improvement", "tools", {"durability": 2.0, "ease-of-use": 1.5, "performance": 1.5, "product-quality": 1.3, "compatibility": 1.2, "appearance": 0.3, "size-fit": 0.5}),
    ("3760911", "Beauty & Personal Care", "beauty", {"product-quality": 1.5, "appearance": 1.5, "performance": 1.2, "value": 1.2, "size-fit": 0.5, "compatibility": 0.3, "durability": 0.5}),
    ("283155", "Books", "stripbooks", {"product-quality": 1.5, "value": 1.2, "shipping-delivery": 1.0, "packaging": 1.0, "performance": 0.3, "durability": 0.5, "size-fit": 0.3, "compatibility": 0.2, "appearance": 0.3}),
    ("2619525011", "Toys & Games", "toys-and-games", {"product-quality": 1.5, "durability": 1.5, "ease-of-use": 1.3, "appearance": 1.2, "performance": 1.0, "value": 1.2, "size-fit": 0.8}),
)


def _lookup(pairs: list[tuple[str, object]], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), key)


def department(url: Column, breadcrumb: Column) -> Column:
    """struct<department_id, label>: the node in the address (its label is null if unknown), else the index alias, else a breadcrumb
    that holds a department's name; nulls if there is none."""
    labels = [(node, name) for node, name, *_ in PROFILES]
    node = F.nullif(F.regexp_extract(F.url_decode(F.regexp_extract(url, r"[?&]rh=([^&#]*)", 1)), r"n[:/]([0-9]+)", 1), F.lit(""))
    alias = _lookup([(a, n) for n, _, a, _ in PROFILES], F.regexp_extract(url, r"[?&]i=([^&#]*)", 1))
    named = F.coalesce(*(F.when(F.contains(F.lower(breadcrumb), F.lit(name.lower())), F.lit(n)) for n, name in labels))
    found = F.coalesce(node, alias, named)
    return F.struct(found.alias("department_id"), _lookup(labels, found).alias("label"))


def topic_weight(department_id: Column, topic: Column) -> Column:
    """Weight of a topic in a department: 1 where nothing else is said."""
    pairs = [(f"{node}/{name}", w) for node, _, _, weights in PROFILES for name, w in weights.items()]
    return F.coalesce(_lookup(pairs, F.concat(department_id, F.lit("/"), topic)), F.lit(1.0))


def weighted_topics(scores: DataFrame, departments: DataFrame) -> DataFrame:
    """Topic scores (asin, topic, avg_rating, ..) with weight and weighted_avg_rating by the department of each asin (asin, department_id)."""
    weight = topic_weight(F.col("department_id"), F.col("topic"))
    return scores.join(departments, "asin", "left").withColumn("weight", weight).withColumn("weighted_avg_rating", F.col("avg_rating") * F.col("weight"))
