"""Exports: CSV, TSV, JSON lines and Markdown."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Export columns and their labels, in order.
LABELS = {
    "title": "Title", "brand": "Brand", "price": "Price", "list_price": "List Price", "rating": "Rating", "review_count": "Reviews", "asin": "Item", "is_sponsored": "Sponsored",
    "has_deal_badge": "Deal", "country_of_origin": "Origin", "review_quality": "Review Quality", "deal_score": "Deal Score",
}


def cell(df: DataFrame, name: str) -> Column:
    """A value as text: Yes or No for booleans, empty for null."""
    if dict(df.dtypes)[name] == "boolean":
        return F.when(F.col(name), "Yes").when(~F.col(name), "No").otherwise("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def export_rows(df: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """The labelled text columns that the frame has, in fixed order; rows without an id are left out."""
    return df.where("asin IS NOT NULL").select(*(cell(df, k).alias(v) for k, v in labels.items() if k in df.columns))


def csv_line(columns: list[Column], separator: str = ",", quoted: bool = True) -> Column:
    """A row as one line; fields with a separator, quote or line end are quoted, quotes doubled."""
    def field(c: Column) -> Column:
        return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) if quoted else c

    return F.concat_ws(separator, *(field(c) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, nothing quoted."""
    rows = export_rows(df)
    rows.select(csv_line([F.col(f"`{c}`") for c in rows.columns], "\t", False)).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_lists(items: DataFrame) -> DataFrame:
    """list_name, markdown: each list's items as a bullet list in order of addition."""
    line = F.concat(F.lit("- "), F.col("title"), F.when(F.col("price").isNotNull(), F.format_string(" ($%.2f)", F.col("price"))).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("added_at", line.alias("line"))))
    return items.groupBy("list_name").agg(F.concat(F.lit("# "), F.col("list_name"), F.lit("\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("markdown"))


def export_name(query: str, extension: str, day: datetime.date) -> str:
    """File name from a search, at most 40 safe characters, and the day."""
    return f"{re.sub(r'[^A-Za-z0-9]+', '-', query).strip('-')[:40]}-{day.isoformat()}.{extension}"
