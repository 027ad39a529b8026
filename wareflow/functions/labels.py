"""Short texts made of values: labels of duplicates, price lines, shares, times, and checks of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up_int


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis if something is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def quote(text: Column, most: int = 120) -> Column:
    """A quotation without its outer marks, truncated."""
    return truncate(F.regexp_replace(F.trim(text), "^[\"']|[\"']$", ""), most)


def duplicate_label(is_best: Column, size: Column, similarity: Column, best_title: Column) -> Column:
    share = F.concat(F.lit(" ("), half_up_int(similarity * 100).cast("string"), F.lit("% match)"))
    return F.when(is_best, F.concat(F.lit("Best of "), size.cast("string"), F.lit(" similar listings"), share)).otherwise(F.concat(F.lit('Similar to "'), truncate(best_title, 40), F.lit('"'), share))


def price_line(savings_percent: Column, deal_label: Column, multi_buy: Column) -> Column:
    """The parts that there are, with dots between; null if there is none."""
    saves = F.when(savings_percent > 0, F.concat(F.lit("Save "), half_up_int(savings_percent).cast("string"), F.lit("%")))
    return F.nullif(F.concat_ws(" · ", saves, deal_label, multi_buy), F.lit(""))


def sentiment_split(pros: Column, cons: Column) -> Column:
    """Share of pros in percent; 50 if there is neither."""
    return F.coalesce(F.try_divide(pros * 100.0, pros + cons), F.lit(50.0))


def time_saved(minutes: Column) -> Column:
    """'45m', '2h', '2h 5m'."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes % 60 > 0, F.concat(hours, F.lit("h "), rest, F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))


def valid_item_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[A-Z0-9]{10}$"), F.lit(False))


def valid_domain(text: Column, allowed: tuple[str, ...]) -> Column:
    """The domain if it is allowed, else the first one that is."""
    return F.when(text.isin(*allowed), text).otherwise(F.lit(allowed[0]))
