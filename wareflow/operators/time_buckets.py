"""Windows over time for keys of any size: rows are dealt by (key, time bucket), so no task holds a whole key.

Sums over a span of time come from running sums. Rows of one instant are added up first (map-side). Buckets are as long as the span; each row stands in its
own bucket and in the one before, where spans that begin there can reach it; the end of each span is a row of its own. One running sum through
a bucket, taken at both ends of a span, gives the span's sum: linear in the rows, whatever the span holds, in one exchange of three rows an instant.

Last values before a time come from the bucket, or from the last bucket before it that has any: the buckets' last values are carried on over
one row for each bucket, whose number is bounded by time, not by rows.

Nulls: rows without a time are in no span and have no value before them; a null key is a key. Times are whole microseconds and may be negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def time_number(rows: DataFrame, time: str) -> Column:
    """A time column as microseconds; numbers are taken as they are."""
    return F.unix_micros(time) if rows.schema[time].dataType.typeName() == "timestamp" else F.col(time).cast("long")


def bucket(time: Column, width: int) -> Column:
    return F.floor(time / width).cast("long")


def dealt(instants: DataFrame, key: str, time: str, names: list[str], after: int) -> DataFrame:
    """key, bucket, at, end (0: a value, 1: the end of a span), from (the span's start), and the values (0 at ends): what running sums go through."""
    width = after + 1  # a span that begins in a bucket ends in it or in the next
    own = bucket(F.col(time), width)
    nothing = {n: F.lit(0).cast(dict(instants.dtypes)[n]).alias(n) for n in names}
    values = [F.col(n).alias(n) for n in names]

    def row(where: Column, at: Column, end: int, start: Column, columns) -> Column:
        return F.struct(where.alias("bucket"), at.alias("at"), F.lit(end).alias("end"), start.alias("from"), *columns)

    here, ahead = row(own, F.col(time), 0, F.col(time), values), row(own - 1, F.col(time), 0, F.lit(None).cast("long"), values)
    last = row(own, F.col(time) + after, 1, F.col(time), nothing.values())
    return instants.select(key, F.inline(F.array(here, ahead, last)))


def span_sums(rows: DataFrame, key: str, time: str, sums: dict[str, Column], after: int) -> DataFrame:
    """key, time and for each name the sum over the key's rows from each instant that occurs to `after` microseconds later, both included."""
    instants = rows.where(F.col(time).isNotNull()).groupBy(key, time).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    names = list(sums)
    order = Window.partitionBy(key, "bucket").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt(instants, key, time, names, after).select(key, "bucket", "from", "end", *names, *(F.sum(n).over(order).alias(f"run_{n}") for n in names))
    # At a span's start the running sum without the start's own rows, at its end with all.
    both = {n: F.sum(F.when(F.col("end") == 1, F.col(f"run_{n}")).otherwise(F.col(n) - F.col(f"run_{n}"))).alias(n) for n in names}
    return run.where(F.col("from").isNotNull()).groupBy(key, "bucket", "from").agg(*both.values()).select(key, F.col("from").alias(time), *names)


def fullest(rows: DataFrame, key: str, time: str, after: int, name: str) -> DataFrame:
    """key and the most rows within a span that begins (or, which is the same, ends) at one of them."""
    return span_sums(rows, key, time, {name: F.lit(1)}, after).groupBy(key).agg(F.max(name).alias(name))


def last_before(rows: DataFrame, key: str, time: str, order: list[str], value: str, name: str, inclusive: bool = True, width: int = DAY) -> DataFrame:
    """rows and `name`: the last value that is not null among the key's rows up to each row in the order (or before it, if not inclusive).

    order begins with the time; what it leaves tied stands in any order.
    """
    timed = rows.withColumn("__bucket", bucket(F.col(time), width))
    through = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = timed.withColumn("__within", F.last(value, ignorenulls=True).over(through))
    latest = F.max_by(value, F.struct(*order))
    ends = timed.where(F.col(value).isNotNull() & F.col("__bucket").isNotNull()).groupBy(key, "__bucket").agg(latest.alias("__last"))
    every = timed.where("__bucket IS NOT NULL").groupBy(key, "__bucket").agg(F.first(F.lit(1)).alias("__one")).drop("__one")
    ends = every.alias("e").join(ends.withColumnsRenamed({key: "__k", "__bucket": "__b"}), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bucket") == F.col("__b")), "left")
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("__k"), F.col("__bucket").alias("__b"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried")).where("__carried IS NOT NULL")
    joined = within.join(carried, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bucket") == F.col("__b")), "left")
    return joined.withColumn(name, F.when(F.col("__bucket").isNotNull(), F.coalesce("__within", "__carried"))).select(*rows.columns, name)
