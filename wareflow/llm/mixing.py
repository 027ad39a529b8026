"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training progress 0 to 1, given as knots of a piecewise linear function. Its integral
is the source's weight. Targets share the mix by weight; a target stops at `repeats` times its source's size and the excess
is shared again, which is the water level at which all shares add up to the budget. The words that a source owes are dealt to
its documents in a fixed pseudo-random order, pass after pass; only the document at the end of a source's last pass is
taken in part (its leading words). A copy's training position is where the source's cumulative demand, the integral of its
schedule, reaches the copy's first word: the inverse of a quadratic on each piece. Output is range-sorted by position.

Running totals never put a source into one task: documents fall into buckets by the leading digits of the order key, totals
of buckets are summed first, and windows run inside (source, bucket).

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, ranked last; a null doc_id is ordered by
its text. Very long texts are taken whole but for the last. Repeated rows count each on its own (ties in the order are equal in all that the result shows). An empty table gives no
rows. The names of added columns are reserved: row, size, source_size, target, taken, position, order_key, bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize, read

#: Schedules by rank of source, repeating: knots (progress, weight) whose integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
BUDGET, REPEATS = 1.5, 2
#: Documents of a bucket at most, on average, and digits of the order key that give it at least.
BUCKET_ROWS, LEAST_DIGITS = 1 << 15, 3


def area(knots: tuple) -> float:
    """Integral of a schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def position(knots: tuple, share: Column) -> Column:
    """Progress at which the schedule's integral reaches the given share of its whole."""
    whole, done, out = area(knots), 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((done, t0, w0, (w1 - w0) / (t1 - t0)))
        done += (t1 - t0) * (w0 + w1) / 2
    for start, t0, w0, slope in pieces:
        rest = share * whole - start
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
        at = F.lit(t0) + F.when(root + w0 > 0, 2.0 * rest / (root + w0)).otherwise(0.0)
        out = at if start == 0.0 else F.when(rest >= 0, at).otherwise(out)
    return F.least(out, F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, kind (index of its schedule), target. Input: one row per source; the windows below hold no more."""
    by_source = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(area(k)) for k in schedules))
    ranked = by_source.select("source", "source_size", (rank % len(schedules)).alias("kind")).withColumn("w", F.get(weights, F.col("kind")))
    tight = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(budget) * F.sum("source_size").over(Window.partitionBy()) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    # The water level: sources fill up in the order of size by weight; the first that stays under its cap sets the level. Later
    # candidates take sources for full that are not, so theirs are lower.
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= repeats * F.col("source_size"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    cap = F.col("source_size").cast("double") * repeats
    return leveled.select("source", "source_size", "kind", F.coalesce(F.least(cap, final * F.col("w")), cap).alias("target"))


def _keyed(docs: DataFrame, keep: Column) -> DataFrame:
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    return docs.select(keep, "doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("order_key"), F.substr(key, F.lit(1), F.lit(digits)).alias("bucket"))


def mix(docs: DataFrame, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeats: int = REPEATS, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, position; with carry also `row`, the whole input row.

    The totals by bucket are written to the shared folder (one row per source and bucket), the documents are not.
    """
    keyed = _keyed(docs, F.struct(*docs.columns).alias("row") if carry else F.lit(None).cast("int").alias("row"))
    if not carry:
        keyed = materialize(keyed, "mixing-sizes")
    totals = materialize(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("source_size")), "mixing-totals")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("skip"))
    targets = source_targets(totals, schedules, budget, repeats)
    plan = offsets.join(targets, offsets.s.eqNullSafe(targets.source)).drop("source")
    dealt = keyed.join(plan, keyed.source.eqNullSafe(plan.s) & (keyed.bucket == plan.b))
    within = Window.partitionBy("s", "b").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("skip") + F.coalesce(F.sum("size").over(within), F.lit(0))
    owed = F.floor(F.col("target") + 0.5)
    took = sum((F.greatest(F.lit(0), F.least(F.col("size"), owed - F.col("start") - k * F.col("source_size"))) for k in range(repeats)), F.lit(0))
    placed = dealt.withColumn("start", start).withColumn("taken", took.cast("long"))
    share = F.col("start") / F.col("target")
    where = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        where = F.when(F.col("kind") == k, position(knots, share)).otherwise(where)
    out = placed.withColumn("position", F.when(F.col("taken") > 0, where))
    return out.select("row", "doc_id", "size", "source_size", "target", "taken", "position", "start", "kind", "order_key")


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; what the mix leaves out follows, spread by its order key."""
    spread = F.conv(F.substr("order_key", F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    key = F.coalesce("position", 2.0 + spread)
    return mixed.withColumn("at", key).repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id")


def mixed_documents(docs: DataFrame, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: a row for each copy, in training order, with the columns of the input.

    The last copy of at most one document per source is cut to the words still owed; its text is then those words, joined by
    one space, and n_chars, where there is such a column, their length.
    """
    placed = mix(docs, schedules, budget, repeats, carry=True).where("taken > 0")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words_of = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    share = (F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target")
    where = F.lit(0.0)
    for k, knots in enumerate(schedules):
        where = F.when(F.col("kind") == k, position(knots, share)).otherwise(where)
    copies = copies.withColumn("words_of", words_of).withColumn("at", where)
    whole = F.col("words_of") == F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("words_of").cast("int")), " ")
    text = F.when(whole, F.col("row.text")).otherwise(part)
    fields = {f.name: F.col(f"row.`{f.name}`") for f in docs.schema.fields} | {"text": text}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(part).cast("long"))
    ordered = copies.repartitionByRange("at", "doc_id", "copy").sortWithinPartitions("at", "doc_id", "copy")
    return ordered.select(*(v.alias(k) for k, v in fields.items()))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source),
w AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER (
      ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, kind, coalesce(least(2.0::DOUBLE * source_size,
      w * max(CASE WHEN level * w <= 2 * source_size THEN level END) OVER ()), 2.0::DOUBLE * source_size) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, kind, target, floor(target + 0.5)::BIGINT AS owed,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, owed - start))::BIGINT + greatest(0, least(size, owed - start - source_size))::BIGINT AS taken,
    start / target AS u FROM p)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE kind
    WHEN 0 THEN 2.0 * (u * 3.0) / (sqrt(greatest(0.0, 20.25 - 6.0 * (u * 3.0))) + 4.5)
    WHEN 1 THEN u
    ELSE 2.0 * (u * 2.0) / (sqrt(1.0 + 4.0 * (u * 2.0)) + 1.0) END END AS position
FROM q
"""
