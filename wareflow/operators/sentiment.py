"""Sentiment of texts by a linear model over hashed words, and reviews whose stars contradict their words.

The model is a logistic regression with a fixed number of weights. Fitting is full-batch and distributed: each step sends the weights to all tasks, each task sums
its rows' gradient in Arrow batches, the sums meet weight by weight in a shuffle, and the driver gets one number for each weight (DIMENSIONS,
whatever the rows). Both classes weigh the same. Scoring is one narrow pass over Arrow batches.

Nulls: a null text has no word and is scored by the bias alone; rows with a null target are not learned from. Repeated rows count as often as they come. Without rows, or
with one class only, the weights are 0 and every probability is a half, which is confident of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialize

#: Weights besides the bias, steps of the fit, and its penalty.
DIMENSIONS, STEPS, PENALTY = 1 << 14, 40, 1e-4
#: Probability above which a label counts, and the deductions for praise with few stars' words and the reverse.
CONFIDENT, HIGH_STARS, LOW_STARS, NEGATIVE_DEDUCTION, POSITIVE_DEDUCTION = 0.7, 4, 2, 15, 10


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The places of a text's different words, each once."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: (F.crc32(w.cast("binary")) % dimensions).cast("int")))


def _margins(places, weights, bias: float):
    """Score of each row of a list column of places: the mean weight times the root of their number, and the bias."""
    import numpy as np

    flat, ends = places.flatten().to_numpy(zero_copy_only=False), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate(([0.0], np.cumsum(weights[flat])))
    stop = np.cumsum(ends)
    return (sums[stop] - sums[stop - ends]) / np.sqrt(np.maximum(ends, 1)) + bias, flat, ends


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, steps: int = STEPS, penalty: float = PENALTY):
    """Weights (the bias last) from rows (text, or its hashed places already, and target: boolean) by accelerated gradient steps."""
    import numpy as np

    places = F.col("places") if "places" in rows.columns else hashed_words(F.col("text"), dimensions)
    learned = materialize(rows.where("target IS NOT NULL").select(places.alias("places"), "target"), "sentiment-rows")
    total, positive = learned.agg(F.count("*"), F.count_if("target")).first()
    weights = np.zeros(dimensions + 1)
    if not 0 < positive < total:
        discard(learned)
        return weights
    share = {True: 0.5 / positive, False: 0.5 / (total - positive)}
    ahead, momentum = weights.copy(), 1.0
    for _ in range(steps):
        gradient = _gradient(learned, ahead, share) + penalty * ahead
        stepped = ahead - 2.0 * gradient  # a row's curvature is at most (1 + 1) / 4
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, weights, momentum = stepped + (momentum - 1) / following * (stepped - weights), stepped, following
    discard(learned)
    return weights


def _gradient(learned: DataFrame, at, share: dict[bool, float]):
    """Sum of the rows' gradients at some weights; each task gives one row for each weight that its rows touch."""
    import numpy as np

    size = len(at)

    def run(batches):
        import pyarrow as pa

        found = np.zeros(size)
        for batch in batches:
            scores, flat, ends = _margins(batch.column("places"), at[:-1], at[-1])
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            error = (1 / (1 + np.exp(-scores)) - target) * np.where(target, share[True], share[False])
            found[:-1] += np.bincount(flat, weights=np.repeat(error / np.sqrt(np.maximum(ends, 1)), ends), minlength=size - 1)
            found[-1] += error.sum()
        touched = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), pa.array(found[touched])], ["place", "part"])

    sums = learned.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(size)
    out[sums.column("place").to_numpy()] = sums.column("part").to_numpy()
    return out


def scored(rows: DataFrame, weights, keep: tuple[str, ...] | None = None) -> DataFrame:
    """rows (or the columns to keep of them) and positive: the probability that a text is positive."""
    bias, rest, dimensions = float(weights[-1]), weights[:-1], len(weights) - 1
    names = list(keep or rows.columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            scores, _, _ = _margins(batch.column("__places"), rest, bias)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-scores)))], [*names, "positive"])

    shape = rows.select(*names, F.lit(0.0).alias("positive")).schema
    return rows.select(*names, hashed_words(F.col("text"), dimensions).alias("__places")).mapInArrow(run, shape)


def sentiment(positive: Column) -> Column:
    """struct<label, score>: the likelier label and its probability."""
    return F.when(positive >= 0.5, F.struct(F.lit("POSITIVE").alias("label"), positive.alias("score"))).otherwise(F.struct(F.lit("NEGATIVE").alias("label"), (1 - positive).alias("score")))


def mismatch(found: Column, rating: Column) -> Column:
    """struct<deduction, reason>: stars that contradict a confident label (struct<label, score>); a null rating or label contradicts nothing."""
    sure = found["score"] > CONFIDENT
    bad, good = (found["label"] == "NEGATIVE") & (rating >= HIGH_STARS), (found["label"] == "POSITIVE") & (rating <= LOW_STARS)
    return (
        F.when(sure & bad, F.struct(F.lit(NEGATIVE_DEDUCTION).alias("deduction"), F.lit("Positive rating contradicts negative sentiment").alias("reason")))
        .when(sure & good, F.struct(F.lit(POSITIVE_DEDUCTION).alias("deduction"), F.lit("Negative rating contradicts positive sentiment").alias("reason")))
        .otherwise(F.struct(F.lit(0).alias("deduction"), F.lit(None).cast("string").alias("reason")))
    )
