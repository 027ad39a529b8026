"""The sentiment model against a fit written out row by row, its held-out accuracy, and the mismatch rule."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareflow.operators import sentiment


def brute_fit(rows, dimensions, steps, penalty):
    rows = [([*{zlib.crc32(w.encode()) % dimensions for w in (t or "").lower().split()}], y) for t, y in rows if y is not None]
    weight = {y: 0.5 / sum(z == y for _, z in rows) for y in (True, False)}
    w, v, t = [0.0] * (dimensions + 1), [0.0] * (dimensions + 1), 1.0
    for _ in range(steps):
        g = [penalty * x for x in v]
        for places, y in rows:
            size = math.sqrt(max(1, len(places)))
            p = 1 / (1 + math.exp(-(sum(v[k] for k in places) / size + v[-1])))
            for k in places:
                g[k] += weight[y] * (p - y) / size
            g[-1] += weight[y] * (p - y)
        new = [a - 2 * b for a, b in zip(v, g)]
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = [a + (t - 1) / u * (a - b) for a, b in zip(new, w)], new, u
    return w


def texts():
    r = random.Random(4)
    out = []
    for k in range(150):
        y = r.random() < 0.7
        words = [r.choice(("good", "fine", "Nice") if y else ("bad", "poor", "Broken")) for _ in range(r.randrange(4))] + [f"w{r.randrange(40)}" for _ in range(r.randrange(12))]
        out.append((" ".join(words), y))
    return [*out, (None, True), ("", False), ("x " * 5000, True), ("unknown", None), *out[:5]]


def test_fit_equals_brute_force(spark):
    rows = texts()
    table = spark.createDataFrame(rows, "text string, target boolean").repartition(3)
    got = sentiment.fit(table, dimensions=64, steps=12)
    assert np.allclose(got, brute_fit(rows, 64, 12, sentiment.PENALTY), atol=1e-9)
    scores = {(r.text, r.target): r.positive for r in sentiment.scored(table, got).collect()}
    for text, y in rows:
        places = {zlib.crc32(w.encode()) % 64 for w in (text or "").lower().split()}
        assert scores[text, y] == pytest.approx(1 / (1 + math.exp(-(sum(got[k] for k in places) / math.sqrt(max(1, len(places))) + got[-1]))))


def test_nothing_to_learn(spark):
    table = spark.createDataFrame([("a", True), ("b", True), ("c", None)], "text string, target boolean")
    for rows in (table, table.limit(0)):
        weights = sentiment.fit(rows, dimensions=16, steps=3)
        assert not weights.any() and all(r.positive == 0.5 for r in sentiment.scored(table, weights).collect())


@pytest.mark.parametrize("label,score,rating,deduction", [("NEGATIVE", 0.9, 5.0, 15), ("NEGATIVE", 0.9, 4.0, 15), ("NEGATIVE", 0.7, 5.0, 0), ("NEGATIVE", 0.9, 3.0, 0), ("POSITIVE", 0.9, 1.0, 10), ("POSITIVE", 0.71, 2.0, 10), ("POSITIVE", 0.9, 5.0, 0), ("POSITIVE", 0.9, None, 0), (None, None, 5.0, 0)])
def test_mismatch(spark, label, score, rating, deduction):
    df = spark.createDataFrame([((label, score), rating)], "s struct<label: string, score: double>, rating double")
    m = df.select(sentiment.mismatch(F.col("s"), F.col("rating")).alias("m")).first().m
    assert m.deduction == deduction and (m.reason is None) == (deduction == 0)


def test_held_out_accuracy(spark):
    from wareflow.plans import review_queries

    rows = {r.held_out: r for r in review_queries.sentiment_accuracy(spark, "/root/testdata/sf0.1").collect()}
    assert rows[True].n > 500 and rows[True].accuracy > rows[True].commoner + 0.05
