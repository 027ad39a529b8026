"""Recall and the share of vectors visited, against brute force, on random and on structured vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareflow.llm import nearest


def measure(spark, ids, x, classes, k=10):
    """Recall of the k nearest, and the share of all vectors that are candidates of a query."""
    found, lists = nearest.searched(classes, k + 1)
    got = {}
    for r in found.orderBy("query", "score", "rep").collect():
        if r.rep != r.query and len(got.setdefault(r.query, [])) < k:
            got[r.query].append(r.rep)
    hits = 0
    for q, g in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(g) & set(ids[np.lexsort((ids, d))[:k]].tolist()))
    visited = lists.agg(F.sum(F.size("reps"))).first()[0]
    return hits / k / len(got), visited / len(got) / len(ids)


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0.9), ("sf0.1", 0.75)])
def test_recall_on_random_vectors(spark, sf, most):
    """These have no structure, so a large share is visited; it falls as their number grows."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v"))
    table = rows.toPandas()
    recall, share = measure(spark, table.rep.to_numpy(), np.stack(table.v).astype(float), rows.withColumn("asked", F.col("rep") % 20 == 0))
    assert recall >= 0.9 and share < most


def test_recall_on_structured_vectors(spark):
    """Clusters of their own spread in 32 dimensions: a small share is enough."""
    r = np.random.default_rng(7)
    centres = r.standard_normal((60, 32)) * 3
    x = (centres[r.integers(0, 60, 4000)] + r.standard_normal((4000, 4)) @ r.standard_normal((4, 32))).astype(np.float32)
    ids = np.arange(4000) * 7
    df = spark.createDataFrame([(int(i), v.tolist(), bool(i % 140 == 0)) for i, v in zip(ids, x)], "rep long, v array<float>, asked boolean")
    recall, share = measure(spark, ids, x.astype(float), df)
    assert recall >= 0.9 and share < 0.25


def test_last_levels_take_trees_one_after_the_other(spark):
    width = nearest.BITS + 1
    rows = [(5, t, [10] + [4] * 3 + [1] * (width - 4)) for t in range(4)]
    df = spark.createDataFrame(rows, "query long, tree int, counts array<int>")
    for enough, want in ((4, (nearest.BITS, 3)), (5, (3, 0)), (9, (3, 1)), (16, (3, 3)), (17, (0, 0)), (10**6, (0, 3))):
        r = nearest.last_levels(df, enough).first()
        assert (r.level, r.until) == want


def test_blocks_cut_anywhere_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 10 == 0) for i, v in enumerate(x)], "rep long, v array<float>, asked boolean")
    key = lambda f: sorted((a.query, a.rep) for a in f.collect())
    whole = key(nearest.searched(df, 5)[0])
    monkeypatch.setattr(nearest, "BLOCK_ENTRIES", 1)
    monkeypatch.setattr(nearest, "SORT_ENTRIES", 1000)
    assert key(nearest.searched(df, 5)[0]) == whole
    monkeypatch.setattr(nearest, "MOST_ENTRIES", 40)  # the ascent goes through dozens of blocks, and finds as much
    assert key(nearest.searched(df, 5)[0]) == whole
