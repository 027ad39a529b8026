"""Keyed tables with a capacity, and verdicts by versions of parameters, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wareflow.sources.snapshots import KeyedTable
from wareflow.streaming import versions

SCHEMA = "list_name string, key string, at timestamp"
T = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def content(store):
    return sorted((r.list_name or "", r.key or "", r.at) for r in store.read().collect())


def test_refusal(spark, tmp_path):
    store = KeyedTable(spark, str(tmp_path / "s"), SCHEMA, 3)
    assert content(store) == [] and store.head()["version"] == 0
    told = store.add(spark.createDataFrame([("a", "x", T(1)), ("a", "x", T(2)), ("a", "y", T(0)), ("b", None, T(0)), (None, "x", T(0))], SCHEMA), 0)
    assert sorted((r.key or "", r.outcome) for r in told.where("list_name = 'a'").collect()) == [("x", "added"), ("x", "duplicate"), ("y", "added")]
    told = store.add(spark.createDataFrame([("a", "z2", T(9)), ("a", "z1", T(8)), ("a", "y", T(7)), ("b", None, T(3))], SCHEMA), 1)
    assert sorted((r.key or "", r.outcome) for r in told.collect()) == [("", "duplicate"), ("y", "duplicate"), ("z1", "added"), ("z2", "full")]
    before = content(store)
    assert store.add(spark.createDataFrame([("a", "new", T(0)), ("c", "new", T(0))], SCHEMA), 1) is None and content(store) == before and store.head()["version"] == 2
    store.remove(spark.createDataFrame([("a", "x", T(0)), ("nobody", "x", T(0))], SCHEMA), 2)
    store.remove(spark.createDataFrame([("a", "y", T(0))], SCHEMA), 2)
    assert [k for name, k, _ in content(store) if name == "a"] == ["y", "z1"]
    store.add(spark.createDataFrame([("a", "z2", T(10))], SCHEMA), 3)
    assert [k for name, k, _ in content(store) if name == "a"] == ["y", "z1", "z2"] and store.head() == {"version": 4, "batch": 3, "data": store.head()["data"]}


def test_first_in_first_out(spark, tmp_path):
    store = KeyedTable(spark, str(tmp_path / "s"), SCHEMA, 2, "fifo")
    for number, rows in enumerate([[("a", "1", T(1)), ("a", "2", T(2)), ("a", "3", T(3))], [("a", "4", T(0)), ("a", "5", T(5))], []]):
        store.add(spark.createDataFrame(rows, SCHEMA), number)
    assert [k for _, k, _ in content(store)] == ["3", "5"]
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", SCHEMA, 2, "other")


def test_two_writers_of_one_version(spark, tmp_path):
    store = KeyedTable(spark, str(tmp_path / "s"), SCHEMA, 2)
    old = store.head()
    store.add(spark.createDataFrame([("a", "1", T(1))], SCHEMA), 0)
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        store._commit(store.read(), old, 1)
    assert store.head()["version"] == 1 and [k for _, k, _ in content(store)] == ["1"]


def test_versions(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), T(r.randrange(50)), r.randrange(10)) for _ in range(80)] + [(None, T(1), 1), ("a", None, 1)]
    params = [("a", 1, T(0), 3), ("a", 2, T(10), 5), ("a", 3, T(30), 1), ("b", 4, T(20), 4)]
    df, v = spark.createDataFrame(rows, "scope string, at timestamp, x int"), spark.createDataFrame(params, "scope string, version int, begins timestamp, least int")
    got = sorted((q.scope, q.at, q.x, q.version, q.arrival, q.verdict) for q in versions.judged(df, v, lambda: F.col("x") >= F.col("least")).collect())
    want = []
    for scope, at, x in rows:
        own = [p for p in params if p[0] == scope and at is not None]
        for k, (_, number, begins, least) in enumerate(own):
            if k + 1 == len(own) or at < own[k + 1][2]:
                want.append((scope, at, x, number, begins <= at, x >= least))
    assert got == sorted(want) and {w[4] for w in want} == {True, False}
