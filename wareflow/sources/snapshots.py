"""Keyed tables with a capacity, as versioned snapshots in a shared folder.

Each change writes a whole new snapshot and then one small manifest file under the next version's name, which only one writer can create; readers take
the newest manifest, so they never see half a change, and a job that is lost before the manifest has changed nothing. A manifest names the last batch
that it holds: a batch that is replayed, as a stream does after a restart, changes nothing.

A list takes each key once. Rows that are new to it are admitted by rank (time, then key) against its free places; the rest are refused (`refuse`), or
push the oldest out (`fifo`). Ranks are taken over at most `capacity` new rows of a list from each task, whatever a batch brings.

Nulls: a null list or key is a list or key like others; rows without a time come first. An empty batch makes a version that equals the one before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import _file_system

KEPT_VERSIONS = 2
POLICIES = ("refuse", "fifo")


class KeyedTable:
    """Rows (list_name, key, at, ...) in lists of at most `capacity` rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, capacity: int, policy: str = "refuse"):
        if policy not in POLICIES:
            raise ValueError(f"policy is one of {POLICIES}")
        self.spark, self.path, self.schema, self.capacity, self.policy = spark, path.rstrip("/"), schema, capacity, policy

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def head(self) -> dict:
        """version, batch (last one held), data (folder of the snapshot) of the newest manifest; version 0 holds nothing."""
        where, files = _file_system(self.spark, f"{self.path}/manifest")
        names = sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().endswith(".json")) if files.exists(where) else []
        if not names:
            return {"version": 0, "batch": -1, "data": None}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{names[-1]}").collect()))

    def read(self) -> DataFrame:
        data = self.head()["data"]
        return self.spark.read.schema(self.schema).parquet(data) if data else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, head: dict, batch: int) -> int:
        """Writes a snapshot and its manifest; fails if another writer has made this version meanwhile."""
        version = head["version"] + 1
        data = f"{self.path}/data/{version:012d}-{batch}"
        rows.write.mode("overwrite").parquet(data)
        where, files = _file_system(self.spark, self._manifest(version))
        out = files.create(where, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "batch": batch, "data": data}).encode()))
        finally:
            out.close()
        self._forget(version - KEPT_VERSIONS)
        return version

    def _forget(self, version: int) -> None:
        """Deletes the snapshot of an old version, whose readers are done; manifests stay as a history."""
        if version < 1:
            return
        where, files = _file_system(self.spark, f"{self.path}/data")
        for found in files.listStatus(where):
            if found.getPath().getName().startswith(f"{version:012d}-"):
                files.delete(found.getPath(), True)

    def add(self, rows: DataFrame, batch: int) -> DataFrame | None:
        """Takes a batch up and returns its rows with `outcome`: added, duplicate or full; None if the batch is held already."""
        head = self.head()
        if batch <= head["batch"]:
            return None
        before, names = self.read(), self.read().columns
        mine = Window.partitionBy("list_name", "key").orderBy("at")
        judged = rows.select(names).withColumn("again", F.row_number().over(mine) > 1)
        held = before.select(F.col("list_name").alias("l"), F.col("key").alias("k")).withColumn("held", F.lit(True))
        judged = judged.join(held, F.col("list_name").eqNullSafe(F.col("l")) & F.col("key").eqNullSafe(F.col("k")), "left")
        judged = judged.select(*names, (F.col("again") | F.col("held").isNotNull()).alias("duplicate"))
        new = judged.where("NOT duplicate").drop("duplicate")
        if self.policy == "refuse":
            taken = before.groupBy(F.col("list_name").alias("l")).agg(F.count("*").alias("taken"))
            first = Window.partitionBy("list_name").orderBy("at", "key")
            ranked = new.withColumn("place", F.row_number().over(first)).where(F.col("place") <= self.capacity)
            free = ranked.join(taken, F.col("list_name").eqNullSafe(F.col("l")), "left").where(F.col("place") + F.coalesce("taken", F.lit(0)) <= self.capacity)
            after = before.unionByName(free.select(names))
        else:
            newest = Window.partitionBy("list_name").orderBy(F.col("at").desc(), F.col("key").desc())
            after = before.unionByName(new).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= self.capacity).drop("place")
        self._commit(after, head, batch)
        now = self.read().select(F.col("list_name").alias("l"), F.col("key").alias("k")).withColumn("there", F.lit(True))
        told = judged.join(now, F.col("list_name").eqNullSafe(F.col("l")) & F.col("key").eqNullSafe(F.col("k")), "left")
        outcome = F.when(F.col("duplicate"), "duplicate").when(F.col("there").isNotNull(), "added").otherwise("full")
        return told.select(*names, outcome.alias("outcome"))

    def remove(self, keys: DataFrame, batch: int) -> None:
        """Frees the places of (list_name, key)."""
        head = self.head()
        if batch <= head["batch"]:
            return
        gone = keys.select(F.col("list_name").alias("l"), F.col("key").alias("k")).distinct()
        before = self.read()
        self._commit(before.join(gone, F.col("list_name").eqNullSafe(F.col("l")) & F.col("key").eqNullSafe(F.col("k")), "left_anti"), head, batch)
