"""Parameters as a stream: each row is judged by the version of the parameters that is valid at its time, and again whenever a later version comes.

The batch form is one equi-join on the scope with a bound on time. The stream takes rows and versions from one input; each micro-batch judges new rows by
all versions and earlier rows by new versions only, so all micro-batches together give what the batch form gives, in whatever order rows and
versions arrive, as far as a version's end is known by then (a version ends when the next of its scope begins; a version that arrives late takes back nothing).
A micro-batch that is repeated overwrites its own output.

Nulls: rows without a scope or time are judged by no version. Versions of one scope and one begin are ordered by their number, and the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def spans(versions: DataFrame) -> DataFrame:
    """versions (scope, version, begins, ...) with `ends`: the begin of the scope's next version, null for its last."""
    return versions.withColumn("ends", F.lead("begins").over(Window.partitionBy("scope").orderBy("begins", "version")))


def judged_by() -> Column:
    """Whether a row (scope, at) is judged by a version (of, ends): one that is valid at its time or begins later."""
    return (F.col("scope") == F.col("of")) & F.col("at").isNotNull() & (F.col("ends").isNull() | (F.col("at") < F.col("ends")))


def judged(rows: DataFrame, versions: DataFrame, verdict: Callable[[], Column]) -> DataFrame:
    """Every row (scope, at, ...) with each version that was valid at its time or began later: version, arrival (valid at its time), verdict."""
    known = spans(versions).withColumnRenamed("scope", "of")
    both = rows.join(known, judged_by())
    return both.withColumn("arrival", F.col("begins") <= F.col("at")).withColumn("verdict", verdict()).select(*rows.columns, "version", "arrival", "verdict")


def judge_stream(stream: DataFrame, row_columns: list[str], version_columns: list[str], verdict: Callable[[], Column], folder: str) -> StreamingQuery:
    """Runs over a stream of rows and versions (is_version tells them apart) to what is there now; output goes to folder/out, what was seen to folder/seen."""
    schema = stream.schema

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        seen = session.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).option("basePath", f"{folder}/seen").parquet(f"{folder}/seen").where(F.col("batch") <= number)
        rows = seen.where("NOT is_version").select(*row_columns, (F.col("batch") == number).alias("__new_row"))
        versions = spans(seen.where("is_version").select(*version_columns, (F.col("batch") == number).alias("__new_version")))
        known = versions.withColumnRenamed("scope", "of")
        both = rows.join(known, judged_by()).where("__new_row OR __new_version")
        out = both.withColumn("arrival", F.col("begins") <= F.col("at")).withColumn("verdict", verdict())
        out.select(*row_columns, "version", "arrival", "verdict").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
