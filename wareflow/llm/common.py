"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import anew, discard, materialize  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def count_words(text: Column) -> Column:
    """Number of words, without making the array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda binds it, so no rule of the optimizer repeats it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table. Python workers get this package's place, where the driver was started elsewhere."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of bounded bytes, whatever the length of texts. It changes no result, so it may stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
