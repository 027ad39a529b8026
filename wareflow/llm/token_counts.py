"""Token counts by batch encoding in an Arrow function that returns lengths only.

The function streams Arrow batches of bounded bytes; texts are encoded in batches balanced by bytes, long texts in stretches cut at safe boundaries
(see tokenizing). No shuffle: one narrow pass, so a lost executor repeats only its own partitions.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is passed on. Repeated rows are counted each. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .common import bounded_batches, read

LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            n = tokenizing.count_tokens(tokenizer_path, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    thin = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = thin.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
