"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram's vector binds the letters' vectors, permuted by their place, by
elementwise product; a text's vector bundles (sums) those of its trigrams. A language's prototype is the bundle of all training
texts of that language. A text gets the language whose prototype has the largest cosine with it (ties: the first by name).
Sums are of whole numbers, so prototypes do not depend on the order of rows.

Letters are lower-cased; whatever is no letter ends a word, and runs of it count as one. Code points from U+0250 on share
vectors in 3,504 classes, which keeps the alphabet bounded. Very long texts are read whole.

Nulls: a text that is null or has no letter is `und` with score 0, and so is every text when no row has a language to learn; rows
with a null lang are not learned from; a null doc_id counts as the empty id (never held out). Repeated rows count each. An empty
table gives no rows. Other columns are not read. Languages are taken to be few: one vector for each goes to the driver and
back (8 KB each).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read

#: The alphabet has 2^SYMBOL_BITS symbols.
SYMBOL_BITS = 12
DIMENSION, SEED, LATIN, SYMBOLS = 1024, 20240229, 0x250, 1 << SYMBOL_BITS
FOLDS, HELD_FOLD = 4, 2


def fold(folds: int) -> Column:
    """The fold of a document, from its id alone."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


@functools.cache
def symbol_table():
    """Symbol of each code point; 0 for what is no letter."""
    import numpy as np

    table = np.zeros(0x110000, dtype=np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = np.where(letters < LATIN, letters, LATIN + letters % (SYMBOLS - LATIN))
    return table


@functools.cache
def letter_vectors(dimension: int):
    """Vectors of all symbols, as they are, permuted once and permuted twice."""
    import numpy as np

    v = (np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dimension)) * 2 - 1).astype(np.int8)
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def trigrams(text: str | None):
    """Trigram ids of a text (36 bits each), repeats included; empty if it has no letter."""
    import numpy as np

    symbols = symbol_table()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not symbols.any():
        return np.zeros(0, dtype=np.int64)
    s = np.concatenate((np.zeros(1, dtype=np.uint16), symbols, np.zeros(1, dtype=np.uint16)))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)
    if s[-1] != 0:
        s = np.append(s, 0)
    return s[:-2] << 2 * SYMBOL_BITS | s[1:-1] << SYMBOL_BITS | s[2:]


def bind(ids, dimension: int):
    """Vectors of trigrams, as floats."""
    import numpy as np

    plain, once, twice = letter_vectors(dimension)
    return (twice[ids >> 2 * SYMBOL_BITS] * once[(ids >> SYMBOL_BITS) & (SYMBOLS - 1)] * plain[ids & (SYMBOLS - 1)]).astype(np.float32)


def bundle(ids, dimension: int):
    """Exact sum of the vectors of many trigrams."""
    import numpy as np

    found, counts = np.unique(ids, return_counts=True)
    total = np.zeros(dimension, dtype=np.float64)
    for i in range(0, len(found), 4096):
        total += counts[i : i + 4096].astype(np.float64) @ bind(found[i : i + 4096], dimension).astype(np.float64)
    return total.astype(np.int64)


def prototypes(docs: DataFrame, dimension: int = DIMENSION) -> dict[str, list[int]]:
    """The bundle of each language over all rows of docs (text, lang)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[str, object] = {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(trigrams(text))
            for lang, ids in by_lang.items():
                sums[lang] = sums.get(lang, 0) + bundle(np.concatenate(ids), dimension)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(total)], ["lang", "dim", "value"])

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, dim int, value long")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    return {r.lang: [x.value for x in r.v] for r in rows}


def identify(docs: DataFrame, learned: dict[str, list[int]], dimension: int = DIMENSION) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs with doc_id, held_out and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    langs = sorted(k for k, v in learned.items() if any(v))
    vectors = [learned[k] for k in langs]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit = np.array(vectors, dtype=np.float64).reshape(len(langs), dimension)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True) if langs else 1
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                grams = [np.unique(trigrams(t), return_counts=True) for t in batch.column("text").to_pylist()]
                every = np.unique(np.concatenate([g for g, _ in grams]))
                book = bind(every, dimension)
                names, scores = [], []
                for ids, counts in grams:
                    if not len(ids) or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    v = (counts.astype(np.float32) @ book[np.searchsorted(every, ids)]).astype(np.float64)
                    norm = np.linalg.norm(v)
                    cosines = unit @ v / norm if norm else np.zeros(len(langs))
                    best = int(np.argmax(cosines))
                    names.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(FOLDS) == HELD_FOLD).alias("held_out"))
    bounded_batches(spark)
    learned = prototypes(docs.where("NOT held_out AND lang IS NOT NULL"))
    return identify(docs.drop("lang"), learned)
