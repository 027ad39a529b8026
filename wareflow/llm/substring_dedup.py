"""Substring deduplication by seed and extend, exact for windows of `window` words.

Seeds: of the 31 runs of 20 words inside a window of 50, the one with the least hash (the leftmost of equals) is the window's anchor
(winnowing), so equal windows have equal anchors and about one position in 16 is an anchor. Documents meet by joining on
anchors; anchors of one document only fall away first.

Extend: an anchor is extended both ways over all windows that chose it; this stretch is its segment. If a smaller document has
the same anchor with the same segment, all its windows repeat. What is left, one occurrence of each different segment of a
shared anchor, is extended window by window: windows are compared by hash with those of the other segments. So a passage
in m documents costs m segment rows, and its windows are looked at once, never m^2 pairs. Overlapping repeats are merged
into maximal ones, each of at least 50 words.

A word is removed if a window that covers it starts with the same words in a document with a smaller doc_id; windows are
judged on the input. Hashes have 128 bits (anchor and window, of independent bases).

Nulls: a null text has no words; a row with a null doc_id is neither smaller nor larger than any, it stays whole. Rows of one id
are told apart by a hash of the text and do not count as repeats of each other. An empty table gives no rows. Names of two leading underscores are reserved.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anew, bounded_batches, discard, materialize, read

WINDOW, SEED_WORDS = 50, 20
#: Odd multipliers of the two rolling hashes and of the final mix.
BASES, MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 0xBF58476D1CE4E5B9
#: Word hashes kept by a worker.
CACHED_WORDS = 500_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int):
    """base^j and base^-j modulo 2^64 for j < size."""
    import numpy as np

    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, b, dtype=np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out


class Rolling:
    """Hashes of any runs of words of one document, in two independent bases."""

    def __init__(self, words: list[bytes]):
        import numpy as np

        h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        self.sums, self.inverse = [], []
        size = 1 << max(12, len(words).bit_length())
        for base in BASES:
            up, down = _powers(base, size)
            sums = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(h * up[: len(words)], out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(down)

    def of(self, which: int, start, length):
        """Hashes of the runs that start at the given places."""
        import numpy as np

        sums = self.sums[which]
        x = (sums[start + length] - sums[start]) * self.inverse[which][start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
        return x ^ (x >> np.uint64(29))


def chosen_anchors(hashes, span: int):
    """Place of the least (leftmost) hash of every run of `span` hashes, by doubling."""
    import numpy as np

    at, length = np.arange(len(hashes)), 1
    while length < span:
        step = min(length, span - length)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        length += step
    return at


def segments(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """anchor, segment, doc_id, th, first, n: for each anchor its hash, that of its segment, and the windows that chose it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["anchor", "segment", "doc_id", "th", "first", "n"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                rolling = Rolling(words)
                grams = rolling.of(0, np.arange(len(words) - seed + 1), seed)
                at = chosen_anchors(grams, window - seed + 1)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                n = np.diff(np.concatenate((first, [len(at)])))
                whole = rolling.of(1, first, n - 1 + window)
                whole = (whole ^ (at[first] - first).astype(np.uint64)) * np.uint64(MIX) ^ n.astype(np.uint64)
                for column, values in zip(out, (grams[at[first]].view(np.int64), whole.view(np.int64), np.full(len(first), i), None, first, n), strict=True):
                    column.append(values) if values is not None else None
            if not out[0]:
                continue
            rows = pa.array(np.concatenate(out[2]))
            arrays = [pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), batch.column("doc_id").take(rows), batch.column("th").take(rows)]
            arrays += [pa.array(np.concatenate(out[k]).astype(np.int32)) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"anchor long, segment long, doc_id {kind}, th long, first int, n int")


def window_hashes(listed: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, hash, doc_id, th, first of every window in the lists (seeds array<struct<first, n, anchor>>) of the documents."""
    kind = listed.schema["doc_id"].dataType.simpleString()
    names = ["anchor", "hash", "doc_id", "th", "first"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            anchor, hashes, index, places = [], [], [], []
            for i, (text, seeds) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("seeds").to_pylist(), strict=True)):
                rolling = Rolling(text.split())
                n = np.array([s["n"] for s in seeds])
                at = np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in seeds])
                anchor.append(np.repeat(np.array([s["anchor"] for s in seeds]), n))
                hashes.append(rolling.of(1, at, window).view(np.int64))
                index.append(np.full(len(at), i))
                places.append(at)
            if anchor:
                rows = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchor)), pa.array(np.concatenate(hashes)), batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(np.concatenate(places).astype(np.int32))],
                    names,
                )

    return listed.select("doc_id", "th", "text", "seeds").mapInArrow(run, f"anchor long, hash long, doc_id {kind}, th long, first int")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, th, spans: windows of each document that start in a smaller one too, as array<struct<first, n>>.

    docs has doc_id (none null), th and text. What is written to the shared folder are segments, about 2 bytes a word.
    """
    every = materialize(segments(docs, window, seed), "segments")
    reach = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(anew("anchor").alias("x"))
    shared = materialize(every.join(reach, F.col("anchor") == F.col("x"), "left_semi"), "shared-segments")
    discard(every)
    segment = shared.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least"))
    least = segment.select(anew("anchor").alias("x"), anew("segment").alias("y"), "least")
    known = shared.join(least, (F.col("anchor") == F.col("x")) & (F.col("segment") == F.col("y"))).drop("x", "y")
    again = known.where("doc_id > least").select("doc_id", "th", "first", "n")
    several = segment.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select(anew("anchor").alias("z"))
    open_ends = known.where("doc_id = least").join(several, F.col("anchor") == F.col("z"), "left_semi")
    lists = open_ends.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "anchor")).alias("seeds"))
    windows = window_hashes(lists.join(docs.select("doc_id", "th", "text"), ["doc_id", "th"]), window)
    windows = materialize(windows, "windows")
    first_of = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    first_of = first_of.select(anew("anchor").alias("x"), anew("hash").alias("y"), "lo")
    late = windows.join(first_of, (F.col("anchor") == F.col("x")) & (F.col("hash") == F.col("y"))).where("doc_id > lo")
    found = again.unionByName(late.select("doc_id", "th", "first", F.lit(1).alias("n")))
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def covered(n_words: int, spans: list | None, window: int = WINDOW):
    """Boolean array: words inside a repeated window."""
    import numpy as np

    edge = np.zeros(n_words + 1, dtype=np.int64)
    if spans:
        first = np.array([s["first"] for s in spans])
        n = np.array([s["n"] for s in spans])
        np.add.at(edge, first, 1)
        np.add.at(edge, first + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def maximal(removed) -> list[tuple[int, int]]:
    """Maximal repeats as (first word, number of words)."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def strip(text: bytes, removed) -> bytes:
    """The text without the removed words and the white space after each removed stretch."""
    if not removed.any():
        return text
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for first, n in maximal(removed):
        out.append(text[at : starts[first]])
        at = starts[first + n]
    return b"".join([*out, text[at:]])


def _with_spans(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs and their column __spans."""
    marked = docs.withColumn("__th", F.xxhash64("text"))
    spans = repeats(marked.where("doc_id IS NOT NULL").select("doc_id", F.col("__th").alias("th"), "text"), window, seed)
    named = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.col("spans").alias("__spans"))
    return marked.join(named, (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__t")), "left").select(*docs.columns, "__spans")


def substring_digest(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (the maximal ones)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first: long, n: long>>"

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            n_words, n_removed, digests, spans_out = [], [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                words = (text or b"").split()
                removed = covered(len(words), spans, window)
                kept = [w for w, r in zip(words, removed.tolist(), strict=True) if not r] if spans else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans_out.append([{"first": a, "n": n} for a, n in maximal(removed)] if spans else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans_out, shape)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
            )

    return _with_spans(docs.select("doc_id", "text"), window, seed).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """The documents with repeats cut out; n_chars, where it is a column, follows. Documents that lose all words go."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, stay = [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if not spans:
                    texts.append(text)
                    stay.append(True)
                    continue
                removed = covered(len(text.split()), spans, window)
                texts.append(strip(text, removed))
                stay.append(not removed.all())
            arrays = []
            for name in batch.schema.names:
                if name == "text":
                    arrays.append(pa.array(texts, pa.binary()).cast(pa.string()))
                elif name == "n_chars":
                    cut = batch.column("__spans").is_valid()
                    lengths = [len(t.decode()) if c else n for t, c, n in zip(texts, cut.to_pylist(), batch.column(name).to_pylist(), strict=True)]
                    arrays.append(pa.array(lengths, batch.schema.field(name).type))
                elif name != "__spans":
                    arrays.append(batch.column(name))
            out = pa.RecordBatch.from_arrays(arrays, [n for n in batch.schema.names if n != "__spans"])
            yield out.filter(pa.array(stay, pa.bool_()))

    return _with_spans(docs, window, seed).mapInArrow(run, docs.schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_digest(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM late, (SELECT unnest(range(50)) AS k)),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n FROM tok ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
