"""Runs of repeating words by Lyndon factors.

A run is a stretch of words with a smallest period q that no neighbouring word extends. The least rotation of its period under one of the two orders of the
words is a Lyndon word, and at each of its places inside the run it is the longest one that starts there. So the longest Lyndon words of all places, under an order and its reverse, name every run.
They come from a stack that is scanned right to left: a suffix takes over those on the stack that are greater than itself. Suffixes are compared by their longest common
extension: a few words directly, then doubling steps and a binary search by rolling hash, then the words that differ. No suffix array is
made. A candidate whose period does not come again on either side is left out by hash; the others are extended both ways by the same search, and every run is verified word by word.

Hashes have 64 bits; a false run can't result, since runs are verified.

One narrow pass over Arrow batches bounded by bytes; a text costs its words in memory, whatever its runs. Nulls: a null text has no words and
no runs; ids are passed on. Repeated rows give their result each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, let, read, words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
BASE, MIX, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
#: Words compared one by one before hashes are asked.
DIRECT = 8


@functools.lru_cache(maxsize=4)
def _powers(size: int):
    import numpy as np

    up = np.full(size, BASE, dtype=np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up)


class Extensions:
    """Longest common extensions of two places of a sequence of numbers, both ways."""

    def __init__(self, ids: list[int]):
        import numpy as np

        self.ids, self.n = ids, len(ids)
        letters = (np.array(ids, dtype=np.uint64) + np.uint64(1)) * np.uint64(MIX)
        letters ^= letters >> np.uint64(29)
        size = 1 << max(10, self.n.bit_length())
        self.powers = _powers(size)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(letters * self.powers[: self.n], out=self.sums[1:])

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        return self.sums.tolist(), self.powers[: self.n + 1].tolist()

    def _longest(self, equal, limit: int) -> int:
        """The greatest length up to limit for which equal(length) holds, by doubling and halving."""
        low, step = DIRECT, 2 * DIRECT
        while step <= limit and equal(step):
            low, step = step, 2 * step
        high = min(step, limit + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if equal(mid):
                low = mid
            else:
                high = mid
        return low

    def forward(self, i: int, j: int) -> int:
        """Words that agree from i and from j on; i < j."""
        ids, limit = self.ids, self.n - j
        for k in range(min(DIRECT, limit)):
            if ids[i + k] != ids[j + k]:
                return k
        if limit <= DIRECT:
            return limit
        sums, powers = self.lists
        a, b, shift = sums[i], sums[j], powers[j - i]
        return self._longest(lambda length: not ((sums[i + length] - a) * shift - sums[j + length] + b) & MASK, limit)

    def backward(self, i: int, j: int) -> int:
        """Words that agree before i and before j; i < j."""
        ids, limit = self.ids, i
        for k in range(min(DIRECT, limit)):
            if ids[i - 1 - k] != ids[j - 1 - k]:
                return k
        if limit <= DIRECT:
            return limit
        sums, powers = self.lists
        a, b, shift = sums[i], sums[j], powers[j - i]
        return self._longest(lambda length: not ((a - sums[i - length]) * shift - b + sums[j - length]) & MASK, limit)

    def twice(self, start, period):
        """Whether the `period` words from start on come again right behind themselves."""
        import numpy as np

        out = np.zeros(len(start), dtype=bool)
        fits = np.flatnonzero((start >= 0) & (start + 2 * period <= self.n))
        a, p = start[fits], period[fits]
        out[fits] = (self.sums[a + p] - self.sums[a]) * self.powers[p] == self.sums[a + 2 * p] - self.sums[a + p]
        return out


def longest_lyndon(ids: list[int], extensions: Extensions, reverse: bool) -> list[int]:
    """End of the longest Lyndon word at each place, under the order of the numbers or its reverse; the end of the text is least in both."""
    n, forward = len(ids), extensions.forward
    ends, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        word, top = ids[i], stack[-1]
        while top < n:
            a, b = word, ids[top]
            if a == b:
                same = forward(i, top)
                if top + same == n:
                    break
                a, b = ids[i + same], ids[top + same]
            if (a < b) == reverse:
                break
            stack.pop()
            top = stack[-1]
        ends[i] = top
        stack.append(i)
    return ends


def find_runs(ids: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of at least least_length words and least_exponent (2 or more) periods, by start and period."""
    import numpy as np

    n = len(ids)
    if n < max(least_length, least_exponent):
        return []
    extensions, starts = Extensions(ids), np.arange(n)
    candidates = []
    for reverse in (False, True):
        period = np.array(longest_lyndon(ids, extensions, reverse)) - starts
        fits = period * least_exponent <= n
        if least_exponent >= 3:  # one of the two extensions has a whole period
            fits &= extensions.twice(starts, period) | extensions.twice(starts - period, period)
        fits = np.flatnonzero(fits)
        candidates += zip(period[fits].tolist(), fits.tolist(), strict=True)
    found, last = [], (0, 0, 0)  # the run found last: period, start, end
    for q, i in sorted(set(candidates)):
        if q == last[0] and last[1] <= i and i + q <= last[2]:
            continue
        start, end = i - extensions.backward(i, i + q), i + q + extensions.forward(i, i + q)
        if end - start < 2 * q:
            continue
        last = (q, start, end)
        if end - start >= max(least_length, least_exponent * q):
            if ids[start : end - q] != ids[start + q : end]:
                raise AssertionError("two different stretches of words have one hash")
            found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (array<struct<start, length, period>> by start and period), collapsed (the text with each run cut to its first period)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            n_words, all_runs, collapsed = [], [], []
            for text in batch.column("text").to_pylist():
                ws, numbers = (text or b"").split(), {}
                ids = [numbers.setdefault(w, len(numbers)) for w in ws]
                runs = find_runs(ids, least_length, least_exponent)
                if runs:
                    edge = np.zeros(len(ws) + 1, dtype=np.int64)
                    for start, length, q in runs:
                        edge[start + q] += 1
                        edge[start + length] -= 1
                    ws = [ws[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_words.append(len(ids))
                all_runs.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                collapsed.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(all_runs, shape), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in the documents whose id's checksum ends in 0, the words from a place on repeat with one period (test data of the query)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.when(F.size(w) > 0, let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda c: F.array_join(F.transform(w, lambda x, i: F.when(i < c["a"], x).otherwise(F.get(w, c["a"] + (i - c["a"]) % c["p"]))), " "))).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), periodic)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    wide = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return wide.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
