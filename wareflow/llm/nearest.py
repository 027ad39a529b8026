"""Approximate nearest neighbours by a hash-prefix forest, Euclidean distance.

A tree gives every vector a string of `BITS` bits, the signs of its projections on random directions about the mean; its sorted array is
all strings in order. A query descends in each tree to its place, the longest-prefix match, and then all trees ascend together, one bit
at a time, so the prefix that a candidate must share gets shorter until `enough` entries of all trees share it; at the last level trees
join one after the other. The candidates' distances are computed in double precision on the original vectors.

The forest is global. All arrays are sorted at once by range partitions; an entry's place in the whole order deals it into a block of
bounded size. A query visits all blocks that hold entries of its array up to `enough` places each way, however many blocks these are, so the ascent
is never cut and no block depends on how vectors cluster. Blocks are visited twice: for the number of entries that
share each length of prefix, summed over the blocks, from which every query's last level follows, and for the candidates. Candidates meet vectors in blocks dealt
by id, to which they go as lists of ids with one copy of the query's vector; a block returns only its best few of each query.

`enough` is measured, not assumed: a bounded sample of `SAMPLE` vectors is compared with all vectors in one pass, by distance and by
length of shared prefix, and the least number is taken at which the forest finds `RECALL` of their true neighbours. Vectors with
structure need few candidates, uniformly random ones a share that falls slowly with their number. Only sums and the sample's
neighbours reach the driver.

Equal vectors are one class with its least ids, so any number of copies is one entry. Nulls: vectors that are null, empty, zero or hold
null or non-finite components take no part, nor rows with a null id. Vectors of another length are no candidates (each length has
a forest of its own). Repeated rows count once. Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import anew, discard, materialize, read

#: Trees, bits of a hash string (at most 52, so that a string is an exact double), seed of the directions.
TREES, BITS, SEED = 64, 48, 11
#: Vectors of the bounded sample that gives the mean; those of them that calibrate the search, and the recall to reach there.
MEAN_ROWS, SAMPLE, RECALL = 1024, 64, 0.93
#: Entries of a block of the sorted arrays at least and at most; entries of a range partition.
BLOCK_ENTRIES, MOST_ENTRIES, SORT_ENTRIES = 1 << 16, 1 << 20, 1 << 19
#: Bytes of vectors, and of query vectors or lists of ids, in a block where they meet.
VECTOR_BYTES, LIST_BYTES = 8 << 20, 64 << 20


@functools.lru_cache(maxsize=2)
def _directions(dim: int, trees: int):
    import numpy as np

    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * BITS))


def hash_strings(vectors, mean, trees: int):
    """The hash strings of vectors of one length in every tree, as numbers below 2^BITS (vectors x trees)."""
    import numpy as np

    out = np.empty((len(vectors), trees), dtype=np.int64)
    for i in range(0, len(vectors), 1024):
        bits = ((vectors[i : i + 1024] - mean) @ _directions(vectors.shape[1], trees) > 0).reshape(-1, trees, BITS)
        packed = np.zeros((len(bits), trees, 8), dtype=np.uint8)
        packed[:, :, 8 - BITS // 8 :] = np.packbits(bits, axis=2)
        out[i : i + 1024] = packed.view(">i8").reshape(-1, trees)
    return out


def shared_prefix(a, b):
    """Length of the common prefix of hash strings."""
    import numpy as np

    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _by_length(column):
    """(rows, their vectors in double precision) for each length of vector in an Arrow list column."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def _lists(values, sizes, kind):
    """An Arrow list column from joined values and the sizes of its rows."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


class Sample:
    """The bounded sample: a mean for each length of vector, and the vectors that calibrate the search."""

    def __init__(self, classes: DataFrame, trees: int):
        import numpy as np

        rows = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(MEAN_ROWS).toArrow()
        groups = list(_by_length(rows.column("v").combine_chunks())) if rows.num_rows else []
        self.trees, self.means = trees, {x.shape[1]: x.mean(axis=0) for _, x in groups}
        reps = rows.column("rep").to_numpy()
        few = [(x.shape[1], r[r < SAMPLE], x[r < SAMPLE]) for r, x in groups]
        self.asked = {dim: (r, reps[r], x, hash_strings(x, self.means[dim], trees)) for dim, r, x in few if len(r)}

    def strings(self, vectors):
        return hash_strings(vectors, self.means.get(vectors.shape[1], 0.0), self.trees)


def with_strings(classes: DataFrame, sample: Sample) -> DataFrame:
    """rep, v, asked, dim, strings (one for each tree)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            v = batch.column("v")
            strings, dims = np.empty((batch.num_rows, sample.trees), dtype=np.int64), np.empty(batch.num_rows, dtype=np.int32)
            for rows, x in _by_length(v):
                strings[rows], dims[rows] = sample.strings(x), x.shape[1]
            lists = _lists(strings.ravel(), np.full(batch.num_rows, sample.trees), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), v, batch.column("asked"), pa.array(dims), lists], ["rep", "v", "asked", "dim", "strings"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("rep", "v", "asked").mapInArrow(run, f"rep long, v {kind}, asked boolean, dim int, strings array<long>")


def calibrate(coded: DataFrame, sample: Sample, k: int) -> int:
    """The least number of entries with which the sample finds RECALL of its k nearest, by one pass over all vectors."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros((SAMPLE, BITS + 1), dtype=np.int64)
        best = {}
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            strings = batch.column("strings").flatten().to_numpy().reshape(-1, sample.trees)
            for rows, x in _by_length(batch.column("v")):
                if x.shape[1] not in sample.asked:
                    continue
                for s, own, q, code in zip(*sample.asked[x.shape[1]], strict=True):
                    prefix = shared_prefix(strings[rows], code)
                    counts[s] += np.bincount(prefix.ravel(), minlength=BITS + 1)
                    other = reps[rows] != own
                    d, at, p = np.sqrt(((x[other] - q) ** 2).sum(axis=1)), reps[rows][other], prefix[other].max(axis=1)
                    d, at, p = (np.concatenate(c) for c in zip(best.get(s, (d[:0], at[:0], p[:0])), (d, at, p), strict=True))
                    top = np.lexsort((at, d))[:k]
                    best[s] = d[top], at[top], p[top]
        s, level = np.nonzero(counts)
        none = lambda n, kind: pa.nulls(n, kind)
        found = [(np.full(len(d), s_), d, at, p) for s_, (d, at, p) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(level, pa.int32()), pa.array(counts[s, level]), none(len(s), pa.float64()), none(len(s), pa.int64())], ["s", "level", "n", "d", "rep"])
        for s_, d, at, p in found:
            yield pa.RecordBatch.from_arrays([pa.array(s_, pa.int32()), pa.array(p, pa.int32()), none(len(d), pa.int64()), pa.array(d), pa.array(at)], ["s", "level", "n", "d", "rep"])

    seen = materialize(coded.select("rep", "v", "strings").mapInArrow(run, "s int, level int, n long, d double, rep long"), "vector-sample")
    shared = np.zeros((SAMPLE, BITS + 2), dtype=np.int64)
    for r in seen.where("n IS NOT NULL").groupBy("s", "level").agg(F.sum("n").alias("n")).collect():
        shared[r.s, r.level] = r.n
    shared = shared[:, ::-1].cumsum(axis=1)[:, ::-1]  # entries that share at least so many bits
    nearest_of = Window.partitionBy("s").orderBy("d", "rep")
    true = seen.where("n IS NULL").withColumn("rn", F.row_number().over(nearest_of)).where(F.col("rn") <= k).select("s", "level").collect()
    discard(seen)
    most = max(1, int(shared[:, 0].max(initial=0)))
    enough = sample.trees * (k + 1)  # an entry counts once in each tree, so these are k others at least
    if not true:
        return enough
    s, level = np.array([(r.s, r.level) for r in true]).T
    while enough < most:
        last = (shared[s, 1:-1] >= enough).sum(axis=1)  # the level at which there are enough
        part = np.clip((enough - shared[s, last + 1]) / np.maximum(1, shared[s, last] - shared[s, last + 1]), 0, 1)
        if (np.where(level > last, 1.0, np.where(level == last, part, 0.0))).mean() >= RECALL:
            break
        enough = math.ceil(enough * 1.15)
    return min(enough, max(most, sample.trees * (k + 1)))


def sorted_arrays(coded: DataFrame, entries: int) -> tuple[DataFrame, DataFrame]:
    """All arrays in one order (dim, tree, string, rep, asked, rank), and the written table that they are read from."""
    order = ["dim", "tree", "string", "rep"]
    each = coded.select("dim", "rep", "asked", F.posexplode("strings").alias("tree", "string"))
    dealt = each.repartitionByRange(max(1, math.ceil(entries / SORT_ENTRIES)), *order).sortWithinPartitions(*order)
    placed = dealt.select(*order, "asked", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("idx"))
    placed = materialize(placed, "vector-arrays")
    sizes = placed.groupBy("pid").agg(F.count("*").alias("n"))  # one row for each range partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("pid").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return placed.join(offsets, F.col("pid") == F.col("p")).select(*order, "asked", (F.col("skip") + F.col("idx")).alias("rank")), placed


def packed_blocks(ranked: DataFrame, size: int) -> DataFrame:
    """block, runs (start, tree, dim of each array in it), strings, reps: `size` successive entries of the sorted arrays."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        at = np.argsort(table.column("rank").to_numpy())
        dim, tree, strings, reps = (table.column(c).to_numpy()[at] for c in ("dim", "tree", "string", "rep"))
        start = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (dim[1:] != dim[:-1])))).astype(np.int32)
        packed = [np.stack([start, tree[start], dim[start]]).astype("<i4"), strings.astype("<i8"), reps.astype("<i8")]
        return pa.table({"block": table.column("block")[:1], **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("runs", "strings", "reps"), packed, strict=True)}})

    placed = ranked.select(F.floor(F.col("rank") / size).alias("block"), "dim", "tree", "string", "rep", "rank")
    return materialize(placed.groupBy("block").applyInArrow(run, "block long, runs binary, strings binary, reps binary"), "vector-blocks")


def visits(ranked: DataFrame, size: int, reach: int) -> DataFrame:
    """query, dim, tree, string, rank, home, block: each query in every block that holds entries of its array within reach, however many they are."""
    bounds = ranked.groupBy(F.col("dim").alias("d"), F.col("tree").alias("t")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    own = ranked.where("asked").join(bounds, (F.col("dim") == F.col("d")) & (F.col("tree") == F.col("t")))
    first, last = F.floor(F.greatest(F.col("lo"), F.col("rank") - reach) / size), F.floor(F.least(F.col("hi"), F.col("rank") + reach) / size)
    return own.select(F.col("rep").alias("query"), "dim", "tree", "string", "rank", F.floor(F.col("rank") / size).alias("home"), F.explode(F.sequence(first, last)).alias("block"))


def met(blocks: DataFrame, visiting: DataFrame) -> DataFrame:
    """Blocks with their visitors, in lists by the visitors' home block, so that a list is at most a block."""
    names = [c for c in visiting.columns if c not in ("block", "home")]
    lists = visiting.groupBy("block", "home").agg(*(F.collect_list(c).alias(c) for c in names)).withColumnRenamed("block", "b").drop("home")
    return blocks.join(lists, F.col("block") == F.col("b")).drop("b")


def _meetings_in(row: dict, size: int):
    """(tree, reps and strings of the array's part, rank of its first entry, places of its visitors in the lists) for each array in a block."""
    import numpy as np

    start, tree, dim = np.frombuffer(row["runs"], dtype="<i4").reshape(3, -1)
    strings, reps = np.frombuffer(row["strings"], dtype="<i8"), np.frombuffer(row["reps"], dtype="<i8")
    trees, dims = np.array(row["tree"]), np.array(row["dim"])
    for a, b, t, d in zip(start, [*start[1:], len(reps)], tree, dim, strict=True):
        here = np.flatnonzero((trees == t) & (dims == d))
        if len(here):
            yield int(t), reps[a:b], strings[a:b], row["block"] * size + int(a), here


def _shares(strings, base: int, own, rank, level, reach: int):
    """First and last place of the entries that share `level` bits (one for each query) with the queries and stand within reach of their ranks."""
    import numpy as np

    low = (np.int64(1) << (BITS - level)) - 1
    lo = np.maximum(np.searchsorted(strings, own & ~low, "left"), rank - reach - base)
    hi = np.minimum(np.searchsorted(strings, own | low, "right"), rank + reach + 1 - base)
    return lo, np.maximum(lo, hi)


def count_shared(meeting: DataFrame, size: int, reach: int) -> DataFrame:
    """query, tree, counts: for each length of prefix the entries of the tree that share it, over all blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                own, rank, query = (np.array(row[c]) for c in ("string", "rank", "query"))
                for tree, _, strings, base, here in _meetings_in(row, size):
                    spans = [_shares(strings, base, own[here], rank[here], np.full(len(here), level), reach) for level in range(BITS + 1)]
                    counts = np.stack([hi - lo for lo, hi in spans], axis=1)
                    n = len(here)
                    yield pa.RecordBatch.from_arrays([pa.array(query[here]), pa.array(np.full(n, tree), pa.int32()), _lists(counts.ravel(), np.full(n, BITS + 1), pa.int64())], ["query", "tree", "counts"])

    parts = meeting.mapInArrow(run, "query long, tree int, counts array<long>")
    return parts.groupBy("query", "tree").agg(F.array(*(F.sum(F.get("counts", F.lit(k))) for k in range(BITS + 1))).alias("counts"))


def last_levels(counted: DataFrame, enough: int) -> DataFrame:
    """query, level, until: trees up to `until` ascend to `level`, the others to one bit more; together they have enough entries."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                level, until = [], []
                for found in part.column("of").to_pylist():
                    found.sort(key=lambda f: f["tree"])
                    counts = np.array([f["counts"] for f in found], dtype=np.int64)
                    total = counts.sum(axis=0)
                    at = int(np.flatnonzero(total >= enough).max(initial=0))
                    longer = counts[:, at + 1] if at < BITS else np.zeros(len(counts), dtype=np.int64)
                    grown = longer.sum() + np.cumsum(counts[:, at] - longer)
                    level.append(at)
                    until.append(found[min(int(np.searchsorted(grown, enough)), len(found) - 1)]["tree"])
                yield pa.RecordBatch.from_arrays([part.column("query"), pa.array(level, pa.int32()), pa.array(until, pa.int32())], ["query", "level", "until"])

    grouped = counted.groupBy("query").agg(F.collect_list(F.struct("tree", "counts")).alias("of"))
    return grouped.mapInArrow(run, "query long, level int, until int")


def _meeting_block(rep: Column, blocks: int) -> Column:
    return F.pmod(rep.bitwiseXOR(F.shiftrightunsigned(rep, 15)).bitwiseXOR(F.shiftrightunsigned(rep, 31)), F.lit(blocks)).cast("int")


def candidates(blocks: DataFrame, visiting: DataFrame, counted: DataFrame, enough: int, size: int, reach: int, meetings: int) -> DataFrame:
    """query, at, reps: the candidates of each query, in lists by the block where they meet their vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                own, rank, query, level, until = (np.array(row[c]) for c in ("string", "rank", "query", "level", "until"))
                for tree, reps, strings, base, here in _meetings_in(row, size):
                    last = level[here] + (tree > until[here])
                    lo, hi = _shares(strings, base, own[here], rank[here], np.minimum(last, BITS), reach)
                    for j in range(0, len(here), 64):  # bounds what is held at once
                        n = np.where(last[j : j + 64] > BITS, 0, hi[j : j + 64] - lo[j : j + 64])
                        at = np.repeat(lo[j : j + 64] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        found, owner = reps[at], np.repeat(np.arange(len(n)), n)
                        u = found.view(np.uint64)
                        meet = ((u ^ (u >> np.uint64(15)) ^ (u >> np.uint64(31))).view(np.int64) % meetings).astype(np.int64)
                        by = np.lexsort((meet, owner))
                        found, owner, meet = found[by], owner[by], meet[by]
                        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (meet[1:] != meet[:-1])))) if len(found) else np.zeros(0, dtype=np.int64)
                        sizes = np.diff(np.append(cut, len(found)))
                        yield pa.RecordBatch.from_arrays([pa.array(query[here[j : j + 64]][owner[cut]]), pa.array(meet[cut], pa.int32()), _lists(found, sizes, pa.int64())], ["query", "at", "reps"])

    levels = last_levels(counted, enough).select(F.col("query").alias("q"), "level", "until")
    found = met(blocks, visiting.join(levels, F.col("query") == F.col("q")).drop("q")).mapInArrow(run, "query long, at int, reps array<long>")
    return found.groupBy("query", "at").agg(F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps"))


def measured(coded: DataFrame, found: DataFrame, k: int, meetings: int) -> DataFrame:
    """query, rep, score: the k nearest candidates of each query in every block, its own class included."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            vectors = {}
            for rows, x in _by_length(left.column("v").combine_chunks()):
                reps = left.column("rep").to_numpy()[rows]
                order = np.argsort(reps)
                vectors[x.shape[1]] = reps[order], x[order]
            for at in range(right.num_rows):
                row = right.slice(at, 1)
                query = row.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                reps = row.column("reps").combine_chunks().flatten().to_numpy()
                have, x = vectors[len(query)]
                d = np.sqrt(((x[np.searchsorted(have, reps)] - query) ** 2).sum(axis=1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    reps, d = reps[near], d[near]
                best = np.lexsort((reps, d))[:k]
                for column, values in zip(out, (np.full(len(best), row.column("query")[0].as_py()), reps[best], d[best]), strict=True):
                    column.append(values)
        query, rep, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query": pa.array(query, pa.int64()), "rep": pa.array(rep, pa.int64()), "score": pa.array(score, pa.float64())})

    vectors = coded.select("rep", "v", _meeting_block(F.col("rep"), meetings).alias("at"))
    own = coded.where("asked").select(F.col("rep").alias("q"), F.col("v").alias("w"))
    lists = found.join(own, F.col("query") == F.col("q")).select("query", "at", "reps", "w")
    return vectors.groupBy("at").cogroup(lists.groupBy("at")).applyInArrow(run, "query long, rep long, score double")


def meeting_blocks(n: int, asked: int, size: int, enough: int) -> int:
    """How many blocks vectors of `size` bytes are dealt into. A query's vector goes once to each block that it has candidates in."""
    of_vectors, of_ids = size / VECTOR_BYTES, 8 * asked * enough / LIST_BYTES
    queries = asked * size / max(1, n)
    of_queries = queries * enough / LIST_BYTES if queries > LIST_BYTES else 0
    return max(1, math.ceil(max(of_vectors, of_ids, of_queries)))


def searched(classes: DataFrame, k: int, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(query, rep, score) of the nearest classes found for each asked class, and the candidate lists they come from.

    classes: rep, v, asked.
    """
    sample = Sample(classes, trees)
    coded = materialize(with_strings(classes, sample), "vector-strings")
    n, asked, size_of_all = coded.agg(F.count("*"), F.sum(F.col("asked").cast("long")), F.sum("dim")).first()
    enough = calibrate(coded, sample, k)
    reach = max(1, min(n, enough))  # farther entries of a tree are never needed: nearer ones are enough by themselves
    size = max(BLOCK_ENTRIES, min(reach, MOST_ENTRIES))
    ranked, written = sorted_arrays(coded, n * trees)
    blocks, visiting = packed_blocks(ranked, size), visits(ranked, size, reach)
    counted = materialize(count_shared(met(blocks, visiting), size, reach), "vector-counts")
    meetings = meeting_blocks(n, asked or 0, 4 * (size_of_all or 0), enough)
    found = materialize(candidates(blocks, visiting, counted, enough, size, reach, meetings), "vector-candidates")
    discard(blocks, counted, written)
    return measured(coded, found, k, meetings), found


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score for all rows (vec_id, v) that is_query selects, against all rows but their own."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asked"))
    rows = rows.groupBy("v", "vec_id").agg(F.max("asked").alias("asked"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.withColumn("rn", least).where(F.col("rn") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    queries = rows.where("asked").select("vec_id", "v")
    wanted = queries.select(F.col("v").alias("w")).distinct().withColumn("asked", F.lit(True))
    classes = materialize(ids.join(wanted, F.col("v") == F.col("w"), "left").select("rep", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vector-classes")
    own = queries.join(classes.where("asked").select(F.col("v").alias("w"), "rep"), F.col("v") == F.col("w")).select("vec_id", "rep")
    found, _ = searched(classes.select("rep", "v", "asked"), k + 1, trees)
    ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))).where(F.col("rn") <= k + 1)
    members = ranked.join(classes.select(F.col("rep").alias("r"), "ids"), F.col("rep") == F.col("r")).select("query", F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id"))).alias("found"))
    lists = members.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    each = own.join(lists.select(anew("query").alias("q"), "found"), F.col("rep") == F.col("q"))
    best = each.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    return best.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest(rows, F.col("vec_id") % 100 == 0)
