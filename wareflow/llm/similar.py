"""Near-duplicates by the exact Jaccard similarity of word shingles.

Candidates: MinHash bands. A pair at the threshold of 0.8 shares a band with probability 1 - (1 - 0.8^6)^40, all but 5 in a million,
and a more similar one sooner. `proposed` may add candidates of another kind, as simhash.anchored does. Bands and those only propose components, which may chain texts that share no more than a template. So pairs are looked at by
prefix filtering inside them: two sets at the threshold share one of their rarest fifth of shingles. Texts around a template have shingles of their own
enough to fill that prefix, and meet nobody. A component of one part goes to one task, which compares pairs by their rarest shingles there, within
the sizes that the threshold allows, and none that are linked already. A larger component is first taken apart by a join on rarest
shingles over all its members; what still hangs together is dealt into parts, and each pair of parts is a task of its own.

Equal sets are one class (node) before any of this; texts without a word, null texts among them, are one class that no other text is similar to.
Repeated rows and copies are one class; rows of one id with different texts are told apart. Long texts are whole, their sets in memory one at a time. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import anew, bounded_batches, discard, materialize

SEED = 42
#: A band is so many minima, and a text has so many bands.
ROWS, BANDS = 6, 40
#: Shingles of a component that are one part; a task holds two parts.
SHINGLES_PER_PART = 1 << 21


@functools.cache
def _factors(n: int):
    """Odd 64-bit numbers, the same everywhere."""
    import numpy as np
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(xxh64_digest(b"%d" % i, SEED) for i in range(n)), dtype=">u8").astype(np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5):
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; fewer words than a shingle has are one shingle."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.frombuffer(b"".join([xxh64_digest(w, SEED) for w in words]), dtype=">u8").astype(np.uint64)
    k = min(shingle, len(each))
    over = np.full(len(each) - k + 1, k, dtype=np.uint64)
    for i, c in enumerate(_factors(shingle)[:k]):
        over += (each[i : len(each) - k + 1 + i] ^ (each[i : len(each) - k + 1 + i] >> np.uint64(31))) * c
    return np.unique(over ^ (over >> np.uint64(29)))


def band_keys(shingles):
    """A 64-bit key for each band; none for an empty set."""
    import numpy as np

    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    factors = _factors(ROWS * BANDS + ROWS)
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for i in range(0, len(shingles), 1 << 11):
        np.minimum(least, (factors[: ROWS * BANDS, None] * shingles[None, i : i + (1 << 11)]).min(axis=1), out=least)
    key = (least.reshape(BANDS, ROWS) * factors[ROWS * BANDS :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def set_fingerprint(shingles) -> int:
    """SimHash of a set of shingle hashes, as a signed 64-bit number; 0 for an empty set."""
    import numpy as np

    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), 1 << 15):
        counts += np.unpackbits(shingles[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (a hash of the text, to tell rows of one id apart), node, size (shingles), fp (SimHash of the shingles), keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_digest

        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            keys = [band_keys(s) for s in sets]
            node = np.frombuffer(b"".join(xxh64_digest(s.tobytes(), SEED) for s in sets), dtype=np.int64)
            at = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), lists], ["doc_id", "th", "node", "size", "fp", "keys"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, node long, size long, fp long, keys array<long>")


def prefix_length(size, least: float):
    """How many of its rarest shingles a set has to look at: two sets of a similarity of `least` share one of them, in any one order of all shingles."""
    import numpy as np

    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def similar_edges(nodes, sets, least: float):
    """Nodes (a, b) of star edges that connect all pairs of sets with a Jaccard similarity of at least `least`, and how many pairs were compared.

    Only pairs that share one of their rarest shingles are looked at, only those of sizes that allow it, and none that are linked already.
    """
    import numpy as np

    nodes, first = np.unique(nodes, return_index=True)
    sets = [sets[i] for i in first]
    size = np.array([len(s) for s in sets])
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at, of = np.concatenate(([0], np.cumsum(size))), np.repeat(np.arange(len(nodes)), size)
    rare_first = np.lexsort((ids, often[ids], of))  # the shingles of each set, rare ones first
    place = np.arange(len(ids)) - at[of]
    heads = rare_first[place < prefix_length(size, least)[of]]
    heads = heads[often[ids[heads]] > 1]
    heads = heads[np.lexsort((of[heads], ids[heads]))]  # postings: the sets of each shingle
    bounds = np.flatnonzero(np.concatenate(([True], ids[heads][1:] != ids[heads][:-1], [True]))) if len(heads) else np.zeros(1, dtype=np.int64)
    root, mark, compared, seen = np.arange(len(nodes)), np.zeros(len(often), dtype=bool), 0, [set() for _ in nodes]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        posting = of[heads[lo:hi]]
        for k in range(len(posting) - 1):
            i, others = posting[k], posting[k + 1 :]
            others = others[(root[others] != root[i]) & (size[others] >= least * size[i]) & (size[i] >= least * size[others])]
            others = np.array([j for j in others.tolist() if j not in seen[i]], dtype=np.int64)
            if not len(others):
                continue
            seen[i].update(others.tolist())
            compared += len(others)
            mine = ids[at[i] : at[i + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[np.concatenate([ids[at[j] : at[j + 1]] for j in others])], np.cumsum(size[others]) - size[others], dtype=np.int64)
            mark[mine] = False
            near = others[shared / (size[i] + size[others] - shared) >= least]
            if len(near):
                roots = np.unique(root[np.append(near, i)])
                root[np.isin(root, roots)] = roots[0]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]], compared


def _compare(dealt: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the groups (root, low, high). Input is sorted by them in partitions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def closed():
            a, b, _ = similar_edges(np.array(nodes), sets, least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        group, nodes, sets = None, [], []
        for batch in batches:
            for root, low, high, node, s in zip(*(batch.column(k).to_pylist() for k in ("root", "low", "high", "node", "shingles")), strict=True):
                if group != (root, low, high):
                    if len(nodes) > 1:
                        yield closed()
                    group, nodes, sets = (root, low, high), [], []
                nodes.append(node)
                sets.append(np.frombuffer(s, dtype=np.uint64))
        if len(nodes) > 1:
            yield closed()

    return dealt.mapInArrow(run, "a long, b long")


def _with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("root", "parts", "node")), pa.array(sets, pa.binary())], ["root", "parts", "node", "shingles"])

    return texts.select("root", "parts", "node", "text").mapInArrow(run, "root long, parts int, node long, shingles binary")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b): every class and the least class of each of its bands."""
    placed = classes.select("node", F.explode("keys").alias("key"))
    least = placed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select(anew("key").alias("k"), "b")
    return placed.join(least, F.col("key") == F.col("k")).where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def refined(members: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) between members that share one of their rarest shingles: every class and the least class of each such shingle.

    Members whose own shingles fill that prefix, as texts around one template do, meet nobody.
    """
    sets = _with_sets(_texts_of(members, docs), shingle)

    def opened(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for node, s in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                each = np.frombuffer(s, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), node)), pa.array(each)], ["node", "s"])

    each = sets.mapInArrow(opened, "node long, s long")
    often = each.groupBy("s").agg(F.count("*").alias("df")).select(anew("s").alias("k"), "df")
    ranked = each.join(often, F.col("s") == F.col("k")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    length = F.size("r") - F.ceil(F.lit(least) * F.size("r") - 1e-9).cast("int") + 1
    heads = ranked.select("node", F.explode(F.slice("r", F.lit(1), length)).alias("h")).where("h.df > 1").select("node", F.col("h.s").alias("s"))
    star = heads.groupBy("s").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select(anew("s").alias("k"), "b")
    return heads.join(star, F.col("s") == F.col("k")).where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _texts_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """root, parts, node and text of one document of each member."""
    wanted = members.select("root", "parts", "node", F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("th") == F.col("__th")))


def _parted(proposed: DataFrame, classes: DataFrame, shingles_per_part: int) -> DataFrame:
    """root, node, size, doc_id, th of the members of each proposed component (node, root), and its number of parts."""
    named = proposed.select(F.col("node").alias("member"), "root")
    members = materialize(named.join(classes, F.col("member") == F.col("node")).select("root", "node", "size", "best.*"), "members")
    parts = members.groupBy("root").agg(F.ceil(F.sum("size") / shingles_per_part).cast("int").alias("parts")).select(anew("root").alias("r"), "parts")
    return members.join(parts, F.col("root") == F.col("r")).drop("r")


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, shingles_per_part: int = SHINGLES_PER_PART, proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, th, root (least class of the component): texts of a similarity of at least `least` are linked, and no others.

    proposed: further candidates (a, b), from the classes (node, fp).
    """
    found = materialize(marks(docs, shingle), "sets")
    classes = materialize(found.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    pairs = candidates(classes) if proposed is None else candidates(classes).unionByName(proposed(classes.select("node", "fp")))
    members = materialize(_parted(components(pairs), classes, shingles_per_part), "members")
    small, large = members.where("parts = 1"), members.where("parts > 1")
    if not large.isEmpty():
        small = small.unionByName(_parted(components(refined(large, docs, shingle, least)), classes, shingles_per_part))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = _with_sets(_texts_of(small, docs), shingle).select("root", "node", "shingles", own.alias("own"), other)
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    edges = _compare(dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high"), least)
    linked = components(edges).select(F.col("node").alias("n"), "root")
    discard(classes, members)
    return found.join(linked, F.col("node") == F.col("n"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
