"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits over the XXH64 hashes of word shingles. Fingerprints at a Hamming distance of at most `threshold` are linked.

The 64 bits are split into blocks whose own thresholds add up to threshold - blocks + 1, so that linked fingerprints agree within
its threshold in some block. In each block a covering code gives the anchors: perfect Hamming codes (radius 1) on 2^r - 1 bits
with the remaining bits free, or, where the threshold is 0, every value (radius 0). A fingerprint's home is its nearest
anchor; it is replicated to every anchor within covering radius plus the block's threshold. If two fingerprints agree within
the threshold, the second is at the home of the first, so comparing homes with all that came to an anchor finds every link.
With three blocks a fingerprint has about 30 replicas, whatever the data; two blocks have about 190 and a thousandth of the comparisons,
which pays from about 10^9 fingerprints on.

Equal fingerprints are one class before any of this. An anchor with many homes is split: its homes are dealt into parts and each
part meets all members. Within an anchor links are contracted to stars at once, so a group of n copies gives n edges, not n^2.

Nulls: a null text counts as empty, with fingerprint zero, linked like any other; rows with a null doc_id get the component of
their fingerprint and never name one (the id is null if no member has one); `deduplicate` keeps them. Repeated rows share a
fingerprint. An empty table gives no rows. Added names: fp, th; other columns are not read.
"""

from __future__ import annotations

import functools
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import anew, bounded_batches, materialize, read
from .similar import similar

#: Seed of XXH64; part of the definition of a fingerprint.
SEED = 42
#: Homes of one anchor that one task compares; beyond it the anchor is split.
HOMES_PER_TASK = 1 << 15
#: Groups up to this size are compared together, larger ones block by block with local contraction.
SMALL_GROUP = 24


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    over = ends[shingle - 1 :] or ends[-1:]
    counts, n = np.zeros(64, dtype=np.int64), len(over)
    for i in range(0, n, 1 << 15):
        digests = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], over[i : i + (1 << 15)])]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def word_fingerprint(text: bytes | None) -> int:
    """SimHash of the distinct words of a text, as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_digest

    words = list(dict.fromkeys((text or b"").lower().split()))
    if not words:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(words), 1 << 15):
        digests = b"".join(xxh64_digest(w, SEED) for w in words[i : i + (1 << 15)])
        counts += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(words)).tobytes(), "big", signed=True)


def _node(fp, check):
    """What names a class: its fingerprint, or, with a second fingerprint to check, a hash of both."""
    import numpy as np

    return (fp.view(np.uint64) + check.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, by_words: bool = False) -> DataFrame:
    """doc_id, node, fp, check, th (a hash of the text, to tell rows of one id apart).

    fp is that of the shingles and check is 0; by_words: fp is that of the distinct words and check that of the shingles.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.int64)
            check = fp if by_words else np.zeros_like(fp)
            if by_words:
                fp = np.array([word_fingerprint(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_node(fp, check)), pa.array(fp), pa.array(check), batch.column("th")], ["doc_id", "node", "fp", "check", "th"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, node long, fp long, check long, th long")


def layout(threshold: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, width, threshold) of each block."""
    spare = threshold - blocks + 1
    if spare < 0:
        blocks, spare = threshold + 1, 0
    out, at = [], 0
    for k in range(blocks):
        width = (64 - at) // (blocks - k)
        out.append((at, width, spare // blocks + (k < spare % blocks)))
        at += width
    return out


@functools.cache
def hamming_anchors(r: int, reach: int):
    """For the perfect Hamming code of length 2^r - 1: nearest codeword by syndrome, and flips that lead from a word of each
    syndrome to the codewords within 0, 1, .. reach, as (distance, pattern) lists."""
    from itertools import combinations

    n = (1 << r) - 1
    by_syndrome: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for d in range(reach + 1):
        for places in combinations(range(1, n + 1), d):
            s = pattern = 0
            for p in places:
                s ^= p
                pattern |= 1 << (p - 1)
            by_syndrome[s].append((d, pattern))
    return by_syndrome


def anchors(fps, block: int, first: int, width: int, threshold: int):
    """(key, index into fps, is home) arrays of one block for an array of unsigned fingerprints."""
    import numpy as np

    value = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
    tag = np.uint64(block << 58)
    if threshold == 0:
        return value | tag, np.arange(len(fps)), np.ones(len(fps), dtype=bool)
    r = max(k for k in range(2, 6) if (1 << k) - 1 <= width)
    n, reach = (1 << r) - 1, 1 + threshold
    flips = hamming_anchors(r, reach)
    syndrome = np.zeros(len(fps), dtype=np.int64)
    for p in range(1, n + 1):
        syndrome ^= np.where((value >> np.uint64(p - 1)) & np.uint64(1), p, 0)
    free = [0, *(1 << b for b in range(n, width))]
    free_sets = {0: [0], 1: free[1:]}
    for d in range(2, reach + 1):
        free_sets[d] = sorted({a | b for a in free_sets[d - 1] for b in free[1:] if not a & b})
    keys, index, home = [], [], []
    for s in range(n + 1):
        rows = np.flatnonzero(syndrome == s)
        if not len(rows):
            continue
        near = min(flips[s])[1]
        for d, pattern in flips[s]:
            for extra in range(reach - d + 1):
                for f in free_sets[extra]:
                    keys.append(value[rows] ^ np.uint64(pattern | f) | tag)
                    index.append(rows)
                    home.append(np.full(len(rows), f == 0 and pattern == near))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def deal(fps: DataFrame, blocks: list[tuple[int, int, int]], homes_only: bool = False) -> DataFrame:
    """key, fp, home: every distinct fingerprint at every anchor in reach (or only at its homes)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            have = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            check = batch.column("check").to_numpy(zero_copy_only=False)
            for k, (first, width, t) in enumerate(blocks):
                if len(have):
                    keys, index, home = anchors(have, k, first, width, t)
                    if homes_only:
                        keys, index, home = keys[home], index[home], home[home]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(have[index].view(np.int64)), pa.array(check[index]), pa.array(home)], ["key", "fp", "check", "home"])

    return fps.select("fp", "check").mapInArrow(run, "key long, fp long, check long, home boolean")


class _Roots:
    """Union-find over places of one anchor's members."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def join(self, a, b) -> None:
        import numpy as np

        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]


def group_links(fp, check, is_home, threshold: int, most: int):
    """Places (a, b) of star edges among one anchor's members, homes against all, in blocks of bounded size."""
    import numpy as np

    places, found = np.flatnonzero(is_home), _Roots(len(fp))
    step = max(1, (1 << 21) // len(fp))
    for i in range(0, len(places), step):
        rows = places[i : i + step]
        near = np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= threshold
        a, b = np.nonzero(near)
        if most < 64:
            ok = np.bitwise_count(check[rows[a]] ^ check[b]) <= most
            a, b = a[ok], b[ok]
        found.join(rows[a], b)
    moved = np.flatnonzero(found.root != np.arange(len(fp)))
    return moved, found.root[moved]


def compare(dealt: DataFrame, threshold: int, most: int = 64) -> DataFrame:
    """Edges (a, b) between different nodes: fp within threshold and check within `most`. Input is sorted by key in partitions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def small(fp, check, home, lo, hi):
            """All groups [lo, hi) of a few members at once."""
            n = hi - lo
            group = np.repeat(np.arange(len(lo)), n)
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            pick = home[rows]
            rows, group = rows[pick], group[pick]
            for i in range(0, len(rows), 1 << 16):
                r, g = rows[i : i + (1 << 16)], group[i : i + (1 << 16)]
                m = n[g]
                left = np.repeat(r, m)
                right = np.repeat(lo[g] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
                hit = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (np.bitwise_count(check[left] ^ check[right]) <= most)
                yield left[hit], right[hit]

        def closed(held):
            """Edges of whole groups, from columns sorted by key."""
            key, fp, check, home = (np.concatenate([h[k] for h in held]) for k in range(4))
            node, fp, check = _node(fp, check), fp.view(np.uint64), check.view(np.uint64)
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            some = hi - lo > 1
            lo, hi = lo[some], hi[some]
            few = hi - lo <= SMALL_GROUP
            found = list(small(fp, check, home, lo[few], hi[few])) if few.any() else []
            for a, b in zip(lo[~few], hi[~few], strict=True):
                x, y = group_links(fp[a:b], check[a:b], home[a:b], threshold, most)
                found.append((a + x, a + y))
            for a, b in found:
                ends = np.stack([node[a], node[b]], axis=1)
                ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        held: list = []
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "fp", "check", "home")]
            if not len(new[0]):
                continue
            if held and held[-1][0][-1] != new[0][0]:
                yield from closed(held)
                held = []
            end = np.searchsorted(new[0], new[0][-1])  # the last group may go on in the next batch
            if end:
                yield from closed([*held, [x[:end] for x in new]])
                held = []
            held.append([x[end:] for x in new])
        if held:
            yield from closed(held)

    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, threshold: int = 4, blocks: int = 3, most: int = 64, homes_per_task: int = HOMES_PER_TASK) -> DataFrame:
    """Edges that connect all classes (fp, check) within the threshold, contracted at each anchor."""
    plan = layout(threshold, blocks)
    crowded = deal(fps, plan, homes_only=True).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > homes_per_task)
    crowded = crowded.select(F.col("key").alias("k"), F.ceil(F.col("n") / homes_per_task).cast("int").alias("parts"))
    dealt = deal(fps, plan).join(crowded, F.col("key") == F.col("k"), "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp", "check"), parts).cast("int")
    split = dealt.select("key", "fp", "check", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("home").alias("h"), own.alias("own"))
    key = F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part"))
    placed = split.select(key.alias("key"), "fp", "check", (F.col("h") & (F.col("part") == F.col("own"))).alias("home"))
    return compare(placed.repartition("key").sortWithinPartitions("key"), threshold, most)


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4, blocks: int = 3, most: int | None = None) -> DataFrame:
    """doc_id, fp, th, component_id (least doc_id of the component), root (least class of the component).

    Without `most`, shingle fingerprints within the threshold are linked. With it, fingerprints of the distinct words within the
    threshold are linked if those of the shingles are within `most`: edits that a shingle amplifies move few of the former.
    """
    marks = materialize(fingerprints(docs, shingle, most is not None), "fingerprints")
    classes = marks.groupBy("node", "fp", "check").agg(F.min("doc_id").alias("least"))
    found = components(links(classes, threshold, blocks, 64 if most is None else most))
    found = found.select(F.col("node").alias("member"), "root")
    rooted = classes.join(found, classes.node == found.member, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "classes")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(anew("root").alias("r"), "component_id")
    named = rooted.join(names, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "root", "component_id")
    return marks.join(named, marks.node == named.n).select("doc_id", "fp", "th", "component_id", "root")


def anchored(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes (node, fp) whose fingerprints are linked by anchors, or equal: each goes to the least class of a fingerprint."""
    least = materialize(classes.groupBy("fp").agg(F.min("node").alias("first")), "first-classes")
    equal = classes.join(least.select(anew("fp").alias("k"), "first"), F.col("fp") == F.col("k")).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(least.select("fp", F.lit(0).cast("long").alias("check"))).distinct()
    one, two = least.select(F.col("fp").alias("f"), F.col("first").alias("a0")), least.select(F.col("fp").alias("g"), F.col("first").alias("b0"))
    return near.join(one, F.col("a") == F.col("f")).join(two, F.col("b") == F.col("g")).select(F.col("a0").alias("a"), F.col("b0").alias("b")).unionByName(equal)


def deduplicate(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each component, the one with the least doc_id, whole; rows without an id stay.

    Documents are linked if the Jaccard similarity of their shingles is at least `least`. Fingerprints only estimate it: what anchors link is a
    candidate, and so is what MinHash bands propose, since pairs of 0.8 differ in more bits than anchors cover; an exact check follows for all.
    """
    marked = similar(docs.where("doc_id IS NOT NULL"), shingle, least, proposed=anchored)
    best = marked.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("best")).select("best.*")
    th = "__text_hash"
    rows = docs.withColumn(th, F.xxhash64("text"))
    chosen = best.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    stay = rows.join(chosen, (F.col("__id") == F.col("doc_id")) & (F.col("__th") == F.col(th)), "left_semi")
    return stay.dropDuplicates(["doc_id", th]).drop(th).unionByName(docs.where("doc_id IS NULL"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
