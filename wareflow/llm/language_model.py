"""Language-model scoring by deleted interpolation.

The model of a token w after v is l2(b) c(vw)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket of the context's
frequency c(v). Counts are of all training documents. The weights l are learned by expectation-maximisation on a deleted
part of them (one document in ten, by id): its tokens are predicted from the counts of the rest.

Texts are packed into blocks of a few MB where they are read, with no shuffle, and written once. Counting and look-up are an exchange
of sorted blocks: each sends its distinct keys (64-bit hashes of words and word pairs, difference-coded) with their counts to parts by
key range; a part adds up the counts (64 bits) and answers each block in the order it asked. A frequent pair comes once from each
block, so no key is hot, and no table of n-grams is ever broadcast or held by one task. Parts are sized by bytes. Up to `FAN` of them
blocks ask the parts; beyond, blocks ask FAN coarse ranges, where those of a group of about FAN blocks are merged before they ask the parts
inside, so a block costs FAN + parts / FAN rows at most. Answers are written to the shared folder; they hold counts only, so weights can
be learned from the deleted blocks alone, before all blocks are scored. Only the scoring shuffles texts, once, to meet their answers.

Nulls: a null text is empty (only its end token is scored); a null doc_id counts as the empty id, which is a training id.
Repeated rows count each, in training as in scoring. A very long text is a block of its own. An empty table gives no rows. Other
columns are not read. Sums over a document run in word order, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, read

FOLDS, HELD_FOLD, DELETED = 7, 2, 10
#: Bytes of text of a block, and those whose keys are one part.
BLOCK_BYTES, PART_BYTES = 4 << 20, 4 << 20
#: Parts that a block asks without a merge in between, and about so many blocks are merged.
FAN = 1 << 11
#: Context-frequency buckets: 0 for an unseen context, then one for each doubling.
BUCKETS = 18
#: Steps of an octave by which ratios are binned for expectation-maximisation, and its rounds.
STEPS, ROUNDS = 4, 60
END, START = 0x9AE16A3B2F90404F, 0xC2B2AE3D27D4EB4F
MULTIPLIER, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def _tokens(texts):
    """Of all documents one after the other: token hashes, contexts' hashes, and where each document starts."""
    import numpy as np

    parts, starts, at = [], [], 0
    for text in texts:
        words = (text or b"").lower().split()
        part = np.empty(len(words) + 1, dtype=np.uint64)
        part[:-1] = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        part[-1] = END
        starts.append(at)
        at += len(part)
        parts.append(part)
    tokens = np.concatenate(parts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return tokens, before, np.array(starts)


def _keys(tokens, before):
    """Unigram keys (lowest bit 1) and bigram keys (lowest bit 0)."""
    import numpy as np

    def mixed(x):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
        return x ^ (x >> np.uint64(29))

    one = mixed(tokens) | np.uint64(1)
    two = mixed(before * np.uint64(MULTIPLIER) + (tokens ^ (tokens >> np.uint64(17)))) & ~np.uint64(1)
    return one, two


def _pack(values) -> bytes:
    """An array of whole numbers, by planes of bytes, compressed; the first four bytes are its length before."""
    import numpy as np
    import pyarrow as pa

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind):
    import numpy as np
    import pyarrow as pa

    size = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, deleted, n_bytes, doc_ids, kinds, sizes, texts: documents (doc_id, kind, text) in blocks, deleted ones (kind 1) apart from the
    rest. The texts of a block are one compressed value, so a row is small wherever it is read."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}
        size = {False: 0, True: 0}

        def block(deleted: bool):
            nonlocal made
            ids, kinds, texts = held[deleted]
            whole = b"".join(texts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(c)) for c in (ids, kinds, [pa.array([len(t) for t in texts], pa.int32())])]
            blob = pa.array([pa.compress(whole, codec="zstd", asbytes=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([deleted]), pa.array([len(whole)], pa.int64()), *lists, blob], ["block", "deleted", "n_bytes", "doc_ids", "kinds", "sizes", "texts"])
            held[deleted], size[deleted], made = ([], [], []), 0, made + 1
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                part = batch.slice(i, 8)
                for deleted in (False, True):
                    own = part.filter(pa.array([(k == 1) == deleted for k in part.column("kind").to_pylist()]))
                    if own.num_rows:
                        texts = [t or b"" for t in own.column("text").cast(pa.binary()).to_pylist()]
                        held[deleted][0].append(own.column("doc_id"))
                        held[deleted][1].append(own.column("kind"))
                        held[deleted][2].extend(texts)
                        size[deleted] += sum(map(len, texts))
                        if size[deleted] >= block_bytes:
                            yield block(deleted)
        for deleted in (False, True):
            if held[deleted][2]:
                yield block(deleted)

    return docs.select("doc_id", "kind", "text").mapInArrow(run, f"block long, deleted boolean, n_bytes long, doc_ids array<{id_type}>, kinds array<int>, sizes array<int>, texts binary")


def _texts(row) -> list:
    """The texts of one block."""
    import numpy as np
    import pyarrow as pa

    size = row.column("n_bytes")[0].as_py()
    whole = pa.decompress(row.column("texts")[0].as_py(), decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(row.column("sizes")[0].as_py())
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _split(keys, first: int, bits: int):
    """Where sorted keys pass from one part to the next, of 2^bits parts by the bits of a key from the `first` highest on."""
    import numpy as np

    parts = (keys << np.uint64(first)) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), dtype=np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return parts[cut].astype(np.int64), cut, np.append(cut[1:], len(keys))


ASK = "who long, part long, keys binary, rest binary, deleted binary"
ANSWER = "who long, part long, rest binary, deleted binary, n_rest long, n_deleted long, v_rest long, v_all long"


def _asked(who: int, base: int, bits: int, every, rest, deleted):
    """A row for each part that has keys of `every`; parts are numbered from base << bits."""
    import pyarrow as pa

    parts, lo, hi = _split(every, base.bit_length() - 1, bits)
    blobs = [[_pack(make(x[a:b])) for a, b in zip(lo, hi, strict=True)] for make, x in ((_differences, every), (lambda c: c, rest), (lambda c: c, deleted))]
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([who] * n, pa.int64()), pa.array((base << bits) + parts), *(pa.array(b, pa.binary()) for b in blobs)], ["who", "part", "keys", "rest", "deleted"])


def _differences(keys):
    import numpy as np

    return np.diff(keys, prepend=np.uint64(0))


def _summed(table):
    """Of all who asked: sizes of their lists, their keys' places among all distinct keys, these keys, and their summed counts."""
    import numpy as np

    blobs = [[_unpack(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("keys", np.uint64), ("rest", np.int64), ("deleted", np.int64))]
    keys = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in blobs[0]])
    every, place = np.unique(keys, return_inverse=True)
    counts = []
    for b in blobs[1:]:
        total = np.zeros(len(every), dtype=np.int64)
        np.add.at(total, place, np.concatenate(b))
        counts.append(total)
    return [len(x) for x in blobs[0]], place, every, *counts


def _answers(table, place, sizes, rest, deleted, totals=None):
    """A row for each who asked, with the counts in the order of the keys; with totals also one for nobody (-1)."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum(sizes)[:-1]
    own = [[_pack(x) for x in np.split(c[place], ends)] for c in (rest, deleted)]
    n, more = len(sizes), [] if totals is None else [0]
    return pa.table({
        "who": pa.array([*table.column("who").to_pylist(), *(-1 for _ in more)], pa.int64()), "part": pa.array([*table.column("part").to_pylist(), *more], pa.int64()),
        "rest": pa.array([*own[0], *(b"" for _ in more)], pa.binary()), "deleted": pa.array([*own[1], *(b"" for _ in more)], pa.binary()),
        **{name: pa.array([0] * n + ([totals[i]] if more else []), pa.int64()) for i, name in enumerate(("n_rest", "n_deleted", "v_rest", "v_all"))},
    })


def ask(blocks: DataFrame, bits: int) -> DataFrame:
    """For each block and each of 2^bits parts: keys, and their counts in training (rest and deleted)."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                tokens, before, starts = _tokens(_texts(row))
                kinds = np.repeat(row.column("kinds").flatten().to_numpy(), np.diff(np.append(starts, len(tokens))))
                one, two = _keys(tokens, before)
                keys, kinds = np.concatenate((one, two)), np.concatenate((kinds, kinds))
                every, place = np.unique(keys, return_inverse=True)
                rest, deleted = (np.bincount(place[kinds == k], minlength=len(every)).astype(np.int64) for k in (0, 1))
                yield _asked(row.column("block")[0].as_py(), 1, bits, every, rest, deleted)

    return blocks.select("block", "n_bytes", "kinds", "sizes", "texts").mapInArrow(run, ASK)


def answer(asked: DataFrame) -> DataFrame:
    """The counts over all who asked, for each in the order of its keys; who -1 has a part's totals of unigrams."""

    def run(table):
        import numpy as np

        sizes, place, every, rest, deleted = _summed(table)
        single = (every & np.uint64(1)) == 1
        totals = [int(rest[single].sum()), int(deleted[single].sum()), int((rest[single] > 0).sum()), int((rest[single] + deleted[single] > 0).sum())]
        return _answers(table, place, sizes, rest, deleted, totals)

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def answer_merged(asked: DataFrame, groups: int, bits: int) -> DataFrame:
    """As answer, for blocks that asked coarse parts: groups of blocks are merged in each, and ask 2^bits parts inside it."""

    def merge(table):
        import pyarrow as pa

        _, _, every, rest, deleted = _summed(table)
        return pa.Table.from_batches([_asked(table.column("of")[0].as_py(), table.column("part")[0].as_py(), bits, every, rest, deleted)])

    def spread(left, right):
        import numpy as np
        import pyarrow as pa

        sizes, place, *_ = _summed(left)
        order = np.argsort(right.column("part").to_numpy())
        found = []
        for name in ("rest", "deleted"):
            blobs = right.column(name).to_pylist()
            found.append(np.concatenate([_unpack(blobs[i], np.int64) for i in order]))
        return _answers(left, place, sizes, *found)

    asked = materialize(asked.withColumn("of", F.pmod(F.xxhash64("who"), F.lit(groups))), "lm-asked")
    fine = materialize(answer(asked.groupBy("of", "part").applyInArrow(merge, ASK)), "lm-merged")
    inside = fine.where("who >= 0").select(F.col("who").alias("of"), "part", "rest", "deleted", F.shiftright("part", bits).alias("coarse"))
    back = asked.groupBy("of", "part").cogroup(inside.groupBy("of", "coarse")).applyInArrow(spread, ANSWER)
    return back.unionByName(fine.where("who < 0"))


def _looked_up(row, answers):
    """Of a block: starts of documents, and for each token (rest, deleted) counts of the pair, its context and itself."""
    import numpy as np

    tokens, before, starts = _tokens(_texts(row))
    one, two = _keys(tokens, before)
    every, place = np.unique(np.concatenate((one, two)), return_inverse=True)
    order = np.argsort(answers.column("part").to_numpy())
    out = []
    for name in ("rest", "deleted"):
        blobs = answers.column(name).to_pylist()
        counts = np.concatenate([_unpack(blobs[i], np.int64) for i in order])
        word, pair = counts[place[: len(tokens)]], counts[place[len(tokens) :]]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        # A text's start was seen as often as its end; a block's documents all have an end.
        context[starts] = word[np.append(starts[1:], len(tokens)) - 1]
        out.append((pair, context, word))
    return starts, out[0], out[1]


def _bucket(context):
    import numpy as np

    return np.where(context > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1), 0)


def deleted_bins(blocks: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """Tokens of the deleted documents by bucket and by the binned ratios of the pair's and the word's estimates to the floor."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        _, (pair, context, word), _ = _looked_up(left, right)
        none = -(1 << 20)

        def binned(p):
            return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) * (v + 1))), none).astype(np.int64)

        rows = np.stack([_bucket(context), binned(pair / np.maximum(context, 1)), binned(word / max(n, 1))], axis=1)
        rows, counts = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(rows[:, 0], pa.int32()), "r2": pa.array(rows[:, 1], pa.int32()), "r1": pa.array(rows[:, 2], pa.int32()), "n": pa.array(counts, pa.int64())})

    own = answers.join(blocks.where("deleted").select(F.col("block").alias("b")), F.col("who") == F.col("b"), "left_semi")
    bins = blocks.where("deleted").select("block", "n_bytes", "sizes", "texts").groupBy("block").cogroup(own.groupBy("who")).applyInArrow(run, "bucket int, r2 int, r1 int, n long")
    return bins.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))


def learn(bins: list[tuple[int, int, int, int]]) -> list[tuple[float, float, float]]:
    """Mixture weights (pair, word, floor) of each bucket, by expectation-maximisation over the bins."""
    import numpy as np

    out = []
    rows = np.array(sorted(bins), dtype=np.int64).reshape(-1, 4)
    for b in range(BUCKETS):
        own = rows[rows[:, 0] == b]
        weights = np.array([0.0 if b == 0 else 0.4, 0.5, 0.1])
        weights /= weights.sum()
        if len(own):
            ratio = np.stack([np.where(own[:, k] > -(1 << 19), 2.0 ** (own[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.ones(len(own))], axis=1)
            for _ in range(ROUNDS):
                share = ratio * weights
                share /= share.sum(axis=1, keepdims=True)
                weights = (share * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
                weights = np.maximum(weights, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
                weights /= weights.sum()
        out.append(tuple(float(x) for x in weights))
    return out


def score(blocks: DataFrame, answers: DataFrame, weights: list, n: int, v: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        starts, rest, deleted = _looked_up(left, right)
        pair, context, word = (a + b for a, b in zip(rest, deleted, strict=True))
        mix = np.array(weights)[_bucket(context)]
        p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (word / max(n, 1)) + mix[:, 2] / (v + 1)
        lengths = np.diff(np.append(starts, len(word)))
        base = np.add.reduceat(np.log10((word + 1) / (n + 1 * (v + 1))), starts)
        return pa.table({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(), "held_out": pa.array(left.column("kinds").combine_chunks().flatten().to_numpy() == 2),
            "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(starts), n, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        })

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "n_bytes", "doc_ids", "kinds", "sizes", "texts").groupBy("block").cogroup(answers.groupBy("who")).applyInArrow(run, schema)


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """Scores of all docs; those whose fold is HELD_FOLD are not learned from."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kind = F.when(crc % FOLDS == HELD_FOLD, 2).when(F.floor(crc / FOLDS) % DELETED == 0, 1).otherwise(0)
    bounded_batches(docs.sparkSession)
    blocks = materialize(packed(docs.select("doc_id", "text", kind.alias("kind")), block_bytes), "lm-blocks")
    n_blocks, size = blocks.agg(F.count("*"), F.sum("n_bytes")).first()
    bits = max(0, math.ceil((size or 0) / part_bytes) - 1).bit_length()
    coarse = min(bits, fan.bit_length() - 1)
    asked = ask(blocks, coarse)
    answers = answer(asked) if coarse == bits else answer_merged(asked, math.ceil(n_blocks / fan), bits - coarse)
    answers = materialize(answers, "lm-counts")
    totals = answers.where("who = -1").agg(F.sum("n_rest"), F.sum("n_deleted"), F.sum("v_rest"), F.sum("v_all")).first()
    n_rest, n_deleted, v_rest, v_all = (int(x or 0) for x in totals)
    counts = answers.where("who >= 0").select("who", "part", "rest", "deleted")
    weights = learn([tuple(r) for r in deleted_bins(blocks, counts, n_rest, v_rest).collect()])
    return score(blocks, counts, weights, n_rest + n_deleted, v_all)


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
