"""Hierarchical packing into several context sizes, with next to no padding.

Each task packs what it reads, in windows of a bounded number of tokens; nothing is shuffled. A document of the longest context
or more gives whole sequences of its own. What remains of each document goes to the smallest tier that holds it. Tiers are
packed from the longest down: a sequence opens with an item of its tier, its gap is filled by the longest shorter items that fit,
and what is left of the gap by the beginning of the longest item at hand, whose rest goes back. A sequence is thus as long as
its tier; the last items of a window make sequences of falling powers of two. Sequences of one tier are dealt to step
groups of equal token count by falling attention cost, there and back, so that steps cost about the same.

Nulls: a null text is empty and gives only the end id; a null doc_id is passed on. Repeated rows are packed each. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from . import tokenizing
from .common import bounded_batches, read

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens packed at once by a task, and tokens of a step group.
WINDOW_TOKENS, STEP_TOKENS = 1 << 22, 1 << 17
SCHEMA = (
    "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
)


class Pool:
    """Items by length; the longest one of at most a given length is found through one integer of bits."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.bits = 0

    def add(self, length: int, item) -> None:
        self.by_length.setdefault(length, []).append(item)
        self.bits |= 1 << length

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(self, length: int):
        items = self.by_length[length]
        item = items.pop()
        if not items:
            self.bits ^= 1 << length
        return item


def pack_window(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tier, pieces); a piece is (document, start, length). All sequences are full."""
    longest, pool, out = tiers[0], Pool(), []
    for k, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [(k, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pool.add(n - whole, (k, whole))

    def fill(size: int) -> None:
        pieces, gap = [], size
        while gap:
            n = pool.longest(gap)
            if n < gap and n <= gap // 8:  # nothing near the gap: short items are kept, a long one is begun
                n = pool.longest(longest)
            k, at = pool.take(n)
            if n > gap:
                pool.add(n - gap, (k, at + gap))
                n = gap
            pieces.append((k, at, n))
            gap -= n
        out.append((size, pieces))

    left = sum(n % longest for n in lengths)
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while left >= tier and pool.longest(tier) > shorter:
            fill(tier)
            left -= tier
    for size in (1 << b for b in range(longest.bit_length() - 1, -1, -1)):
        while left >= size:
            fill(size)
            left -= size
    return out


def step_groups(sequences: list[tuple[int, list]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """For each sequence the number of its step group: groups hold one tier, are equally large and cost about the same."""
    groups, base = [0] * len(sequences), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(sequences):
        by_tier.setdefault(tier, []).append(i)
    for tier in sorted(by_tier, reverse=True):
        cost = {i: sum(n * n for _, _, n in sequences[i][1]) for i in by_tier[tier]}
        many = -(-len(cost) * tier // step_tokens)
        for at, i in enumerate(sorted(cost, key=lambda i: (-cost[i], i))):
            turn, place = divmod(at, many)
            groups[i] = base + (place if turn % 2 == 0 else many - 1 - place)
        base += many
    return groups


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """A row for each piece: where it stands in its document and in its sequence, and the CRC-32 of its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, next_sequence, next_group = TaskContext.get().partitionId(), 0, 0
        doc_type = None

        def flush(ids: list, blobs: list):
            nonlocal next_sequence, next_group
            sequences = pack_window([len(b) // 4 for b in blobs], tiers)
            groups, rows = step_groups(sequences), []
            for (tier, pieces), group in zip(sequences, groups, strict=True):
                offset = 0
                for k, at, n in pieces:
                    crc = zlib.crc32(memoryview(blobs[k])[4 * at : 4 * (at + n)])
                    rows.append((ids[k], at, n, crc, len(blobs[k]) // 4, task << 33 | next_sequence, offset, tier, task << 33 | next_group + group))
                    offset += n
                next_sequence += 1
            next_group += max(groups, default=-1) + 1
            columns = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        ids, blobs, held = [], [], 0
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            found = tokenizing.token_ids(tokenizer_path, [t or "" for t in batch.column("text").to_pylist()])
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids.append(doc_id)
                blobs.append(blob := own + end)
                held += len(blob) // 4
                if held >= window_tokens:
                    yield from flush(ids, blobs)
                    ids, blobs, held = [], [], 0
        if ids:
            yield from flush(ids, blobs)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
