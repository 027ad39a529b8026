"""Byte-level deduplication by prefix-free parsing, exact for strings of `window` bytes.

Parse: a text is cut behind every 16-byte gram whose rolling hash is 0 modulo 128 (a trigger), so equal stretches are cut alike. A phrase
is a stretch of places between two triggers together with the bytes a string of 50 that starts there can reach: the phrase and the head of
the parse's suffix behind it. Equal phrases have equal sets of 50-byte strings, so the corpus's repetitions fall together here: each phrase
belongs to its document of least id, and in all other documents all strings that start in it repeat.

Dictionary: what is left, each different phrase in its least document. Its suffixes are needed only where two documents can agree for 50
bytes. The least hash of the 27 grams of 24 bytes in a string tells: equal strings have
equal ones, and one that a single document has rules its suffixes out.

Suffix order: each block sorts the suffixes that are left by their first 50 bytes and takes neighbours that agree so far as one, with the
least document; the blocks' orders are merged by the strings' hash, which gives each suffix the least document that holds it. The order
of all suffixes is not built in one piece, since that would ship each suffix of the dictionary (over 14 bytes for each byte of text).

Texts are packed into compressed blocks of about 1 MB once; longer texts are dealt into pieces that overlap by 49 bytes on both sides. Blocks
exchange arrays of keys, cut into buckets by hash, and get one bit back for each, so a key of many documents comes once from each block, whatever
its documents. Hashes of phrases and strings have 80 bits and the bucket; those of grams 32 bits and the bucket, where a collision only
lets a suffix through to the sort. Rows of an exchange number blocks times buckets (one for each 32 MB) but never more than the keys.

Nulls: a null text has no bytes; a row with a null doc_id is neither smaller nor larger than any and stays whole. Rows of one id do not count as
repeats of each other. An empty table gives no rows. doc_id is a whole number; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, read

WINDOW, SEED_BYTES, TRIGGER_BYTES, TRIGGER_PERIOD = 50, 24, 16, 128
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 1 << 25, 32
#: Odd multipliers of the two rolling hashes and of the final mix.
BASES, MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 0xBF58476D1CE4E5B9
BLOCK = "block long, piece int, n_pieces int, before int, take long, ids binary, known binary, sizes binary, blob binary"


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of each base and of its inverse modulo 2^64, as many as the longest array so far needed."""

    def __init__(self):
        self.size, self.rows = 0, []

    def upto(self, size: int) -> list:
        import numpy as np

        if size > self.size:
            self.size, self.rows = -(-size // (1 << 17)) << 17, []
            for base in BASES:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    row = np.full(self.size, b, dtype=np.uint64)
                    row[0] = 1
                    pair.append(np.multiply.accumulate(row))
                self.rows.append(pair)
        return self.rows


_powers = _Powers()


class Rolling:
    """Hashes of any stretches of one array of bytes, in two independent bases."""

    def __init__(self, text):
        import numpy as np

        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))[text]
        self.sums, self.inverse = [], []
        for up, down in _powers.upto(len(text) + 1):
            sums = np.zeros(len(text) + 1, dtype=np.uint64)
            np.cumsum(letters * up[: len(text)], out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(down)

    def of(self, which: int, start, length):
        """Hashes of the stretches that begin at the given places."""
        sums = self.sums[which]
        return mixed((sums[start + length] - sums[start]) * self.inverse[which][start])

    def grams(self, length: int):
        """Hashes of all stretches of one length."""
        sums = self.sums[0]
        return mixed((sums[length:] - sums[:-length]) * self.inverse[0][: len(sums) - length])


def least_of(hashes, span: int):
    """The least of every `span` successive hashes, by doubling."""
    import numpy as np

    least, length = hashes, 1
    while length < span:
        step = min(length, span - length)
        least = np.minimum(least[:-step], least[step:])
        length += step
    return least


def grouped(*keys):
    """Order of the rows by the keys, and which of them begin a group of equals."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    new[:1] = True
    return order, new


def suffix_order(columns: list):
    """Order of suffixes by their columns, and which of them differ from the one before: each column sorts only what those before left tied."""
    import numpy as np

    order = np.argsort(columns[0], kind="stable")
    ranked = columns[0][order]
    new = np.concatenate((np.ones(min(1, len(order)), dtype=bool), ranked[1:] != ranked[:-1]))
    for column in columns[1:]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else order
        if not len(tied):
            break
        rows, of = order[tied], group[tied]
        order[tied] = rows[np.lexsort((column[rows], of))]
        ranked = column[order[tied]]
        new[tied[1:]] |= (ranked[1:] != ranked[:-1]) & (of[1:] == of[:-1])
    return order, new


def bits(parts: list | None, counts) -> object:
    """Verdicts of all entries of a block from (bucket, bits) of its rows; none were asked for if there are no entries."""
    import numpy as np

    found = sorted((p["bucket"], p["bits"]) for p in parts or [])
    return np.concatenate([np.zeros(0, dtype=bool), *(np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).view(bool) for (_, b), n in zip(found, counts, strict=True))])


class Block:
    """Texts of a block (or a piece of one long text), and what its three exchanges ask and learn."""

    def __init__(self, row: dict, buckets: int, window: int):
        import numpy as np
        import zstandard

        self.row, self.buckets, self.window = row, buckets, window
        self.ids, self.known = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=bool)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), dtype=np.uint8)
        self.end = np.cumsum(self.sizes)
        self.rolling = Rolling(self.text)
        self.repeated = np.zeros(len(self.text) + 1, dtype=np.int64)

    def docs_of(self, places):
        import numpy as np

        return np.repeat(np.arange(len(self.sizes)), self.sizes)[places] if len(places) > len(self.text) // 8 else np.searchsorted(self.end, places, side="right")

    def _entries(self, hi, low, ids):
        """Keys of the block, each once with its least id: place of its first row, its group of each row, its bucket, bounds of the buckets."""
        import numpy as np

        bucket = (hi >> np.uint64(32)) % np.uint64(self.buckets)
        order, new = grouped(bucket, hi, low)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        at = order[new]
        bounds = np.flatnonzero(np.concatenate(([True], bucket[at][1:] != bucket[at][:-1], [True]))) if len(at) else np.zeros(1, dtype=np.int64)
        return at, group, least, bucket[at], bounds

    def phrases(self):
        """The parse: first and last + 1 place of each phrase's strings. Its keys are self.asked."""
        import numpy as np

        n = len(self.text)
        last = self.end - self.window  # where the last string of each text starts
        begins = (self.end - self.sizes)[self.known & (self.sizes >= self.window)]
        cuts = np.zeros(0, dtype=np.int64)
        if n >= TRIGGER_BYTES:
            cuts = np.flatnonzero(self.rolling.grams(TRIGGER_BYTES) % np.uint64(TRIGGER_PERIOD) == 0) + 1
            cuts = cuts[cuts < n]
            doc = self.docs_of(cuts)
            cuts = cuts[self.known[doc] & (cuts <= last[doc])]
        first = np.unique(np.concatenate((begins, cuts)))
        doc = self.docs_of(first)
        stop = np.minimum(np.append(first[1:], n), last[doc] + 1)
        length = stop - first + self.window - 1
        hi, low = self.rolling.of(0, first, length), (self.rolling.of(1, first, length) + length.astype(np.uint64)).astype(np.uint16)
        self.first, self.stop, self.phrase_ids = first, stop, self.ids[doc]
        self.asked = (hi, low, *self._entries(hi, low, self.phrase_ids))
        return self

    def learn_phrases(self, parts):
        """Strings that start in a phrase of a smaller document repeat; the other phrases are the dictionary."""
        import numpy as np

        _, _, _, group, least, _, bounds = self.asked
        late = bits(parts, np.diff(bounds))[group] | (self.phrase_ids > least[group])
        np.add.at(self.repeated, self.first[late], 1)
        np.add.at(self.repeated, self.stop[late] + self.window - 1, -1)
        inside = np.zeros(len(self.text) + 1, dtype=np.int8)
        np.add.at(inside, self.first[~late], 1)
        np.add.at(inside, self.stop[~late], -1)
        self.places = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        return self

    def grams(self):
        """The gram that each string of the dictionary chooses: 32 bits of its hash, and whether several documents of the block have it."""
        import numpy as np

        if not len(self.places):
            self.gram_group = np.zeros(0, dtype=np.int64)
            self.asked = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64))
            return self
        chosen = least_of(self.rolling.grams(SEED_BYTES), self.window - SEED_BYTES + 1)[self.places]
        doc = self.docs_of(self.places)
        new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
        keys, ids = chosen[new], self.ids[doc[new]]
        order, fresh = grouped((keys >> np.uint64(32)) % np.uint64(self.buckets), keys & np.uint64(0xFFFFFFFF))
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        several = np.minimum.reduceat(ids[order], starts) < np.maximum.reduceat(ids[order], starts)
        bucket = (keys[order[starts]] >> np.uint64(32)) % np.uint64(self.buckets)
        self.gram_group = group[np.cumsum(new) - 1]
        bounds = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        self.asked = (keys[order[starts]].astype(np.uint32), several, bucket, bounds)
        return self

    def learn_grams(self, parts):
        """Suffixes whose gram no other document has fall out."""
        import numpy as np

        self.places = self.places[bits(parts, np.diff(self.asked[-1]))[self.gram_group]]
        return self

    def suffixes(self):
        """The suffixes that are left in the order of their first bytes; neighbours that agree for the whole window are one."""
        import numpy as np

        at = self.places
        words = -(-self.window // 8)
        padded = np.concatenate((self.text, np.zeros(8 * words, dtype=np.uint8)))
        columns = []
        for k in range(words):  # eight bytes at a time, as numbers that sort like the bytes
            part = np.lib.stride_tricks.sliding_window_view(padded, 8)[at + 8 * k].copy()
            part[:, max(0, min(8, self.window - 8 * k)) :] = 0
            columns.append(part.view(">u8").ravel().astype(np.uint64))
        order, new = suffix_order(columns)
        heads = at[order[new]]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        ids = self.ids[self.docs_of(at)]
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        hi, low = self.rolling.of(0, heads, self.window), self.rolling.of(1, heads, self.window).astype(np.uint16)
        entry, to_entry, entry_least, bucket, bounds = self._entries(hi, low, least)
        self.suffix_ids = ids
        self.asked = (hi, low, entry, to_entry[group], entry_least, bucket, bounds)
        return self

    def learn_suffixes(self, parts):
        import numpy as np

        _, _, _, group, least, _, bounds = self.asked
        late = self.places[bits(parts, np.diff(bounds))[group] | (self.suffix_ids > least[group])]
        np.add.at(self.repeated, late, 1)
        np.add.at(self.repeated, late + self.window, -1)
        return self

    def results(self):
        """ids, known, sizes, spans and what is left of each text, or of the piece's own bytes."""
        import numpy as np

        gone = np.cumsum(self.repeated[:-1]) > 0
        before, take = self.row["before"], self.row["take"]
        for k, (end, size) in enumerate(zip(self.end.tolist(), self.sizes.tolist(), strict=True)):
            cut = slice(end - size + before, end - size + before + take) if self.row["n_pieces"] > 1 else slice(end - size, end)
            here = gone[cut]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], here.view(np.int8), [0]))))
            spans = [{"first": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            yield int(self.ids[k]) if self.known[k] else None, len(here), spans, self.text[cut][~here].tobytes()


def packed(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts of about block_bytes; a longer text is dealt into pieces that know window - 1 bytes on both sides."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        base, press, reach = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=6), window - 1
        shape = pa.schema([("block", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("before", pa.int32()), ("take", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "sizes", "blob"))])
        made = 0

        def block(rows, piece=0, n_pieces=1, before=0, take=0):
            nonlocal made
            made += 1
            ids = np.array([d if d is not None else 0 for d, _ in rows], dtype=np.int64).tobytes()
            known = np.array([d is not None for d, _ in rows], dtype=bool).tobytes()
            sizes = np.array([len(t) for _, t in rows], dtype=np.int64).tobytes()
            one = {"block": base + made, "piece": piece, "n_pieces": n_pieces, "before": before, "take": take, "ids": ids, "known": known, "sizes": sizes, "blob": press.compress(b"".join(t for _, t in rows))}
            return pa.RecordBatch.from_pylist([one], shape)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or b""
                if len(text) > block_bytes:
                    n_pieces = -(-len(text) // block_bytes)
                    for k in range(n_pieces):
                        a, b = k * block_bytes, min(len(text), (k + 1) * block_bytes)
                        yield block([(doc_id, text[max(0, a - reach) : b + reach])], k, n_pieces, min(a, reach), b - a)
                    continue
                rows.append((doc_id, text))
                held += len(text)
                if held >= block_bytes:
                    yield block(rows)
                    rows, held = [], 0
        if rows:
            yield block(rows)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCK)


def _learned(row: dict, buckets: int, window: int, rounds: int) -> Block:
    """A block after the first exchanges, worked out anew from its texts and the bits it got."""
    block = Block(row, buckets, window).phrases()
    if rounds > 0:
        block.learn_phrases(row["bits0"]).grams()
    if rounds > 1:
        block.learn_grams(row["bits1"]).suffixes()
    if rounds > 2:
        block.learn_suffixes(row["bits2"])
    return block


def _asked(blocks: DataFrame, known: list[DataFrame], buckets: int, window: int) -> DataFrame:
    """block, bucket, keys and the documents' ids (phrases, suffixes) or whether several have the key (grams)."""
    rounds = len(known)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                block = _learned(row, buckets, window, rounds)
                if rounds == 1:
                    keys, several, bucket, bounds = block.asked
                    parts = [(keys[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                else:
                    hi, low, at, _, least, bucket, bounds = block.asked
                    hi, low = hi[at], low[at]
                    if len(least) and 0 <= least.min() and least.max() < 1 << 32:
                        least = least.astype(np.uint32)
                    parts = [(hi[a:b].tobytes() + low[a:b].tobytes(), least[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(parts), pa.int64()), pa.array(bucket[bounds[:-1]].astype(np.int64)), pa.array([k for k, _ in parts], pa.binary()), pa.array([d for _, d in parts], pa.binary())],
                        ["block", "bucket", "keys", "docs"],
                    )

    return _with_bits(blocks, known).mapInArrow(run, "block long, bucket long, keys binary, docs binary")


def _with_bits(blocks: DataFrame, known: list[DataFrame]) -> DataFrame:
    """The blocks and the bits of the exchanges so far, one join for all of them."""
    if not known:
        return blocks
    every = known[0].withColumn("round", F.lit(0))
    for k, table in enumerate(known[1:], 1):
        every = every.unionByName(table.withColumn("round", F.lit(k)))
    lists = every.groupBy("block").agg(*(F.collect_list(F.when(F.col("round") == k, F.struct("bucket", "bits"))).alias(f"bits{k}") for k in range(len(known))))
    return blocks.join(lists, "block", "left")


def _answered(asked: DataFrame, grams: bool) -> DataFrame:
    """block, bucket, bits: whether a smaller document has the key (grams: whether another has)."""

    def answer(table):
        import numpy as np
        import pyarrow as pa

        width = 4 if grams else 10
        keys, docs = table.column("keys").to_pylist(), table.column("docs").to_pylist()
        counts = np.array([len(k) // width for k in keys])
        if grams:
            every = np.concatenate([np.frombuffer(k, dtype=np.uint32) for k in keys])
            several = np.concatenate([np.unpackbits(np.frombuffer(d, dtype=np.uint8), count=n).view(bool) for d, n in zip(docs, counts, strict=True)])
            order, new = grouped(every)
            starts = np.flatnonzero(new)
            shared = np.logical_or.reduceat(several[order], starts) | (np.diff(np.append(starts, len(order))) > 1)
            out = np.empty(len(order), dtype=bool)
            out[order] = shared[np.cumsum(new) - 1]
        else:
            hi = np.concatenate([np.frombuffer(k, dtype=np.uint64, count=n) for k, n in zip(keys, counts, strict=True)])
            low = np.concatenate([np.frombuffer(k, dtype=np.uint16, offset=8 * n) for k, n in zip(keys, counts, strict=True)])
            ids = np.concatenate([np.frombuffer(d, dtype=np.int64 if len(d) == 8 * n else np.uint32).astype(np.int64) for d, n in zip(docs, counts, strict=True)])
            order, new = grouped(hi, low)
            least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
            out = np.empty(len(order), dtype=bool)
            out[order] = ids[order] > least[np.cumsum(new) - 1]
        cut = np.cumsum(counts)[:-1]
        packed_bits = [np.packbits(part).tobytes() for part in np.split(out, cut)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(packed_bits, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary")


def _results(blocks: DataFrame, known: list[DataFrame], buckets: int, window: int) -> DataFrame:
    """text (a number), piece, doc_id, n_bytes, spans, kept of each text or piece of one."""
    rounds = len(known)

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, cut, kept = zip(*_learned(row, buckets, window, rounds).results(), strict=True)
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"] - row["piece"]] * m, pa.int64()), pa.array([row["piece"]] * m, pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, spans), pa.array(kept, pa.binary())],
                    ["text", "piece", "doc_id", "n_bytes", "spans", "kept"],
                )

    return _with_bits(blocks, known).mapInArrow(run, "text long, piece int, doc_id long, n_bytes long, spans array<struct<first: long, n: long>>, kept binary")


def _joined(pieces: DataFrame) -> DataFrame:
    """Long texts from their pieces: spans counted from the text's start, those that meet at a seam made one."""
    whole = pieces.groupBy("text").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("piece", "n_bytes", "spans", "kept"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first: long, n: long>>").alias("spans"))

    def add(done, piece):
        moved = F.transform(piece["spans"], lambda s: F.struct((s["first"] + done["at"]).alias("first"), s["n"].alias("n")))
        last, head = F.get(done["spans"], F.size(done["spans"]) - 1), F.get(moved, F.lit(0))
        seam = F.coalesce((last["first"] + last["n"] == done["at"]) & (head["first"] == done["at"]), F.lit(False))
        one = F.array(F.struct(last["first"].alias("first"), (last["n"] + head["n"]).alias("n")))
        spans = F.when(seam, F.concat(F.slice(done["spans"], 1, F.greatest(F.size(done["spans"]) - 1, F.lit(0))), one, F.filter(moved, lambda _, k: k > 0))).otherwise(F.concat(done["spans"], moved))
        return F.struct((done["at"] + piece["n_bytes"]).alias("at"), spans.alias("spans"))

    kept = F.aggregate("p", F.lit(b""), lambda done, piece: F.concat(done, piece["kept"]))
    return whole.select("doc_id", "n_bytes", F.aggregate("p", start, add)["spans"].alias("spans"), kept.alias("kept"))


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs as array<struct<first, n>>), kept (the remaining bytes) of every row."""
    if window < SEED_BYTES:
        raise ValueError(f"the window has at least {SEED_BYTES} bytes")
    blocks = materialize(packed(docs, window, block_bytes), "byte-blocks")
    total = blocks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 2 * total // BUCKET_BYTES)
    known: list[DataFrame] = []
    for name in ("phrases", "grams", "suffixes"):
        asked = _asked(blocks, known, buckets, window)
        known.append(materialize(_answered(asked, name == "grams"), f"byte-{name}"))
    one = _results(blocks.where("n_pieces = 1"), known, buckets, window).select("doc_id", "n_bytes", "spans", "kept")
    many = _joined(_results(blocks.where("n_pieces > 1"), known, buckets, window))
    return one.unionByName(many).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM p),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE doc_id > lo),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM late),
firsts AS (SELECT doc_id, i AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges WHERE before IS NULL OR i > before + 50),
lasts AS (SELECT doc_id, i + 50 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges WHERE after IS NULL OR after > i + 50),
spans AS (SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS kept_from FROM firsts JOIN lasts USING (doc_id, k)),
cut AS (
  SELECT doc_id, string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY k) AS head, sum(b - a) AS gone, count(*) AS n, max(b) AS tail
  FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
