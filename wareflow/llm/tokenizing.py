"""Exact token counts and ids from public tokenizer files, by batch encoding of distinct pieces.

Texts are cut where no token can span: between a character that is no white space and ASCII white space, and between a letter
or digit and one of `.,;:!?`. Byte-level and word pre-tokenizers both end a token there, whatever stands on either side, so
the pieces' tokens joined are the whole text's (U+0130 lower-cases to a letter and a mark, so a word with it is not cut from
its punctuation). Pieces repeat heavily; each distinct piece is encoded once per worker, in
batches of the library balanced by bytes, and kept in a dictionary of bounded size. Where the tokenizer drops white space, pieces are
kept without it, and words of ASCII letters go straight to the file's model. Texts that hold other white space (where a run of
spaces could be split wrongly) are encoded whole, or in long stretches cut only between a non-space and an ASCII space. All this holds for the
two ways of splitting in `SPLITS`; a tokenizer that splits in any other way gets whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct

ASCII_SPACE = " \\t\\n\\r\\f\\v"
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
PIECE = re.compile(rf"[{ASCII_SPACE}]*+[^\W_İ]++(?=[.,;:!?])|[{ASCII_SPACE}]*+[^{ASCII_SPACE}]++|[{ASCII_SPACE}]++")
SAFE_CUT = re.compile(rf"(?<=\S)[{ASCII_SPACE}]")
#: Punctuation behind a letter or digit; where white space is dropped, a space before it cuts there.
TRAILING = re.compile(r"[.,;:!?](?<=[^\W_İ].)")

#: The pre-tokenizer patterns (None: that of the byte level) whose tokens end at the cuts of PIECE and SAFE_CUT.
SPLITS = (None, "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")

#: Bytes of text handled at once, bytes of pieces joined for the library, entries of the dictionary, longest piece kept in it.
BATCH_BYTES, JOINED_BYTES, CACHE_PIECES, CACHE_LENGTH = 1 << 20, 1 << 14, 1_000_000, 32


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer, loaded once per worker; truncation and padding off, special strings as by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def may_cut(path: str) -> bool:
    """Whether the file's tokenizer splits texts in one of the ways for which the cuts are safe."""
    tok = json.loads(tokenizer(path).to_str())
    steps = tok["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    patterns = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split"] or [None]
    by_bytes = [s for s in steps if s.get("type") == "ByteLevel" and not s["add_prefix_space"]]
    kinds = {s.get("type") for s in steps} <= {"Split", "ByteLevel"}
    normalizers = (tok["normalizer"] or {"normalizers": []}).get("normalizers", [tok["normalizer"]])
    known = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in normalizers)
    splits_itself = patterns != [None] or any(s.get("use_regex") for s in by_bytes)
    return kinds and known and len(by_bytes) == 1 and len(patterns) == 1 and patterns[0] in SPLITS and splits_itself


def size_of(text: str) -> int:
    """Bytes of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def in_batches(pieces: list[str], limit: int):
    """The pieces in runs balanced by bytes."""
    batch, held = [], 0
    for piece in pieces:
        size = size_of(piece) + 16
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


def stretches(text: str, limit: int = BATCH_BYTES):
    """The text in stretches of about the limit, cut at safe boundaries only; a stretch is longer where there is none."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class PieceEncoder:
    """Ids, or their number, of each distinct piece, by the library's batch encoding."""

    def __init__(self, path: str, lengths: bool):
        self.tok, self.lengths, self.known = tokenizer(path), lengths, {}
        # Does the tokenizer drop white space between words? Then words may be joined by a space, else only words that begin with one.
        self.drops_space = not self.tok.encode(" ", add_special_tokens=False).ids
        # Words of ASCII letters are one token for the model as they stand, but for their case; no other step of the tokenizer touches them.
        steps = json.loads(self.tok.to_str())
        self.lowers = '"Lowercase"' in json.dumps(steps["normalizer"])
        self.by_model = self.drops_space and not any(t["content"].isalpha() for t in steps["added_tokens"])

    def value(self, ids):
        return len(ids) if self.lengths else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, pieces: list[str]) -> list:
        """Values of the pieces in order, each encoded by itself."""
        return [self.value(e.ids) for batch in in_batches(pieces, BATCH_BYTES) for e in self.tok.encode_batch_fast(batch, add_special_tokens=False)]

    def encode_joined(self, pieces: list[str]) -> list:
        """As encode, for pieces that stay apart in one string; the tokens' places in it tell the pieces apart."""
        import numpy as np

        gap = " " if self.drops_space else ""
        runs = list(in_batches(pieces, JOINED_BYTES))
        out = []
        for run, e in zip(runs, self.tok.encode_batch([gap.join(r) for r in runs], add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *(len(p) + len(gap) for p in run)])
            places = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids))
            cut = np.searchsorted(places, starts)
            if self.lengths:
                out += np.diff(cut).tolist()
            else:
                ids = np.array(e.ids, dtype="<u4").tobytes()
                out += [ids[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def stays_apart(self, piece: str) -> bool:
        return "<" not in piece and "\u0130" not in piece and (self.drops_space or (piece[0] == " " and len(piece) > 1 and piece[1] > " "))

    def fresh(self, pieces: list[str]) -> dict:
        """Values of pieces seen for the first time."""
        found = {}
        if self.by_model:
            split = self.tok.model.tokenize
            found = {p: self.value([t.id for t in split(p.lower() if self.lowers else p)]) for p in pieces if p.isascii() and p.isalpha()}
        joined = [p for p in pieces if p not in found and self.stays_apart(p)]
        found.update(zip(joined, self.encode_joined(joined), strict=True))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self.encode(rest), strict=True))
        return found

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without odd white space."""
        return TRAILING.sub(r" \g<0>", text).split() if self.drops_space else PIECE.findall(text)

    def values(self, texts: list[str]) -> list[list]:
        """Values of the pieces of each stretch of text, in order; what is new in any of them is encoded together."""
        known = self.known
        if len(known) > CACHE_PIECES:
            for p in list(itertools.islice(known, CACHE_PIECES // 2)):
                del known[p]
        out, gaps, fresh = [], [], {}
        for text in texts:
            if ODD_SPACE.search(text):
                out.append(self.encode([text]))
                continue
            pieces = self.cut(text)
            out.append(values := list(map(known.get, pieces)))
            if None in values:
                missing = [(at, pieces[at]) for at, value in enumerate(values) if value is None]
                gaps.append((values, missing))
                fresh.update(dict.fromkeys(p for _, p in missing))
        fresh = self.fresh(list(fresh))
        for values, missing in gaps:
            for at, p in missing:
                values[at] = fresh[p]
        known.update((p, value) for p, value in fresh.items() if len(p) <= CACHE_LENGTH)
        return out


@functools.cache
def length_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, True)


@functools.cache
def id_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, False)


@functools.cache
def pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def grouped(texts: list[str]):
    """Stretches of all texts in groups balanced by bytes: lists of (place of the text, stretch)."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for part in stretches(text):
            group.append((k, part))
            held += size_of(part)
            if held >= BATCH_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


def whole(path: str, texts: list[str]):
    """Ids of whole texts, in batches of the library balanced by bytes."""
    for batch in in_batches(texts, BATCH_BYTES):
        yield from (e.ids for e in tokenizer(path).encode_batch_fast(batch, add_special_tokens=False))


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of whole texts, as the library for the file gives them."""
    if path.endswith(".model"):  # its white space rules are not local, so whole texts only
        return [len(pieces_model(path).encode(t, num_threads=1)) for t in texts]
    if not may_cut(path):
        return [len(ids) for ids in whole(path, texts)]
    encoder, out = length_encoder(path), [0] * len(texts)
    for group in grouped(texts):
        for (k, _), values in zip(group, encoder.values([s for _, s in group]), strict=True):
            out[k] += sum(values)
    return out


def token_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""
    if path.endswith(".model"):
        import numpy as np

        return [np.array(pieces_model(path).encode(t, num_threads=1), dtype="<u4").tobytes() for t in texts]
    if not may_cut(path):
        import numpy as np

        return [np.array(ids, dtype="<u4").tobytes() for ids in whole(path, texts)]
    encoder, out = id_encoder(path), [[] for _ in texts]
    for group in grouped(texts):
        for (k, _), values in zip(group, encoder.values([s for _, s in group]), strict=True):
            out[k].append(b"".join(values))
    return [b"".join(x) for x in out]
