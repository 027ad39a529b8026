"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, against brute-force versions."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wareflow.llm import chat_format, language_id, language_model, mixing, nearest, packing, quality_rules, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, spans string, row int, size int, fp long, key int"


def rng_words(n, seed, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "b", 4), (4, "One two, three.", "en", None, 15), (4, "One two, three.", "en", None, 15), (None, "no id here", "fr", "b", 10),
    (5, " ".join(rng_words(3000, 1)), "en", "a", 1), (6, " ".join(rng_words(60, 2)), "de", "a", 1), (7, "x" * 70000, "de", "c", 1), (8, "été über straße 日本 😀" * 20, "fr", "c", 1),
    (9, " ".join(rng_words(20, 9) + rng_words(60, 2) + rng_words(30, 10)), None, "b", 1), (10, " ".join(rng_words(80, 2)[:55] * 2), "en", "b", 1), (11, "a\na\n\na b\na b", "en", "", 1), (5, "same id, other text " * 20, "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "t", "s", 1, 2, 3, 4) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(docs, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(docs).collect()}
    want = set()
    for d, t, *_ in ROWS:
        w = split(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)))
    assert got == want
    assert quality_rules.ledger(none).count() == 0 and quality_rules.ablations(quality_rules.ledger(none)).first().n_failed == 0
    kept = quality_rules.reject(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.ledger(docs).where(quality_rules.kept()).count()
    only = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(quality_rules.ledger(docs), "base").collect()}
    assert set(only) == {"too_few_words", "repeated_trigrams"} and all(a >= b for a, b in only.values())


def test_tokens_and_packing(docs, none):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        want = sorted(((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ROWS), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()), key=str) == want
        assert token_counts.token_counts(none, path).count() == 0
    pieces = packing.pack(docs, path, window_tokens=5000).collect()
    assert sum(p.length for p in pieces) == sum(n + 1 for *_, n in want)
    by_sequence = {}
    for p in pieces:
        by_sequence[p.sequence_id] = by_sequence.get(p.sequence_id, 0) + p.length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in by_sequence.values())
    assert packing.pack(none, path).count() == 0
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, model).collect()} == {(d, len(sp.encode(t or ""))) for d, t, *_ in ROWS}


def test_a_word_is_encoded_once_whatever_white_space_is_before_it():
    import random

    import public_tokenizers

    from wareflow.llm import tokenizing

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokenizing.PieceEncoder(path, False)
    seen, fresh = [], encoder.fresh
    encoder.fresh = lambda pieces: seen.extend(pieces) or fresh(pieces)
    encoder.values(["stone Stone\nstone\tstone, (stone) stone...", "\n\nstone . stone!"])
    assert sorted(seen) == sorted(["(stone)", ",", ".", "...", "Stone", "stone", "!"])

    rng = random.Random(4)
    alphabet = [*"abXsStdéİßΣσςǅ  \t\n\x1c\xa0\u2028.,;:!?-'’\"()<|>_#$09٣²½中の\u0301\u0307\u200bﬁ\u212a", "'s", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "İ,", "A.B.", "x2y,"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in tokenizing.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        got = tokenizing.token_ids(path, texts)
        assert [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in got] == want
        assert tokenizing.count_tokens(path, texts) == [len(ids) for ids in want]


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    from wareflow.llm import tokenizing

    source = public_tokenizers.path("byte_bpe_50k.json")
    assert tokenizing.may_cut(source) and tokenizing.may_cut(public_tokenizers.path("word_bpe_49k.json"))
    odd = Tokenizer.from_file(source)
    odd.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # tokens may hold spaces
    path = str(tmp_path / "odd.json")
    odd.save(path)
    texts = [t or "" for _, t, *_ in ROWS]
    assert not tokenizing.may_cut(path)
    assert tokenizing.count_tokens(path, texts) == [len(odd.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [len(b) // 4 for b in tokenizing.token_ids(path, texts)] == tokenizing.count_tokens(path, texts)


def brute_model(rows, k=60):
    """Scores by counting in dictionaries, with expectation-maximisation written out token by token."""
    from wareflow.llm.language_model import BUCKETS, DELETED, STEPS

    crc = {d: binascii.crc32(str(d).encode() if d is not None else b"") for d, *_ in rows}
    tokens = [(d, [*(w.lower() for w in split(t)), "</s>"]) for d, t, *_ in rows]

    def counts(parts):
        one, two = Counter(), Counter()
        for ws in parts:
            one.update(ws)
            two.update(zip(["<s>", *ws], ws))
        return one | Counter({"<s>": one["</s>"]}), two, sum(one.values()), len(one)

    def bucket(n):
        return min(BUCKETS - 1, n.bit_length()) if n else 0

    train = [(d, ws) for d, ws in tokens if crc[d] % 7 != 2]
    one, two, n, v = counts(ws for d, ws in train if crc[d] // 7 % DELETED)
    seen = {}
    for d, ws in train:
        if crc[d] // 7 % DELETED == 0:
            for a, w in zip(["<s>", *ws], ws):
                octave = lambda p: 2 ** (round(STEPS * math.log2(p * (v + 1))) / STEPS) if p else 0.0
                seen.setdefault(bucket(one[a]), []).append((octave(two[a, w] / max(one[a], 1)), octave(one[w] / max(n, 1)), 1.0))
    weights = {}
    for b in range(BUCKETS):
        lam = [0.0, 5 / 6, 1 / 6] if b == 0 else [0.4, 0.5, 0.1]
        for _ in range(k if b in seen else 0):
            total = [0.0] * 3
            for r in seen[b]:
                z = sum(x * y for x, y in zip(r, lam))
                total = [t + x * y / z for t, x, y in zip(total, r, lam)]
            lam = [max(t / len(seen[b]), 0.0 if b == 0 and i == 0 else 1e-6) for i, t in enumerate(total)]
            lam = [x / sum(lam) for x in lam]
        weights[b] = lam
    one, two, n, v = counts(ws for _, ws in train)
    out = []
    for d, ws in tokens:
        own = 0.0
        for a, w in zip(["<s>", *ws], ws):
            x, y, z = weights[bucket(one[a])]
            own += math.log10(x * two[a, w] / max(one[a], 1) + y * one[w] / n + z / (v + 1))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        out.append((d, crc[d] % 7 == 2, len(ws), sum(one[w] > 0 for w in ws), n, round(base, 6), round(own, 5)))
    return sorted(out, key=str)


LM_ROWS = [*ROWS, *((100 + i, " ".join(rng_words(random.Random(i).randrange(5, 400), i, 60 + i))) for i in range(80))]


def test_language_model(spark, docs, none):
    want = brute_model(LM_ROWS)
    df = spark.createDataFrame([r[:2] for r in LM_ROWS], "doc_id long, text string").repartition(3)
    score = lambda **k: sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in language_model.lm_scores(df, **k).collect()), key=str)
    assert score() == want
    assert score(block_bytes=9000, part_bytes=4000) == want
    assert score(block_bytes=5000, part_bytes=2000, fan=4) == want  # blocks are merged before they ask
    assert language_model.lm_scores(docs).count() == len(ROWS)
    assert language_model.lm_scores(none).count() == 0


def test_counts_beyond_32_bits(spark):
    keys, big = np.array([3, 9 << 40], dtype=np.uint64), np.array([2**32 + 5, 7], dtype=np.int64)
    assert language_model._unpack(language_model._pack(big), np.int64).tolist() == big.tolist()
    rows = language_model._asked(1, 1, 0, keys, big, big * 0).to_pylist()
    asked = spark.createDataFrame([{**r, "who": who} for r in rows for who in (1, 2)], language_model.ASK)
    got = {r.who: r for r in language_model.answer(asked).collect()}
    assert language_model._unpack(bytes(got[2].rest), np.int64).tolist() == [2 * (2**32 + 5), 14] and got[-1].n_rest == 2 * (2**32 + 5)


def test_rows_of_the_exchange_grow_with_the_input(spark):
    text = " ".join(rng_words(3000, 4, 3000))
    blocks = language_model.packed(spark.range(64).selectExpr("id AS doc_id", "0 AS kind", f"'{text}' AS text").coalesce(1), 10000)
    n = blocks.count()
    assert n == 8 and language_model.ask(blocks, 3).count() == 8 * n


def test_mixture_weights_follow_the_counts():
    bins = [(1, 40, 20, 900), (1, -(1 << 20), 20, 100)]
    pair, word, floor = language_model.learn(bins)[1]
    assert pair > 0.85 and word > floor
    assert language_model.learn([])[0][0] == 0.0


def test_language_id(spark, docs, none):
    own = docs.select("doc_id", "text", "lang", F.lit(False).alias("held_out"))
    learned = language_id.prototypes(own.where("lang IS NOT NULL"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(own, learned).collect()]
    assert len(got) == len(ROWS) and all(0 <= s <= 1 for *_, s in got)
    assert {p for d, p, _ in got if d in (1, 2, 3)} == {"und"}
    assert {p for *_, p, _ in [(0, "und", 0)]} == {"und"}
    assert all(r.lang_pred == "und" for r in language_id.identify(own, {}).collect())
    assert language_id.identify(none.select("doc_id", "text", F.lit(True).alias("held_out")), learned).count() == 0


def test_language_id_against_brute_force(spark):
    """Hypervectors written out letter by letter, with the library's random letters only."""
    dimension, r = 256, random.Random(4)
    plain, _, _ = language_id.letter_vectors(dimension)
    alphabets = {"en": "abcdefgh", "fr": "aéèçdefo", "ja": "日本語文字漢"}
    rows = [(i, " ".join("".join(r.choices(a, k=r.randrange(1, 7))) for _ in range(20)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 8)]
    rows += [(90, "12 34!", "en"), (91, None, "fr"), (92, "ab", None), (93, "Éa-b  c", None)]

    def vector(text):
        total, runs = np.zeros(dimension, dtype=np.int64), re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
        for t in (runs[i : i + 3] for i in range(len(runs) - 2)):
            symbols = [0 if c == " " else int(language_id.symbol_table()[ord(c)]) for c in t]
            total += np.roll(plain[symbols[0]], 2).astype(np.int64) * np.roll(plain[symbols[1]], 1) * plain[symbols[2]]
        return total

    sums = {lang: sum((vector(t) for _, t, x in rows[:24] if x == lang), np.zeros(dimension, dtype=np.int64)) for lang in alphabets}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    learned = language_id.prototypes(df.where("doc_id < 24"), dimension)
    assert {k: list(v) for k, v in learned.items()} == {k: v.tolist() for k, v in sums.items()}
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(df, learned, dimension).collect()}
    for d, t, _ in rows:
        v = vector(t)
        if not re.search(r"[^\W\d_]", t or ""):
            assert got[d] == ("und", 0.0)
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in sums.items()}
        assert got[d][0] == max(sorted(cosine), key=cosine.get) and abs(got[d][1] - min(1.0, max(0.0, max(cosine.values())))) < 1e-6


def test_language_id_held_out_accuracy(spark):
    rows = language_id.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def brute_substring(rows):
    seen = {}
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w, gone = split(t), set()
        for i in range(len(w) - 49):
            if d is not None and seen[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring(spark, docs, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(docs).collect()), key=str)
    assert got == brute_substring(ROWS)
    assert sum(n for *_, n, _ in got) > 0
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and {r.th for r in kept.collect()} == {"t"}
    assert substring_dedup.substring_digest(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0


def test_substring_of_shared_passages(spark):
    r = random.Random(3)
    passages = [[f"p{r.randrange(900)}" for _ in range(r.randrange(45, 140))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randrange(1, 4)):
            p = r.choice(passages)
            a = r.randrange(0, 20)
            w += [f"q{r.randrange(5000)}" for _ in range(r.randrange(0, 40))] + p[a:] + (["z"] * r.randrange(0, 70))
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_digest(df).collect()), key=str)
    assert got == brute_substring(rows)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 5
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert sum(len(split(r.text)) for r in copies.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken, r.position is None or round(r.position, 9)) for r in rs)
    assert key(rows) == key(again)


def test_positions_follow_the_schedule(spark):
    knots = ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))
    got = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 11)], "u double").select(mixing.position(knots, F.col("u")), "u").collect()
    for t, u in got:
        done = t * t * 2 if t <= 0.5 else 0.5 + 2 * (t - 0.5) - (t - 0.5) ** 2
        assert abs(done - u * mixing.area(knots)) < 1e-9


CHAT = [
    (1, 0, "user", "hi & <|user|> </s>"), (1, 1, "assistant", "ok &lt;"), (1, 2, "assistant", "more"), (1, 3, "user", None), (2, 1, "assistant", ""), (2, 0, None, "x"), (3, 0, "a|>b", "<s>"), (3, 0, "a|>b", "<s>"),
    (None, 5, "user", "n"), (None, None, "assistant", "first"), (4, 0, "user", "<|next|>"), (4, 0, "assistant", "tie"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "f") for r in CHAT], "conv_id long, turn long, role string, text string, segments int, formatted string")
    out = chat_format.format_conversations(df)
    turns = chat_format.parse(F.col("formatted"))
    back = {r.conv_id: ([tuple(x) for x in r.t], r.loss, r.formatted, r.segments) for r in out.select("conv_id", turns.alias("t"), chat_format.loss_text(turns).alias("loss"), "formatted", "segments").collect()}
    for conv in {r[0] for r in CHAT}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in CHAT if c == conv))
        assert back[conv][0] == [(role, text) for _, role, text in turns]
        assert back[conv][1] == "".join(text for _, role, text in turns if role == "assistant")
        masked = "".join(s.text for s in back[conv][3] if s.loss)
        assert masked.replace("&lt;", "<").replace("&amp;", "&") == back[conv][1] and "".join(s.text for s in back[conv][3]) == back[conv][2]
    assert back[1][2].count("<|assistant|>") == 1  # adjacent turns of one role are one block
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_round_trip_of_random_strings(spark):
    """Roles and texts made of the template's own characters read back exactly."""
    r, bits = random.Random(8), ["<", ">", "|", "/", "s", "&", "lt;", "gt;", "amp;", "<s>", "</s>", "<|", "|>", "<|next|>", "x", "\n", ""]
    rows = [(c, t, "".join(r.choices(bits, k=r.randrange(4))) if r.random() < 0.6 else "assistant", "".join(r.choices(bits, k=r.randrange(9)))) for c in range(150) for t in range(r.randrange(1, 7))]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = chat_format.parse(F.col("formatted"))
    for x in out.select("conv_id", turns.alias("t"), chat_format.loss_text(turns).alias("loss")).collect():
        own = [(role, text) for c, _, role, text in rows if c == x.conv_id]
        assert [tuple(t) for t in x.t] == own and x.loss == "".join(text for role, text in own if role == "assistant")


def brute_nearest(rows, queries, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if q in queries:
            d = sorted((math.dist(v, w), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, round(s, 9)) for s, i in d[:k]]
    return out


def test_nearest(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # many copies of one vector
    rows += [(400, None), (500, []), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, [None] * 8), (None, rows[1][1]), (900, [1.0, 2.0]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, v array<float>, rep int")
    queries = {0, 100, 200, 1000, 900}
    got = {}
    for x in nearest.nearest(df, F.col("vec_id").isin(*queries), 10).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.score, 9)))
    want = brute_nearest(rows, queries, 10)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0
