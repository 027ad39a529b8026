import hashlib
import zlib

import numpy as np
import pytest

from wareflow.llm.common import read

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), []
    from wareflow.sources.storage import materialize

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), f"test-{k}")
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in read(spark, SF, "documents").collect()], *out]


def test_columns(stages):
    for rows in stages[1:5]:
        assert list(rows[0]) == list(stages[0][0])


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1]}
    good = {r.doc_id for r in read(spark, SF, "labels").collect() if r.quality == 1}
    long_enough = {r["doc_id"] for r in stages[0] if len(words(r["text"])) >= 50}
    assert good & long_enough <= kept
    assert not kept & {r.doc_id for r in read(spark, SF, "labels").collect() if r.quality == 0}


def test_near_duplicates_leave_no_close_pair(stages):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    before, after = stages[1], stages[2]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    texts = [r["text"] for r in after]
    assert len(set(texts)) == len(texts)
    dropped = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    for d in dropped:  # every one that went is close to another
        best = max(len(sets[d] & s) / max(1, len(sets[d] | s)) for i, s in sets.items() if i != d)
        assert best >= 0.5


def test_repeated_passages_go(stages):
    before, after = sorted(stages[2], key=lambda r: r["doc_id"]), {r["doc_id"]: r["text"] for r in stages[3]}
    seen, expected = {}, {}
    for r in before:
        w = words(r["text"])
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), r["doc_id"])
    for r in before:
        w = words(r["text"])
        gone = set()
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] < r["doc_id"]:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        if kept or not w:
            expected[r["doc_id"]] = kept
    assert {k: words(v) for k, v in after.items()} == expected


def test_mix_reaches_targets(stages):
    before, after = stages[3], stages[4]
    size, got = {}, {}
    for r in before:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    for r in after:
        got[r["source"]] = got.get(r["source"], 0) + len(words(r["text"]))
    left = 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    target, open_ = {}, set(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    assert all(abs(got.get(s, 0) - target[s]) <= 1 for s in size)


def test_packing_holds_every_id_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    copies = {}
    for r in stages[4]:
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        copies.setdefault((r["doc_id"], len(ids)), []).append(ids)
    lengths, per_doc = {}, {}
    for p in stages[5]:
        lengths.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        per_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    for pieces in lengths.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert set(per_doc) == set(copies)
    for key, pieces in per_doc.items():
        assert sum(n for _, n, _ in pieces) == sum(map(len, copies[key]))
        crcs = {(s, n, zlib.crc32(ids[s : s + n].tobytes())) for ids in copies[key] for s, n, _ in pieces}
        assert all(p in crcs for p in pieces)


def test_stages_on_nulls_repeats_and_nothing(spark):
    """All stages in a row on a table with nulls, repeated rows, a long text and extra columns; then on an empty one."""
    text = lambda k, n=90: " ".join(f"word{(k * 7919 + i * 31) % 400009}" for i in range(n))
    rows = [(1, text(1), "en", "a", 9), (1, text(1), "en", "a", 9), (2, None, "en", "a", 0), (3, "", None, "b", 0), (None, text(4), "en", None, 9), (5, text(5), "de", None, 9), (6, text(6, 60000), "en", "b", 9), (7, text(1), "en", "c", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from wareflow.sources.storage import materialize

    for some in (rows, []):
        docs = spark.createDataFrame([(*r, "t", 1) for r in some], schema + ", th string, row int")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialize(stage(spark, docs, SF), f"edge-{k}")
            if k < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "th", "row"]
            if k == 1:
                assert sorted((str(r.doc_id) for r in docs.collect())) == (["1", "5", "6", "None"] if some else [])
        assert (docs.count() > 0) == bool(some)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
