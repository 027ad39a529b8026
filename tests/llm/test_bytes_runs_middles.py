"""Byte-level deduplication, fill-in-the-middle and periodic runs against brute-force versions, on texts with all edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareflow.llm import fill_in_middle, periodic_runs, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, block long, piece int, n long, form string, runs string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), "All rights reserved; this line is in very many texts, more than fifty bytes of it."
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "One two, three."), (4, "One two, three."), (None, passage), (5, "x" * 9000), (6, "ab " * 900), (7, "x" * 60), (8, "été 日本 😀 straße " * 30), (9, "日本 😀 straße été " * 30)]
    out += [(20 + k, prose(20) + " " + passage + prose(k)) for k in range(6)]
    out += [(40 + k, prose(r.randrange(40)) + line + prose(r.randrange(40))) for k in range(60)]
    out += [(120 + k, out[12][1][: 200 + k] + "#" + out[12][1][200 + k :]) for k in range(5)]
    out += [(15, prose(700)), (16, prose(300) + out[-1][1][100:3000]), (16, prose(5) + passage), (12, "a b " * 40 + "c " + "a b " * 9 + "a"), (13, "a<P>b c"), (14, "< <S <M P>" * 3), (17, "  lead and  trail \n"), (18, "solid" * 3000), (19, prose(3) + "\n" * 5000 + prose(3))]
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3, "f", "r") for d, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_bytes(rows, window):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            if d is not None:
                least[b[i : i + window]] = min(least.get(b[i : i + window], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - window + 1):
            if d is not None and least[b[i : i + window]] < d:
                gone[i : i + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        spans = tuple((int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2]))
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block", [(50, 1 << 21), (50, 700), (24, 3000), (67, 4000)])
def test_bytes(docs, none, window, block):
    """Whole texts in one block, and texts dealt into pieces of a few hundred bytes."""
    got = suffix_dedup.without_repeated_bytes(docs, window, block).collect()
    assert sorted(((r.doc_id, r.n_bytes, tuple((s["first"], s["n"]) for s in r.spans), bytes(r.kept)) for r in got), key=str) == brute_bytes(ROWS, window)
    assert suffix_dedup.without_repeated_bytes(none, window, block).count() == 0


def test_hot_bytes(spark):
    """A third of the documents are copies, all hold one line: entries exchanged stay far below the copies' bytes."""
    r = random.Random(9)
    line = "a line of more than fifty bytes which stands in every single document of the table"
    copy = " ".join(str(r.random()) for _ in range(40))
    data = [(k, copy if k % 3 == 0 else f"{r.random()} {line} {r.random()}") for k in range(600)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, bytes(x.kept)) for x in suffix_dedup.without_repeated_bytes(table).collect()}
    want = {d: (n, kept) for d, n, _, kept in brute_bytes(data, 50)}
    assert got == want and got[3] == (len(copy), b"")


def brute_middle(d, t, rate, spm, seed):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return (d, len(w), "plain", None, None, t)
    if h4 % 100 < spm:
        return (d, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (d, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_middles(docs, none, chunk):
    made = fill_in_middle.fill_in_middle(docs, rate=90, spm_share=50, seed=7, chunk=chunk).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=str) == sorted((brute_middle(d, t, 90, 50, 7) for d, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.back) for r in made), key=str) == sorted(((d, t or "") for d, t in ROWS), key=str)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(none).count() == 0


def brute_runs(ids, least_length=6, least_exponent=4):
    found, n = {}, len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i > start and i + q - start >= max(least_length, least_exponent * q):
                found.setdefault((start, i + q - start), q)  # the smallest period of equal stretches comes first
            i += i == start
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 3)])
def test_runs_of_small_alphabets(least):
    r = random.Random(11)
    for _ in range(700):
        ids = [r.randrange(r.choice((1, 2, 3))) for _ in range(r.randrange(70))]
        if ids and r.random() < 0.6:
            p, s = r.randrange(1, len(ids) // 3 + 2), r.randrange(len(ids))
            ids = [x if i < s else ids[min(len(ids) - 1, s + (i - s) % p)] for i, x in enumerate(ids)]
        assert periodic_runs.find_runs(ids, *least) == brute_runs(ids, *least)


def test_runs(docs, none):
    got = periodic_runs.periodic_runs(docs).collect()
    want = []
    for d, t in ROWS:
        w = split(t)
        numbers = {}
        runs = brute_runs([numbers.setdefault(x, len(numbers)) for x in w]) if len(w) < 1500 else []
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((d, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in drop)))
    assert sorted(((r.doc_id, r.n_words, tuple((x["start"], x["length"], x["period"]) for x in r.runs), r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(none).count() == 0


def test_runs_query(spark):
    """The whole query on sf0.001 against the contract's words, the planted repetitions included."""
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(texts)
    long_run = 0
    for d, t in texts:
        w = split(t)
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        numbers = {}
        runs = brute_runs([numbers.setdefault(x, len(numbers)) for x in w])
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert got[d] == (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()), d
        long_run += bool(runs)
    assert long_run
