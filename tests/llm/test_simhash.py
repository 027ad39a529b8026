import random

import xxhash

from wareflow.llm import simhash


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, threshold=4):
    fps = {}
    for doc_id, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(doc_id)
    keys, root = list(fps), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for f, ids in fps.items():
        named = [i for i in ids if i is not None]
        if named:
            r = find(f)
            least[r] = min(least.get(r, min(named)), min(named))
    return sorted(((d, f"{brute_fingerprint(t):016x}", least.get(find(brute_fingerprint(t)))) for d, t in rows), key=str)


def result(df):
    from pyspark.sql import functions as F

    named = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    return sorted(map(tuple, named.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one Two"), (4, "one Two"), (5, "one two"), (None, "one two"), (6, "é " * 30)]
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(400)]
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(len(changed))] = rng.choice(vocab)
            rows.append((100 + 10 * base + copy, " ".join(changed)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, root int")
    assert result(df) == brute_components(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert result(df) == []
    assert simhash.deduplicate(df).count() == 0


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words here"), (None, "a b c d e f g")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f g"), (2, "other words here"), (None, "a b c d e f g")], key=str)


def test_crowded_anchor_is_split_without_losing_links(spark):
    fps = [0] + [1 << i for i in range(40)] + [(1 << 50) | 1 << i for i in range(20)] + [-1, -2]
    df = spark.createDataFrame([(f, 0) for f in fps], "fp long, check long")
    from wareflow.operators.graph import components

    def grouped(n):
        return sorted(map(tuple, components(simhash.links(df, homes_per_task=n)).collect()))

    assert grouped(3) == grouped(1 << 15)
    assert len({r for _, r in grouped(3)}) == 2


def test_anchors_propose_near_duplicates_that_are_then_checked(spark, monkeypatch):
    """Without bands, anchors alone find close copies; what they link below the contracted similarity stays."""
    from wareflow.llm import similar

    rng = random.Random(4)
    rows, tiny = [], "a b c d e"
    for base in range(5):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        rows.append((base * 10, " ".join(words)))
        rows.append((base * 10 + 1, " ".join([*words[:700], "edited", *words[701:]])))
    rows += [(900, tiny), (901, tiny + " f")]
    monkeypatch.setattr(similar, "candidates", lambda classes: classes.select(classes.node.alias("a"), classes.node.alias("b")).where("false"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == {0, 10, 20, 30, 40, 900, 901}
