import random

from wareflow.llm import simhash, similar


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed=11, bases=25):
    """Texts with single-word edits or a replaced passage, at similarities from 0.4 to 1."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    draw = lambda n: [vocab[min(1999, int(rng.paretovariate(0.6)) - 1)] for _ in range(n)]
    rows = []
    for base in range(bases):
        words = draw(rng.choice((80, 300)))
        rows.append((base * 100, " ".join(words)))
        for copy in range(1, 13):
            changed = list(words)
            if copy % 2:
                for _ in range(max(1, len(words) * copy // 300)):
                    changed[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            else:
                n = len(words) * copy // 40
                at = rng.randrange(len(words) - n)
                changed[at : at + n] = draw(n)
            rows.append((base * 100 + copy, " ".join(changed)))
    return rows


def brute_roots(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def test_documents_of_the_contracted_similarity_and_no_others_go(spark):
    rows = [(-4, None), (-3, " "), (-2, "a B c"), (-1, "a b C"), *corpus()]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[r][0] for r in brute_roots(rows)}
    assert 50 < len(kept) < len(rows) - 50


def test_parts_of_a_large_component_meet(spark):
    rows = corpus(5, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def grouped(n):
        found = {}
        for r in similar.similar(df, shingles_per_part=n).collect():
            found.setdefault(r.root, set()).add(r.doc_id)
        return sorted(map(sorted, found.values()))

    assert grouped(500) == grouped(1 << 21)


def template_family(n=600, shared=150, own=45):
    """Texts that are no copies: one template and words of their own, of a similarity of 0.62 to each other."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(shared)]
    return [(k, " ".join(template + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for k in range(n)]


def test_texts_around_a_template_are_not_compared():
    import numpy as np

    rows = template_family() + [(1000 + k, template_family(1)[0][1] + f" x{k}") for k in range(30)]
    nodes, sets = np.arange(len(rows)), [similar.shingle_set(t.encode()) for _, t in rows]
    a, b, compared = similar.similar_edges(nodes, sets, 0.8)
    assert set(a.tolist()) | set(b.tolist()) == {0, *range(600, 630)}
    assert compared < 100, "pairs compared of 198,135"


def test_a_large_family_is_taken_apart(spark):
    rows = template_family(200) + corpus(5, 2)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {}
    for r in similar.similar(df, shingles_per_part=2000).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    want = {}
    for k, root in enumerate(brute_roots(rows)):
        want.setdefault(root, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_prefix_compare_equals_all_pairs():
    import numpy as np

    rows = corpus(17, 12)
    a, b, compared = similar.similar_edges(np.arange(len(rows)), [similar.shingle_set(t.encode()) for _, t in rows], 0.8)
    root = list(range(len(rows)))
    for x, y in zip(a.tolist(), b.tolist()):
        root[x] = y
    brute = brute_roots(rows)
    assert {tuple(i for i in range(len(rows)) if root[i] == r) for r in set(root)} == {tuple(i for i in range(len(rows)) if brute[i] == r) for r in set(brute)}
    assert compared < len(rows) * (len(rows) - 1) / 4
