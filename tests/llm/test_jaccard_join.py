import random

import pytest

from factloom.llm import jaccard_join as J
from factloom.llm.components import connected_components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for k, (a, x) in enumerate(flat):
        for b, y in flat[:k]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted([(i, len(s), None if i is None else find(i)) for i, ss in sets.items() for s in ss], key=str)


def corpus(seed, n=220):
    """Random documents, near copies of every degree, copies, a passage that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 63, 64, 70, 90, 300]))] for _ in range(n // 3)]
    while len(texts) < n:
        t = list(r.choice(texts))
        kind = r.random()
        if kind < 0.5:
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
        elif kind < 0.7:
            t = t[: max(1, int(len(t) * r.uniform(0.7, 1)))]
        elif kind < 0.85:
            t = t + passage
        texts.append(t)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \t"), (None, "a b c d e f"), (903, "A B\x0bc d e f"), (904, "a b c d e f"), (904, "a b c d e f"), (904, "w1 w2")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rep int")
    got = sorted(map(tuple, J.components(docs).collect()), key=str)
    assert got == brute(rows)


def test_salted_groups_and_hot_order_change_nothing(spark, monkeypatch):
    rows = corpus(3) + [(1000 + k, " ".join(f"x{j}" for j in range(40) if j != k % 3)) for k in range(30)]
    monkeypatch.setattr(J, "SALTED", 5)
    monkeypatch.setattr(J, "COUNTED", 500)
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "LEADERS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.components(docs).collect()), key=str) == brute(rows)


def test_sketch_distance_bounds_the_symmetric_difference():
    r = random.Random(5)
    for _ in range(200):
        words = [str(r.random()) for _ in range(r.choice([6, 20, 80, 400]))]
        other = words[: r.randint(1, len(words))] + [str(r.random()) for _ in range(r.randint(0, 90))]
        a, b = J.shingles(" ".join(words).encode()), J.shingles(" ".join(other).encode())
        assert J.hamming(J.sketch(a), J.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_every_linked_pair_shares_a_bit_within_reach():
    r = random.Random(9)
    for _ in range(300):
        words = [str(r.random()) for _ in range(r.choice([5, 6, 9, 20, 80, 200]))]
        other = list(words)
        for _ in range(r.randint(0, max(1, len(words) // 20))):
            k = r.randrange(len(other))
            other[k : k + r.randint(0, 2)] = [str(r.random()) for _ in range(r.randint(0, 3))]
        a, b = J.shingles(" ".join(words).encode()), J.shingles(" ".join(other).encode())
        common = len(set(a.tolist()) & set(b.tolist()))
        if not common or 100 * common < 75 * (len(a) + len(b) - common):
            continue
        known = J.np.unique(J.np.concatenate([a, b])[:: r.randint(1, 3)] >> J.U(16))
        level = J.np.array([r.randrange(6) for _ in known], J.U)
        x, y = J.odd_bits(a, known, level), J.odd_bits(b, known, level)
        at = {int(v): k for k, v in reversed(list(enumerate(y.tolist())))}
        assert any(v in at and len(b) <= J.reach(len(a), i) and len(a) <= J.reach(len(b), at[v]) for i, v in enumerate(x.tolist()))


def test_empty_table_and_drop(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.components(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "q", "z"), (None, "q", "n")], "doc_id long, text string, c string")
    assert sorted(map(tuple, J.drop_near(docs).collect()), key=str) == sorted([(1, "a b c d e f", "y"), (3, "q", "z"), (None, "q", "n")], key=str)


def test_drop_carries_any_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x", 1, 2), (1, "a b c d e f", "y", 3, 4)], "doc_id long, text string, `a.b` string, gone int, row int")
    got = J.drop_near(docs)
    assert got.columns == docs.columns and list(map(tuple, got.collect())) == [(1, "a b c d e f", "y", 3, 4)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 450)] + [(5, 5), (None, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
