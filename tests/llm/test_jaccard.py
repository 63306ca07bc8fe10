import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import jaccard_join
from tessera.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        for j, k in Counter(j for g in s for j in inverted[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j][1]) - k):
                parent[find(i)] = find(j)
        for g in s:
            inverted[g].append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets)]


def near_copies(seed, count, words, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(count):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i * 3 - 5, " ".join(w)))
    return rows + [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))) for i in range(40)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, small, odd, n, percent):
    made = spark.createDataFrame(near_copies(1, 90, 120, 6) + near_copies(2, 60, 2500, 60)[:60], "doc_id long, text string").selectExpr("doc_id + 7 * cast(length(text) > 9000 as long) as doc_id", "text")
    for docs in (made, small, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in jaccard_join.join(docs, n, percent).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, n, percent), key=str)


def test_empty_table(empty):
    assert jaccard_join.join(empty).collect() == []


def test_gaps_round_trip():
    import numpy as np

    at = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 3000))
    assert (jaccard_join.unpacked(jaccard_join.packed(at)) == at).all()
    assert (jaccard_join.unpacked(jaccard_join.packed(np.array([0, 255, 510, 100000]))) == [0, 255, 510, 100000]).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200) * 7919 % 1009, r.randrange(200) * 7919 % 1009) for _ in range(120)] + [(10000 + i, 10001 + i) for i in range(60)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    for x, y in got.items():
        mine[y].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
