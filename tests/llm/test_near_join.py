import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, SCHEMA, clashing, words

from twinfold.llm import components as C
from twinfold.llm import near_join as J


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, others, seen = [0] * len(rows), [set() for _ in rows], defaultdict(list)
    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for g in own:
            for j in seen[g]:
                shared[j] += 1
            seen[g].append(i)
        for j, k in shared.items():
            if k / (len(own) + len(sets[j]) - k) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
                if own != sets[j]:
                    others[i].add(sets[j])
                    others[j].add(own)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), doc) if x is not None), default=None)
    return sorted(repr((doc, least[root(i)], links[i], len(others[i]))) for i, (doc, _) in enumerate(rows))


def families(seed, copies):
    rng, rows = random.Random(seed), list(ODD)
    vocabulary = [f"w{i}" for i in range(500)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 150))]
        for _ in range(rng.choice(copies)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("kwargs", [{}, {"block": 8}])
def test_against_brute_force(spark, kwargs):
    rows = families(5, [1, 2, 6, 30])
    got = J.near_classes(clashing(spark.createDataFrame(rows, SCHEMA)), **kwargs).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_no_rows(spark):
    assert J.near_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.995), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = J.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= J.MOST_HASHES
    with pytest.raises(ValueError):
        J.choose_bands(0.01, 0.999, 4)


def test_common_counts():
    rng = np.random.default_rng(1)
    n = 70
    sets = [np.unique(np.concatenate([np.arange(20), rng.integers(0, 400, rng.integers(1, 60))])) for _ in range(n)]
    counts = J.common(np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets]), n)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(25)] + [(-5, 300), (300, 301)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
