import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodestack.llm.graphs import components
from lodestack.llm.ngram_join import Bounds, jaccard_components, one_of_each, op6_ngram_join, shingle_set, signatures

SCHEMA = "doc_id long, text string, lang string, nid long, label long, key long, _stays int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def brute(rows, size, percent):
    sets = sets_of([t for _, t in rows], size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
        else:
            w = rng.choices(words, k=rng.choice((1, 2, 9, 30, 90, 150))) + (passage if rng.random() < 0.5 else [])
        rows.append(w)
    return [(1000 - i, " ".join(w)) for i, w in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 1, 1, 1) for i, t in rows], SCHEMA).repartition(3)


def got(spark, rows, size, percent, **more):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), size, percent, **more).collect())


@pytest.mark.parametrize(
    "seed, size, percent, more",
    [(1, 3, 90, {}), (2, 3, 90, {"frequent": (2, 6), "small": 2, "block": 4}), (3, 5, 80, {"frequent": (1, 1)}), (4, 5, 80, {"frequent": (1, 4), "small": 1, "block": 1024}), (5, 3, 85, {"frequent": (1, 2), "small": 4, "block": 6})],
)
def test_equals_brute_force(spark, seed, size, percent, more):
    rows = corpus(seed, 160)
    assert got(spark, rows, size, percent, **more) == brute(rows, size, percent)


def test_linked_sets_share_a_signature():
    rng = random.Random(4)
    kinds = set()
    for percent in (80, 85, 90, 95):
        bounds = Bounds(percent)
        for _ in range(600):
            low = bounds.smallest()
            x = set(rng.sample(range(1 << 20), rng.choice((rng.randint(low, low + 40), rng.randint(low, 900)))))
            y = set(x)
            for t in rng.sample(sorted(x), rng.randint(0, bounds.tau(len(x)))):
                y.discard(t)
            y |= set(rng.sample(range(1 << 20), rng.randint(0, 1 + bounds.tau(len(x)))))
            if not bounds.linked(len(x), len(y), len(x & y)):
                continue
            prefixes = [sorted(s)[: bounds.prefix(len(s))] for s in (x, y)]
            shared = set(prefixes[0]) & set(prefixes[1])
            assert len(shared) >= max(bounds.need(len(x)), bounds.need(len(y)))
            repeated = shared | {t for p in prefixes for t in p if rng.random() < 0.5}
            rare = rng.choice((0.0, 0.3, 0.9))
            df = {t: 2 if rng.random() < rare else rng.choice((3, 4, 6, 7, 9)) for t in repeated}
            own = [set(signatures(np.array([t for t in p if t in df]), np.array([df[t] for t in p if t in df]), len(s), bounds, (3, 6))) for p, s in zip(prefixes, (x, y))]
            assert own[0] & own[1], (x, y)
            assert all(len(o) <= 12 * len(s) for o, s in zip(own, (x, y)))
            kinds |= {k[1] if len(k) > 2 else 0 for o in own for k in o}
    assert kinds == {0, 1, 2}


def test_smallest_sets():
    for percent in range(80, 100):
        low = Bounds(percent).smallest()
        assert 100 * low >= percent * (low + 1) and 100 * (low - 1) < percent * low and Bounds(percent).need(low) >= 4


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One two"), (8, "one TWO"), (7, "one"), (6, long), (2, long + " tail"), (1, "É a b c"), (0, "é a b c"), (6, long), (11, "a b"), (11, "one two")]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert got(spark, [], 3, 90) == []
    kept = one_of_each(frame(spark, rows), 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 11] and kept.columns == frame(spark, rows).columns


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[a] == labels[b] for a, b in edges) and labels[30] == 0 and labels[139] == 100
    assert all(labels[v] == v for v in set(labels.values()))


def test_shingles():
    assert len(shingle_set(b"A b\x0bC a B c", 3)) == 3 and len(shingle_set(b"a\xc2\xa0b", 3)) == 1


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_ngram_join(spark, "/root/testdata/sf0.001").collect()) == brute(rows, 3, 90)
