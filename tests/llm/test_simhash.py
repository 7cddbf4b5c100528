import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from galeledger.llm import graph, simhash
from galeledger.llm.graph import components
from galeledger.llm.simhash import allocated, near_duplicates, near_fingerprints, similar


def fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(values, pairs):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_fingerprints_and_components(spark, docs, no_docs):
    rows = docs.collect()
    fps = {r.text: fingerprint(r.text) for r in rows}
    distinct = sorted(set(fps.values()))
    root = joined(distinct, [(a, b) for a in distinct for b in distinct if (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            least[root[fps[r.text]]].append(r.doc_id)
    want = sorted(((r.doc_id, fps[r.text], min(least[root[fps[r.text]]], default=None)) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in similar(docs).collect()), key=repr) == want
    assert similar(no_docs).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_link_is_found(spark, radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)}
    values |= {rng.getrandbits(12) for _ in range(200)}  # equal upper bits: two parts are hot
    values = sorted(values)
    root = joined(values, [(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= radius])
    signed = lambda v: v - (v >> 63 << 64)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    edges = near_fingerprints(df, radius)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 64 for r in edges.collect())
    got = {r.node % 2**64: r.root % 2**64 for r in components(edges).collect()}
    groups = lambda m: {frozenset(v for v in values if m.get(v, v) == k) for k in {m.get(v, v) for v in values}}
    assert groups(got) == groups(root)


def test_thresholds_cost_least():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 3, 5))
    for budget in (-1, 0, 1, 3):
        got = allocated(costs, budget)
        assert (got.sum(axis=1) == budget).all()
        cost = costs[np.arange(50)[:, None], np.arange(3)[None], got + 1].sum(axis=1)
        every = [(a, b, c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == budget]
        assert np.allclose(cost, np.min([[costs[x, 0, a + 1] + costs[x, 1, b + 1] + costs[x, 2, c + 1] for a, b, c in every] for x in range(50)], axis=1))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(10, 60)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{x: 5 for x in range(10, 60)}, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, docs, no_docs):
    kept = near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((i for i, _ in got if i is not None)) == [1, 4, 7, 8, 9, 10, 11, 15] and len(got) == 9
    assert near_duplicates(no_docs).count() == 0


def test_links_are_thinned_where_they_are_made(spark, docs, monkeypatch):
    """One Python step a stage at most: a second one doubles the workers of every executor."""
    plans, settled = [], graph.settle

    def kept(df, label="settled"):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
        return settled(df, label)

    monkeypatch.setattr(graph, "settle", kept)
    near_duplicates(docs)
    similar(docs)
    steps = [part.count("MapInArrow") for plan in plans for part in plan.split("Exchange")]
    assert sum(steps) >= 3 and max(steps) == 1


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        base = words(200)
        copy = list(base)
        copy[rng.randint(20, 180)] = "changed"
        texts += [base, copy, words(200)]
    kept = near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).select(F.collect_set("doc_id")).first()[0]
    assert set(range(60)) - set(kept) == set(range(1, 60, 3))


def test_near_duplicates_equal_pure_jaccard(spark):
    """Copies down to the threshold are found whatever bits of a fingerprint they flip."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = []
    for i in range(80):
        base = words(rng.randint(60, 300))
        more = words(len(base) * rng.choice([12, 18, 23, 40]) // 100)  # a longer copy: Jaccard 0.89, 0.85, 0.81 and 0.71
        texts += [base, base + more, words(100)]
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = joined(range(len(texts)), [(a, b) for b in range(len(texts)) for a in range(b) if near(a, b)])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_duplicates(df).collect()} == set(root.values())


def test_close_fingerprints_are_candidates(spark, monkeypatch):
    """Near copies that no band brings together are found by their fingerprints; what is close but no copy stays."""
    monkeypatch.setattr(simhash, "tuned", lambda *_: (1, 1500))
    rng = random.Random(7)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(3000)]
        texts += [base, [*base[:1500], "changed", *base[1501:]]]
    kept = {r.doc_id for r in near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    gone = set(range(40)) - kept
    assert len(gone) >= 10 and gone <= set(range(1, 40, 2))
