import random

import numpy as np

from galeledger.llm.graph import linked
from galeledger.llm.paragraphs import LEAST_WORDS, SIMILARITY, alike, repeated, tuned


def test_bands_reach_the_recall():
    bands, rows = tuned()
    assert 1 - (1 - SIMILARITY ** rows) ** bands >= 0.99


def shingles(line):
    words = line.lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    texts = []
    passages = [line(60) for _ in range(6)]
    for d in range(60):
        lines = [line(rng.randint(3, 90)) for _ in range(4)]
        p = list(rng.choice(passages))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p[rng.randint(0, 59)] = f"x{rng.randint(0, 9)}"
        lines.insert(rng.randint(0, 4), p)
        texts.append("\n".join(" ".join(x) for x in lines))
    texts += [texts[0], texts[0].upper(), None, ""]
    items = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(x.split()) >= LEAST_WORDS]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(x) for *_, x in items]
    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    sizes = {r: sum(find(i) == r for i in range(len(items))) for r in map(find, range(len(items)))}
    want = {items[i][:2]: (*items[find(i)][:2], sizes[find(i)]) for i in range(len(items)) if sizes[find(i)] > 1}
    df = spark.createDataFrame([(d, t, "clash") for d, t in enumerate(texts)], "doc_id long, text string, para string").repartition(4)
    rows = repeated(df).collect()
    assert {(r.doc_id, r.para): (r.class_doc, r.class_para, r.class_size) for r in rows} == want
    assert all(r.removed == ((r.doc_id, r.para) != (r.class_doc, r.class_para)) for r in rows)
    assert all(texts[r.doc_id][r.start:r.end] == texts[r.doc_id].split("\n")[r.para] for r in rows)


def test_hot_bucket_is_searched_whole(spark):
    """One bucket with many more rows than a block: every pair is looked at."""
    values = list(range(0, 900, 3)) + [1000, 1001]
    df = spark.createDataFrame([(0, v) for v in values], "k int, id long").repartition(5)
    links = lambda ids, _: np.nonzero(np.abs(ids[:, None] - ids[None, :]) == 1)
    assert {(r.a, r.b) for r in linked(df, ["k"], [], links, block=16).collect()} == {(1001, 1000)}
    near = lambda ids, _: np.nonzero(np.abs(ids[:, None] - ids[None, :]) == 3)
    from galeledger.llm.graph import components
    assert {r.root for r in components(linked(df, ["k"], [], near, block=16)).collect()} == {0}


def test_block_similarity_is_exact():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32)) for _ in range(40)]
    sets += [sets[0], np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32)]
    x, y = alike(0.6)(np.arange(len(sets)), [pa.array([s.tobytes() for s in sets], type=pa.binary())])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j])) - 1e-9}
    assert set(zip(x.tolist(), y.tolist())) == want


def test_empty_and_odd(docs, no_docs):
    assert repeated(no_docs).count() == 0
    assert repeated(docs).count() == 0
    assert repeated(docs, least_words=10).where("removed").count() > 0
