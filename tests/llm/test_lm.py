import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeledger.llm import lm


def base(rows, train):
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for t in train:
        counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, v, [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for w in map(tokens, rows)]


def test_base_scores_of_odd_texts(docs):
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    n, v, want = base([r.text for r in rows], [r.text for r in rows if not held(r.doc_id)])
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    assert (model.tokens, model.vocabulary) == (n, v)
    got = lm.score(docs, model).collect()
    key = lambda x: (x[0], x[1], round(x[2], 6))
    assert sorted(key((r.n_tokens, r.n_known, r.base_score)) for r in got) == sorted(map(key, want))
    assert all(r.score < 0 for r in got)


@pytest.fixture(scope="module")
def chain(spark):
    rng = random.Random(2)
    follow = {w: [f"w{rng.randint(0, 199)}" for _ in range(3)] for w in (f"w{i}" for i in range(200))}
    texts = []
    for _ in range(400):
        words = [f"w{rng.randint(0, 199)}"]
        while len(words) < 30:
            words.append(rng.choice(follow[words[-1]]))
        texts.append(" ".join(words))
    return texts


def test_pairs_help_on_unseen_texts(spark, chain):
    df = lambda t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    model = lm.train(df(chain[:300]))
    got = lm.score(df(chain[300:]), model).collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_filter_levels_and_parts(spark, chain, monkeypatch):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(chain)], "doc_id long, text string").repartition(3)
    model = lm.train(df)
    counts, keys = Counter(), {}
    for t in chain:
        tokens, n = lm.tokenised([t.encode()])
        h = lm.WORD_HASHES.of(tokens)
        for name, k in ((("w", x), y) for x, y in zip(tokens, lm.word_key(h))):
            counts[name] += 1
            keys[name] = k
        for i, k in enumerate(lm.pair_key(lm.neighbours(h, n), h)):
            name = tokens[i - 1] if i else None, tokens[i]
            counts[name] += 1
            keys[name] = k
    names = list(keys)
    want = lm.level(np.array([counts[x] for x in names]))
    got = lm.levels_of(np.array([keys[x] for x in names], dtype=np.uint64), model.n_sections, model.segment(0).value)
    assert (got >= want).all() and (got != want).mean() < 0.05  # a Bloom filter never loses, and seldom adds
    unseen = lm.mixed(np.arange(1, 20001, dtype=np.uint64))
    assert (lm.levels_of(unseen, model.n_sections, model.segment(0).value) > 0).mean() < 0.03
    whole = {r.doc_id: r.score for r in lm.score(df, model).collect()}
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 4000)
    cut = lm.train(df)
    assert len(cut.segments) > 2
    assert all(abs(r.score - whole[r.doc_id]) < 1e-9 for r in lm.score(df, cut).collect())


def test_empty_tables(spark, docs, no_docs):
    model = lm.train(no_docs)
    assert lm.score(no_docs, model).count() == 0
    assert all(r.base_score <= 0 for r in lm.score(docs, model).collect())


def test_words_by_bytes_and_sums():
    import pyarrow as pa
    from galeledger.llm.common import word_codes
    rng = random.Random(3)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aAbÉ日 \t\n\r\x0b\x0c\x85\xa0", k=rng.randrange(0, 25))).encode() for _ in range(rng.randrange(0, 8))]
        for end in (False, True):
            found, at, n = word_codes(pa.array([b"left out", *texts], type=pa.binary()).slice(1), end)
            want = [(t or b"").lower().split() + [b""] * end for t in texts]
            assert found.take(pa.array(at)).to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]
            assert len(set(found.to_pylist())) == len(found)
    keys, n = lm.summed(np.array([5, 1 << 63, 5, 7], dtype=np.uint64), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [5, 7, 1 << 63] and n.tolist() == [4, 4, 2]
    assert [len(x) for x in lm.summed(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))] == [0, 0]
