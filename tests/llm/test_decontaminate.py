import cProfile
import pstats
import random

import numpy as np

from galeledger.llm.decontaminate import Finder, Items, _blocks, _prepared, _bodies, common_length, common_order, compact, decontaminated, leaks, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        places = common_order(a, b)
        assert common_length(masks, len(a), b) == len(places) == lcs(a, b)
        assert places == sorted(places) and lcs(a, [b[i] for i in places]) == len(places)
    assert compact([0, 40, 41, 42, 43, 90], 10) == [40, 41, 42, 43]


def corpus():
    rng = random.Random(6)
    vocabulary = [f"term{i}" for i in range(4000)]
    words = lambda n: [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to"]) for _ in range(n)]
    items = [words(rng.randint(12, 60)) for _ in range(80)]
    texts, planted = [], set()
    for d in range(150):
        text = words(rng.randint(5, 900))
        if d % 3 == 0:
            i = d // 3
            passage = list(items[i])
            if d % 2:  # a paraphrase: some words replaced, some put in, not in the last quarter
                for k in range(0, int(len(passage) * 0.6), 8):
                    passage[k] = "other"
                passage.insert(3, "inserted")
            at = rng.randint(0, len(text))
            text[at:at] = passage
            planted.add((d, i))
        texts.append(" ".join(text).replace("term1 ", "Term1, "))
    return items, texts, planted


def test_leaks_and_paraphrases_are_found(spark):
    items, texts, planted = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)] + [(500, None, ""), (501, "", ""), (None, texts[0], "")], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w), None) for i, w in enumerate(items)] + [(900, None, "x"), (901, "...", "y")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert planted <= got and {(d, i) for d, i in got if d is not None} == planted and (None, 0) in got
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(150)) - {d for d, _ in planted} | {500, 501}


def test_candidates_reach_the_recall_of_brute_force(spark):
    items, texts, _ = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    block = _prepared(_bodies(docs, "text"), next(_blocks(bench, "item_id", "text", None)))
    found = {(t, i) for t, i, *_ in Finder(block).hits([t.encode() for t in texts])}
    brute = {(t, i) for t, text in enumerate(texts) for i, w in enumerate(items)
             if any(lcs(w, own[s:s + len(w) + 8]) >= 0.8 * len(w) for own in [[x.decode() for x in words_of(text.encode())]] for s in range(0, max(1, len(own) - len(w) + 1), 4))}
    assert len(found & brute) >= 0.9 * len(brute) and len(brute) >= 20


def test_windows_without_the_words_take_no_python_step():
    """Windows that point to an item but lack its words are left out by arrays: fewer function calls than such windows, and nothing lost."""
    rng = random.Random(3)
    words = [[rng.randrange(300) for _ in range(40)] for _ in range(60)]
    block = Items(list(range(60)), words, [[] for _ in words], {f"w{i}".encode(): i for i in range(300)})
    block.basis = np.eye(300, dtype=np.float32)
    block.latent = np.stack([block.basis[w].sum(axis=0) / np.linalg.norm(block.basis[w].sum(axis=0)) for w in words])
    finder = Finder(block, 0.1)
    texts = [[rng.randrange(300) for _ in range(rng.randint(0, 400))] for _ in range(40)]
    texts[7][100:100] = words[5]
    bodies = [" ".join(f"w{i}" for i in t).encode() for t in texts]
    numbers = np.array([i for t in texts for i in t])
    counts = np.array([len(t) for t in texts])
    text, start, item, _ = finder.candidates(numbers, counts)
    begin = (np.cumsum(counts) - counts)[text]
    lo, hi = begin + np.maximum(0, start - 40), begin + np.minimum(counts[text], start + 72)
    want = [len(set(words[i]) - set(numbers[a:b].tolist())) <= 0.4 * 40 for a, b, i in zip(lo, hi, item)]
    assert finder.complete(numbers, np.arange(len(numbers) + 1), lo, hi, item).tolist() == want and sum(want) < len(want) / 5
    profile = cProfile.Profile()
    assert {h[:2] for h in profile.runcall(finder.hits, bodies)} == {(7, 5)}
    assert pstats.Stats(profile).total_calls < len(want)


def test_many_blocks_and_empty_tables(spark, docs, no_docs, monkeypatch):
    from galeledger.llm import decontaminate
    items, texts, planted = corpus()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 700)
    rows = spark.createDataFrame([(d, t) for d, t in enumerate(texts[:60])], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items[:30])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(rows, bench).collect()} == {(d, i) for d, i in planted if d < 60 and i < 30}
    assert leaks(no_docs, bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_thousands_of_items_are_found(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(30000)]
    weights = [1 / (i + 8) for i in range(30000)]
    words = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [words(rng.randint(15, 59)) for _ in range(2500)]
    texts, planted = [], set()
    for i in range(0, 2500, 5):
        text, copy = words(rng.randint(100, 600)), list(items[i])
        if i % 2:
            for k in rng.sample(range(len(copy)), int(0.15 * len(copy))):
                copy[k] = rng.choice(vocabulary)
        at = rng.randint(0, len(text))
        text[at:at] = copy
        planted.add((len(texts), i))
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert len(got & planted) >= 0.98 * len(planted) and len(got - planted) <= 5
