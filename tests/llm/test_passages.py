import random

import numpy as np

from galeledger.llm.paragraphs import repeated_anywhere
from galeledger.llm.passages import AROUND, over, passages


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for n in (1, 5, 12):
        assert over(x, n, np.minimum)[:100 - n + 1].tolist() == [x[i:i + n].min() for i in range(100 - n + 1)]
    assert AROUND == 11


def test_passages_inside_lines_and_across_short_lines(spark):
    """Passages of 51 words and more, each in three texts: inside a longer line, over short lines, and with other white space and case."""
    rng = random.Random(4)
    line = lambda n: [f"w{rng.randint(0, 9000)}" for _ in range(n)]
    texts, want = [], {}
    for p in range(12):
        passage = [f"é{rng.randint(0, 9000)}" for _ in range(51 + 3 * p)]
        short = "\n".join(" ".join(passage[i:i + 9]) for i in range(0, len(passage), 9))
        for form in (" ".join(passage), short, "  ".join(passage).upper().replace("É", "é")):
            front, back = " ".join(line(rng.randint(1, 60))) + rng.choice(" \n"), rng.choice(" \n") + " ".join(line(rng.randint(1, 60)))
            want[len(texts)] = (len(front), len(front) + len(form), len(passage), 3 * p, front.count("\n"))
            texts.append(front + form + back)
    texts += [None, "", " ".join(line(300)), " ".join(line(45))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = passages(df).collect()
    assert {r.doc_id: (r.start, r.end, r.n_words, r.class_doc, r.para) for r in rows} == want and len(rows) == len(want)
    assert all(r.class_size == 3 and r.removed == (r.doc_id != r.class_doc) and r.class_start == want[r.class_doc][0] for r in rows)
    # whole lines come as before, and the passages beside them; a copied line is no passage too
    both = repeated_anywhere(df.unionByName(df.where("doc_id = 38").selectExpr("doc_id + 10 as doc_id", "text"))).collect()
    assert {(r.doc_id, r.start, r.end) for r in both if r.unit == "passage"} == {(d, *w[:2]) for d, w in want.items()}
    assert {(r.doc_id, r.class_doc, r.class_size, r.class_start) for r in both if r.unit == "line"} >= {(38, 38, 2, 0), (48, 38, 2, 0)}


def test_odd_texts(docs, no_docs):
    assert passages(no_docs).count() == 0
    # a text that repeats itself: its first words stay
    rows = passages(docs).collect()
    assert {r.doc_id for r in rows} == {11} and any(not r.removed for r in rows)


def test_contexts_as_binary(spark):
    from galeledger.llm.passages import listed, moved, unlisted
    rng = random.Random(4)
    lists = [[rng.choice([1, 2, -3]) for _ in range(rng.randrange(0, AROUND + 1))] for _ in range(60)]
    values, n = unlisted(listed(np.array([len(x) for x in lists]), np.array([v for x in lists for v in x])))
    assert [v[:k].tolist() for v, k in zip(values, n)] == lists
    raw = [None if i % 9 == 8 else np.array(x, dtype="<i4").tobytes() for i, x in enumerate(lists)]
    away = np.arange(1, AROUND + 1, dtype="<i4").tobytes()
    rows = [(i, raw[i], raw[i // 2], 100, away) for i in range(len(lists))]
    got = {r.id: r for r in moved(spark.createDataFrame(rows, "id long, x binary, y binary, p long, far binary"), "n", ("x", "y"), {"start": ("p", "far", -1)}).collect()}
    for i, x, y, p, _ in rows:
        a, b = (np.frombuffer(v or b"", dtype="<i4").tolist() for v in (x, y))
        n = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        assert (got[i].n, got[i].start) == (n, 100 - n)


def test_units_are_packed_by_text(spark):
    from galeledger.llm.passages import UNIT, unit_keys, units, units_in, filter_of
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=k)) for k in (300, 39, 60, 300)] + [None, ""]
    packed = units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    sizes = {r.d: (len(r.words) // 4, len(r.hashes) // 8) for r in packed.collect()}
    assert set(sizes) == {0, 2, 3} and all(a == b > 0 for a, b in sizes.values())
    keys = unit_keys(packed)
    found = units_in(packed, filter_of(keys)).collect()
    assert sorted(r.h for r in found) == sorted(r.h for r in keys.collect())
    assert all(r.stop == r.word + UNIT and r.stop <= len(texts[r.d].split()) for r in found)
