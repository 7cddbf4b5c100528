import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeledger.llm import suffixes
from galeledger.llm.suffixes import COVER, PERIOD, difference_cover, names, without_repeats
from galeledger.session import scratch_path


def brute(rows, span=400):
    bodies = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i:i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for (d, *_), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def planted(docs):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n😀") for _ in range(n))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [text(n) for n in (399, 400, 401, 580, 1500, 3000)]
    for k, b in enumerate(base):
        rows += [(100 + 10 * k, b), (101 + 10 * k, text(37) + b + text(50)), (102 + 10 * k, b[:-3]), (103 + 10 * k, text(181) + b[5:] + b[:420])]
        for j in range(3):  # edits in copies
            x = list(text(rng.randrange(300)) + b)
            for _ in range(len(x) // 700 + 1):
                at = rng.randrange(len(x))
                x[at:at + rng.randrange(3)] = text(rng.randrange(4))
            rows.append((104 + 10 * k + j, "".join(x)))
    rows += [(900 + j, base[4]) for j in range(30)] + [(None, base[3]), (950, "x" * 1000), (951, "ab" * 450), (952, "\x00" * 399), (953, "é" * 200), (954, text(900))]
    rows += [(960 + n, base[5][:n]) for n in (396, 397, 398, 399, 400, 401, 402, 403)]
    return rows


def test_against_brute_force(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(4).withColumns({"d": F.lit(1), "body": F.lit("x"), "sid": F.lit(0), "near": F.lit(2)})
    assert got(df) == brute(planted)


def test_small_slices_units_and_shuffled_marks(spark, planted, monkeypatch):
    import pyspark.cloudpickle as cloudpickle
    cloudpickle.register_pickle_by_value(suffixes)  # workers see the changed sizes
    try:
        for name, value in (("SLICE", 3000), ("UNIT", 500), ("WINDOW", 700), ("FEW_MB", -1)):
            monkeypatch.setattr(suffixes, name, value)
        suffixes.powers.cache_clear()
        df = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
        assert got(df) == brute(planted)
    finally:
        cloudpickle.unregister_pickle_by_value(suffixes)
        suffixes.powers.cache_clear()


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) == brute(rows)


def test_nothing(spark, no_docs):
    assert without_repeats(no_docs).count() == 0


def test_cover_and_names():
    for r in (0, 1, 2, 3):
        v, cover = difference_cover(r)
        assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))
    inside = set((COVER % PERIOD).tolist())
    assert all(any((i + d) % PERIOD in inside and (j + d) % PERIOD in inside for d in range(PERIOD)) for i in range(0, PERIOD, 7) for j in range(PERIOD))
    rng = np.random.default_rng(2)
    body = rng.integers(0, 3, 5000).astype(np.uint8)
    places = np.sort(rng.choice(4900, 700, replace=False))
    for n in (8, 9, 17, 100):
        h = names(body, places, n)
        first = {}
        for p, x in zip(places.tolist(), h.tolist()):
            assert first.setdefault(body[p:p + n].tobytes(), x) == x
        assert len(set(first.values())) == len(first)


def test_files_of_few_slices(spark, monkeypatch):
    """A file that many slices share is held whole by its writer and its reader."""
    made = []

    def noted(session, label):
        made.append((label, scratch_path(session, label)))
        return made[-1][1]

    monkeypatch.setattr(suffixes, "scratch_path", noted)
    block = np.random.default_rng(3).integers(97, 123, suffixes.SLICE + 9, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(i, block) for i in range(3)], "doc_id long, text string").coalesce(1)
    assert {r.n_removed for r in suffixes.without_repeats(docs).collect()} == {len(block)}
    for label, path in made:
        if label in ("slices", "neighbours"):
            files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
            assert sum(r["count"] for r in files) == 3 and max(r["count"] for r in files) <= suffixes.FILE_SLICES
