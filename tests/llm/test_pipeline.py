"""Each stage on its own input against a brute-force version, over the driver's smallest table."""

import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from galeledger.llm.decontaminate import words_of
from galeledger.llm.quality import BOILERPLATE, TERMINAL
from galeledger.session import settle
from .test_quality import counted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], SF), name))
    return tables, [{r.doc_id: r.asDict() for r in t.collect()} for t in tables]


def test_columns_and_names(run):
    tables, _ = run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentence_pieces"]
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def line_fails(line):
    low, n = line.lower(), line.count(" ") + 1
    bars, symbols = len(re.findall(r"[|•»›]", line)), len(re.findall(r"[#*$%&<>]", line))
    return (any(p in low for p in BOILERPLATE) or low != line and line.upper() == line or bars and bars * 4 >= n or symbols * 5 > n
            or not re.search(TERMINAL, line.rstrip(" ")[-3:]))


def test_quality(run):
    _, (before, after, *_) = run
    want = {}
    for i, r in before.items():
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        good = [x for x in lines if not line_fails(x)]
        counts = sum(len(x) for x in lines if not any(p in x.lower() for p in BOILERPLATE))
        kept = sum(map(len, good))
        if not counted(r["text"])[-1] and kept and kept >= 0.5 * counts:
            want[i] = "\n".join(good)
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_dedup(run):
    """Groups of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles; the one of least id stays."""
    _, (_, before, after, *_) = run
    sets, holders = {}, {}
    for i, r in before.items():
        words = r["text"].encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, own in sets.items():
        for b in {b for x in own for b in holders[x] if b > a}:
            both = len(own & sets[b])
            if both >= 0.8 * (len(own) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in before}


def test_decontamination(run, spark):
    _, (_, _, before, after, *_) = run
    grams = lambda w: {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
    items = [grams(words_of(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    share = {i: max(len(g & own) / len(g) for g in items if g) for i, r in before.items() for own in [grams(words_of(r["text"].encode()))]}
    assert {i for i in before if share[i] < 0.3} <= set(after)
    assert not {i for i in before if share[i] > 0.8} & set(after)


def test_secrets(run):
    from .test_secrets import ASSIGN
    _, (_, _, _, before, after, _) = run
    assert set(before) == set(after)
    for i, r in after.items():
        assert not any(len(m[2]) >= 6 for m in re.finditer(ASSIGN, r["text"], re.ASCII))
        assert "[SECRET]" in r["text"] or r["text"] == before[i]["text"]


def test_pieces(run):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    *_, before, after = run[1]
    assert {i: list(r["ids"]) for i, r in after.items()} == {i: library.encode(r["text"]) for i, r in before.items()}
    assert all(r["round_trip"] for r in after.values())


def test_internal_names_may_clash(spark, docs):
    from galeledger.llm.quality import quality
    from galeledger.llm.simhash import near_duplicates
    names = ["_hash", "_first", "_th", "_d", "_t", "_Q", "_l", "_all"]
    clashing = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    plain = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in near_duplicates(docs).collect())
    got = near_duplicates(clashing)
    assert got.columns == clashing.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got.collect()) == plain
    judged = quality(clashing)
    assert set(names) <= set(judged.columns) and {r["_Q"] for r in judged.collect()} == {5}
