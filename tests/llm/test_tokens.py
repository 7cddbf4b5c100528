import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from galeledger.llm import tokenfile
from galeledger.llm.pieces import Transducer, decoded, encoded, transducer

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
texts = st.text(alphabet=st.sampled_from(list(" \t\n\r▁\x85\xa0 　\x1cabcdeéß́中😀.,!'s 1239#<|>")), max_size=60)


@given(st.lists(texts, max_size=6))
@settings(max_examples=150, deadline=None)
def test_chunked_ids_equal_whole_ids(batch):
    whole = Tokenizer.from_file(BPE)
    ids, n = tokenfile.encoder(BPE).encode(batch)
    assert ids.tolist() == [i for t in batch for i in [*whole.encode(t, add_special_tokens=False).ids, 0]]
    assert n.sum() == len(ids)


@given(st.lists(texts, max_size=6))
@settings(max_examples=150, deadline=None)
def test_shortest_paths_equal_the_library(batch):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), transducer(MODEL)
    ids, n = own.encode(batch)
    assert ids.tolist() == [i for t in batch for i in library.encode(t)]
    for t, one in zip(batch, np.split(ids, np.cumsum(n)[:-1]) if batch else []):
        assert own.decode(one.tolist()).decode() == t.replace("▁", " ")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.integers(0, 400), st.integers(0, 400))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(values, a, b):
    tokenfile.BLOCK, kept = 64, tokenfile.BLOCK
    try:
        array = np.array(values, dtype=np.uint32)
        data = tokenfile.encode_segment(array)
        assert tokenfile.decode_segment(data).tolist() == values
        assert tokenfile.decode_segment(data, min(a, b), max(a, b)).tolist() == values[min(a, b):max(a, b)]
    finally:
        tokenfile.BLOCK = kept


def test_outliers_do_not_widen_a_block():
    values = np.full(4096, 9, dtype=np.uint32)
    values[::100] = 50000
    assert len(tokenfile.encode_block(values)) < 600


def test_files_hold_every_document_in_order(docs, no_docs):
    whole = Tokenizer.from_file(BPE)
    got = tokenfile.round_trip(docs, BPE).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at, want = 0, []
    for r in rows:
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4"))))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokenfile.round_trip(no_docs, BPE).count() == 0


def test_pieces_of_a_table(docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = encoded(docs, MODEL)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        if r.doc_id is not None:
            assert list(r.ids) == library.encode(text[r.doc_id] or "") and r.n_pieces == len(r.ids)
            assert r.round_trip == ("▁" not in (text[r.doc_id] or ""))
    for r in decoded(out, MODEL).collect():
        if r.doc_id is not None:
            assert r.text == (text[r.doc_id] or "").replace("▁", " ")
    assert encoded(no_docs, MODEL).count() == 0


def test_every_other_path_weighs_more():
    """All cuts of short texts into pieces: of those whose neighbours the merges leave apart, the cheapest is the encoding."""
    own, rng = transducer(MODEL), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(60):
        text = "".join(rng.choice("theinrsa中") for _ in range(rng.randint(1, 9)))
        chunk, found = "▁" + text, []

        def cut(at, pieces, cost):
            if at == len(chunk):
                found.append((cost, pieces))
            for stop in range(at + 1, len(chunk) + 1):
                piece = chunk[at:stop]
                if (piece in own.made or stop == at + 1) and (not pieces or not {piece, pieces[-1]} <= own.ids.keys() or own.arc(pieces[-1], piece)):
                    cut(stop, [*pieces, piece], cost - own.scores.get(piece, 0.0))

        cut(0, [], 0.0)
        assert own.written(min(found)[1]) == own.path(chunk) == library.encode(text)


@pytest.mark.parametrize("text", [" " * 100_000, "x" + " " * 30_001 + "y", "a" * 100_000, "é▁▁ b" * 3000])
def test_long_runs_end(text):
    import time
    start = time.time()
    ids, _ = transducer(MODEL).encode([text])
    assert time.time() - start < 5 and ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_store_of_chunks_stays_small():
    """Plain text is kept as such, in one byte a character, and no more than a fixed number of chunks; marks and spaces are one."""
    own = Transducer(MODEL)
    texts = ["one two  three", "one▁two▁▁three", " ".join(f"w{i:x}" for i in range(2000)), "", "né 中"]
    first = [own.encode([t])[0].tolist() for t in texts]
    assert first[0] == first[1]
    assert all(c.isascii() for c in own.chunks if not {"é", "中"} & set(c))
    assert own.chunks.most <= 300_000
    own.chunks.most = 50
    assert [own.encode([t])[0].tolist() for t in texts] == first
    own.encode(["last"])
    assert len(own.chunks) < 50


def test_chunks_by_bytes_equal_those_of_the_pattern():
    import re

    import pyarrow as pa
    rng = random.Random(5)
    letters = ["a", "B", "é", "日", "𝄞", "、", "​", "﻿", "\x1c", *" \t\n\r\x0b\x0c\x85\xa0       　"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randrange(0, 25))) for _ in range(rng.randrange(0, 8))]
        found, at, n = tokenfile.chunk_codes(pa.array(["left out", *texts], type=pa.string()).slice(1))
        want = [re.findall(tokenfile.CHUNK, t or "") for t in texts]
        assert [found[i] for i in at] == [c for w in want for c in w] and n.tolist() == [len(w) for w in want]
        ids, counts = tokenfile.encoder(BPE).encode(texts)
        own, sizes = tokenfile.encoder(BPE).encode_cut(found, at, n)
        assert own.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
