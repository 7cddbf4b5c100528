"""Token-id files in patched frame-of-reference blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .chunks import Chunks, Coded, coded
from .common import as_list, body_of, parts, ready, slices

MAGIC = b"PFR1"
BLOCK = 4096
SEGMENT = 1 << 19
GROUP = 400  # chunks that are encoded in one call
# Share of a block's values that the packed width must hold; wider ones go to the exception list.
PERCENTILE = 97.0
# Unicode white space; a chunk ends where white space follows a character that is none, as the pre-tokeniser's pieces do.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
_ENCODERS: dict[str, Chunks] = {}


def encoder(path: str) -> Chunks:
    """Chunk encoder over a tokenizers file; ids of a text equal those of encoding it whole. Each text ends with id 0."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        width = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)  # bytes of each id: a piece spells one byte per character
        for piece, i in tokenizer.get_vocab().items():
            width[i] = len(piece)
        inner = re.compile(rf"[{SPACE}].*[^{SPACE}]", re.DOTALL).fullmatch
        many = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(chunks: list[str]) -> Coded:
            """Chunks from white space to a letter can stand one after another in a long text, which costs less than one call each."""
            begin, size = np.full(len(chunks), -1, dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
            flat, used = [], 0
            some = [i for i, c in enumerate(chunks) if inner(c)]
            for s in range(0, len(some), GROUP):
                group = some[s:s + GROUP]
                ids = np.array(many(["".join([chunks[i] for i in group])])[0], dtype=np.uint32)
                ends = np.cumsum([len(chunks[i].encode()) for i in group])
                reached = np.cumsum(width[ids])
                cuts = np.searchsorted(reached, ends) + 1
                if cuts[-1] == len(ids) and (reached[cuts - 1] == ends).all():
                    size[group] = np.diff(cuts, prepend=0)
                    begin[group] = used + cuts - size[group]
                    flat.append(ids)
                    used += len(ids)
            rest = np.flatnonzero(begin < 0)
            ids, at, size[rest] = coded(many([chunks[i] for i in rest.tolist()]))
            begin[rest] = used + at
            return np.concatenate([*flat, ids]), begin, size

        _ENCODERS[path] = Chunks(CHUNK, encode, end=0)
    return _ENCODERS[path]


def white(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, the characters of SPACE."""
    out = (b == 32) | ((b >= 9) & (b <= 13))
    for lead, rest in ((0xC2, [(0x85,), (0xA0,)]), (0xE1, [(0x9A, 0x80)]), (0xE2, [(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [(0x81, 0x9F)]), (0xE3, [(0x80, 0x80)])):
        at = np.flatnonzero(b == lead)
        at = at[at + len(rest[0]) < len(b)]
        for tail in rest if len(at) else ():
            hit = at[np.logical_and.reduce([b[at + 1 + k] == x for k, x in enumerate(tail)])]
            for k in range(len(tail) + 1):
                out[hit + k] = True
    return out


def chunk_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut as by CHUNK: distinct chunks, the number of each chunk in them, and how many chunks each text has."""
    body, first = body_of(texts)
    blank = white(body)
    cut = np.zeros(len(body) + 1, dtype=bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    cut[first] = True
    bounds = np.flatnonzero(cut)
    chunks = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)]).dictionary_encode()
    return as_list(chunks.dictionary), chunks.indices.to_numpy(), np.diff(np.searchsorted(bounds, first))


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of every value, least significant first."""
    if not width:
        return b""
    kind, size = ("<u2", 2) if width <= 16 else ("<u4", 4)
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, dtype=np.uint32)
    kind, size = ("<u2", 16) if width <= 16 else ("<u4", 32)
    whole = np.zeros((n, size), dtype=np.uint8)
    whole[:, :width] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(whole, bitorder="little").view(kind).astype(np.uint32)


def encode_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Count, minimum, width, exception count, exception places and high parts, packed low parts."""
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    at = np.flatnonzero(high)
    return struct.pack("<IIBI", len(values), low, width, len(at)) + at.astype("<u4").tobytes() + high[at].astype("<u4").tobytes() + packed(rest, width)


def decode_block(data: memoryview) -> np.ndarray:
    n, low, width, outliers = struct.unpack_from("<IIBI", data)
    at = struct.calcsize("<IIBI")
    places = np.frombuffer(data, dtype="<u4", count=outliers, offset=at)
    high = np.frombuffer(data, dtype="<u4", count=outliers, offset=at + 4 * outliers)
    rest = unpacked(data[at + 8 * outliers:], n, width)
    rest[places] |= high << np.uint32(width) if width < 32 else np.uint32(0)
    return rest + np.uint32(low)


def encode_segment(values: np.ndarray) -> bytes:
    """Header, starts of the blocks, blocks. Any block is read alone by its start."""
    blocks = [encode_block(values[s:s + BLOCK]) for s in range(0, len(values), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])
    return MAGIC + struct.pack("<II", len(blocks), len(values)) + starts.astype("<u8").tobytes() + b"".join(blocks)


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values ``first`` to ``last`` (all by default); only their blocks are unpacked."""
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token segment")
    n, total = struct.unpack_from("<II", view, 4)
    starts = np.frombuffer(view, dtype="<u8", count=n + 1, offset=12)
    body = view[12 + 8 * (n + 1):]
    last = total if last is None else min(last, total)
    if first >= last:
        return np.empty(0, dtype=np.uint32)
    begin, end = first // BLOCK, (last - 1) // BLOCK + 1
    out = np.concatenate([decode_block(body[int(starts[b]):int(starts[b + 1])]) for b in range(begin, end)])
    return out[first - begin * BLOCK:last - begin * BLOCK]


def write_ids(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Token ids of every text in ascending ``doc_id`` order (nulls first, equal ids by text), as segment files under ``path``.

    A row of a file is one segment: shard, start within the shard, n_tokens, the documents that it holds whole
    (doc_ids, counts) and the packed data. Shards follow one another in doc_id order. The writer commits by task, so a lost executor
    only repeats its tasks. Null texts are empty and still get the end id.
    """
    spark = ready(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        ids, names, counts, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal start, ids, names, counts, held
            values = np.concatenate(ids)
            row = [[shard], [start], [len(values)], [names], [counts], [encode_segment(values)]]
            start, ids, names, counts, held = start + len(values), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, kinds)], columns)

        columns = ["shard", "start", "n_tokens", "doc_ids", "counts", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for part in slices(batch, "t"):
                got, n = own.encode_cut(*chunk_codes(part.column("t")))
                ids.append(got)
                names += part.column("d").to_pylist()
                counts += n.tolist()
                held += len(got)
                if held >= SEGMENT:
                    yield segment()
        if names:
            yield segment()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange(parts(spark), "d").sortWithinPartitions("d", "t")
    rows.mapInArrow(encoded, "shard long, start long, n_tokens long, doc_ids array<long>, counts array<long>, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts the ids of all documents before it."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, names, counts, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_ids", "counts", "data"))):
                values = decode_segment(data).astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(values[e - n:e]) for e, n in zip(ends.tolist(), counts)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(names), shard)), pa.array(names, type=pa.int64()), pa.array(start + ends - counts), pa.array(counts, type=pa.int64()),
                    pa.array(crc, type=pa.int64())], ["shard", "d", "at", "n_tokens", "crc"])

    files = ready(spark).read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # one row per shard, as many as tasks wrote
    before = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    docs = files.select("shard", "start", "doc_ids", "counts", "data").mapInArrow(decoded, "shard long, d long, at long, n_tokens long, crc long")
    return docs.join(before, "shard").select(F.col("d").alias(doc_id), (F.col("_before") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents written to files and read back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
