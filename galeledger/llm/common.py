"""Helpers of the training-data operators: table access, text slices, word hashes and array expressions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where it is not installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about ``most`` bytes of text each, so that memory stays bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_list(column: pa.Array) -> list:
    """Values of a text or binary column; by way of numpy, which is several times faster than one scalar each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def body_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins, with the end of the last. A null text is empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[first[0]:first[-1]] if data else np.empty(0, dtype=np.uint8)
    return body, first - first[0]


def word_codes(texts: pa.Array, end: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts, A-Z lower-cased, split at ASCII white space: the distinct ones, the number of each word in them, and
    how many words each text has. With ``end`` an empty word ends every text. A null text is empty."""
    body, first = body_of(texts)
    body = np.frombuffer(body.tobytes().lower(), dtype=np.uint8)
    dark = (body != 32) & ((body < 9) | (body > 13))
    opens, closes = dark.copy(), dark.copy()
    opens[1:] &= ~dark[:-1]
    closes[:-1] &= ~dark[1:]
    inner = first[(first > 0) & (first < len(body))]  # a text ends and another begins
    opens[inner], closes[inner - 1] = dark[inner], dark[inner - 1]
    begin = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - begin
    stops = np.searchsorted(begin, first[1:])
    if end:
        size = np.insert(size, stops, 0)
        stops = stops + np.arange(1, len(stops) + 1)
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(places), pa.py_buffer(body[dark])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.diff(stops, prepend=0)


class WordHashes(dict):
    """XXH64 of words; forgets everything at ``most`` words."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD_HASHES = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of consecutive texts, from word hashes.

    A text with 1 to k-1 words has one shingle, the whole sequence; one without words has none.
    Returns the hashes, text after text, and how many belong to each text.
    """
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    left = np.repeat(starts + counts, n) - first
    h = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            at = np.minimum(first + i, len(words) - 1) if len(words) else first
            h = np.where(left > i, mixed(h * np.uint64(3) + words[at] + np.uint64(i + 1)), h) if len(first) else h
    return h, n


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
