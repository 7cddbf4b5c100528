"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import WORD_HASHES, as_list, mixed, parts, ready, slices, word_codes

END = b""  # the end of a text; no word is empty
START = np.uint64(0x5851F42D4C957F2D)
# Frequent words whose exact counts every worker holds: at most this many, each at most 64 bytes.
HOT_WORDS = 1 << 18
HOT_LENGTH = 64
BASE = 1.5  # counts in [1.5^(j-1), 1.5^j) share level j
BITS_PER_ENTRY = 10
HASHES = 5
SEGMENT_BYTES = 256 << 20  # most bytes of filter broadcast at a time
FLUSH = 3 << 20  # tokens whose n-grams are counted in memory before they are sent on
HELD = 1 << 22  # counts of n-grams that a task holds before it sums those of the same n-gram
START_CLASS, CLASSES = 63, 64  # of contexts: 0 rare words, their count's level for frequent ones, text start
_LOG_BASE = np.log(BASE)


def level(count: np.ndarray) -> np.ndarray:
    """Level of a count: 1 + floor(log_1.5 count)."""
    return (1 + np.floor(np.log(np.maximum(count, 1)) / _LOG_BASE + 1e-9)).astype(np.int64)


def _means() -> np.ndarray:
    out = np.zeros(CLASSES + 1)
    for j in range(1, CLASSES + 1):
        low, high = np.ceil(BASE ** (j - 1) - 1e-9), np.ceil(BASE ** j - 1e-9) - 1
        out[j] = (low + max(low, high)) / 2
    return out


MEANS = _means()  # count that a level stands for, 0 for none


def word_key(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(0xD6E8FEB86659FD93))


def context_part(h: np.ndarray) -> np.ndarray:
    return mixed(h) >> np.uint64(32)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Upper half: fingerprint of the word before; lower half: of the pair."""
    return (context_part(before) << np.uint64(32)) | (mixed(before * np.uint64(3) + word) >> np.uint64(32))


def places(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each key at a level, before the modulus, and the step from one place to the next."""
    h = mixed(key + np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))
    return h, mixed(h ^ np.uint64(0x94D049BB133111EB)) | np.uint64(1)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def tokenised(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """Words and ends of all texts and the tokens of each: A-Z lower-cased, split at ASCII white space."""
    found, at, counts = word_codes(pa.array(texts, type=pa.binary()), end=True)
    return found.take(pa.array(at)).to_pylist(), counts


def neighbours(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of the token before each token; the start mark before the first of a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(counts) - counts] = START
    return before


def held_out(doc_id: Column) -> Column:
    """Remainder 2 of the CRC-32 of the id's text by 7; a null id is no held-out row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """What scoring needs: count table, totals, and what is broadcast."""

    counts: DataFrame  # (word binary, n long) of every training token
    tokens: int
    vocabulary: int
    texts: int
    hot: Broadcast  # word -> exact count, bounded
    rest: np.ndarray  # by context class: probability left for words not seen after it
    discount: float
    sections: DataFrame  # (section, bits, data)
    segments: list[list[int]]  # sections broadcast together
    n_sections: int

    def segment(self, i: int) -> Broadcast:
        spark = self.sections.sparkSession
        own = set(self.segments[i])
        rows = self.sections.where(F.col("section").isin([int(x) for x in own])).select("section", "bits", "data").toArrow()
        start, bits = np.full(self.n_sections, -1, dtype=np.int64), np.ones(self.n_sections, dtype=np.uint64)
        at, pieces = 0, []
        for s, b, d in zip(rows.column("section").to_pylist(), rows.column("bits").to_pylist(), rows.column("data")):
            start[s], bits[s] = at, b
            pieces.append(np.frombuffer(d.as_buffer(), dtype=np.uint8))
            at += len(pieces[-1])
        return spark.sparkContext.broadcast((start, bits, np.concatenate(pieces) if pieces else np.zeros(1, dtype=np.uint8)))


def levels_of(keys: np.ndarray, sections: int, filter_: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Levels of n-grams by repeated membership probes: level after level until one is missing. 0 if the first is,
    or if the section is not in this part of the filter."""
    start, bits, data = filter_
    section = (keys % np.uint64(sections)).astype(np.int64)
    out = np.zeros(len(keys), dtype=np.uint8)
    alive = np.flatnonzero(start[section] >= 0)
    for j in range(1, CLASSES + 1):
        h, step = places(keys[alive], j)
        for k in range(HASHES):
            if not len(alive):
                return out
            s = section[alive]
            at = h % bits[s]
            byte = data[start[s] + (at >> np.uint64(3)).astype(np.int64)]
            hit = (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, step = alive[hit], step[hit]
            h = h[hit] + step
        out[alive] = j
    return out


def train(docs: DataFrame, text: str = "text") -> Model:
    """Model of all texts of ``docs``: exact counts of tokens, and a filter of the counts of words and word pairs.

    N-grams are counted in each task and the counts summed by a shuffle on the n-gram, so the work grows with the
    corpus and no key is hot. Each filter section has as many bits as its entries ask for.
    """
    spark = ready(docs.sparkSession)
    body = docs.select(F.col(text).cast("binary").alias("t"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed_words() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, "t"):
                found, at, _ = word_codes(part.column("t"), end=True)
                held.append(pa.Table.from_arrays([found, pa.array(np.bincount(at, minlength=len(found)))], ["word", "n"]))
                if sum(t.num_rows for t in held) > HOT_WORDS:
                    held = [summed_words()]
                    if held[0].num_rows > HOT_WORDS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from summed_words().to_batches()

    counts = settle(body.mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    tokens, vocabulary, texts = (int(x) for x in total)
    top = counts.where(F.length("word") <= HOT_LENGTH).orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
    frequent = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    hot = spark.sparkContext.broadcast(frequent)
    context = context_part(WORD_HASHES.of(list(frequent)))
    order = np.argsort(context)
    classes = spark.sparkContext.broadcast((context[order], level(np.fromiter(frequent.values(), dtype=np.int64, count=len(frequent)))[order]))
    mass = np.zeros(CLASSES)
    np.add.at(mass, level(np.fromiter((n for w, n in frequent.items() if w != END), dtype=np.int64)), [n for w, n in frequent.items() if w != END])
    mass[0] = tokens - texts - mass.sum()
    mass[START_CLASS] = texts

    n_sections = 4 * parts(spark)

    def packed(keys: np.ndarray, n: np.ndarray, pair: bool) -> pa.RecordBatch:
        """One row for each section, with all its keys and their counts."""
        section = (keys % np.uint64(n_sections)).astype(np.int64)
        order = np.argsort(section, kind="stable")
        own, first = np.unique(section[order], return_index=True)
        keys, n = keys[order].astype("<u8"), n[order].astype("<i8")
        cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)])], type=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), pair)), cut(keys), cut(n)], ["section", "pair", "keys", "counts"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return packed(*np.unique(np.concatenate(held), return_counts=True), True)

        for batch in batches:
            for part in slices(batch, "t"):
                found, at, counts = word_codes(part.column("t"), end=True)
                h = WORD_HASHES.of(as_list(found))[at]
                held.append(pair_key(neighbours(h, counts), h))
                size += len(h)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(word_key(WORD_HASHES.of(as_list(batch.column("word")))), batch.column("n").to_numpy(), False)

    start_part = context_part(np.array([START]))[0]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {False: [], True: []}, 0  # of words, of pairs

        def sums(kind: bool) -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip((np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), *held[kind]))
            return summed(key, n)

        limit = HELD
        for batch in batches:
            for kind, keys, n in zip(*(batch.column(c).to_pylist() for c in ("pair", "keys", "counts"))):
                held[kind].append((np.frombuffer(keys, dtype="<u8"), np.frombuffer(n, dtype="<i8")))
                rows += len(n) // 8
            if rows > limit:
                for kind in held:
                    held[kind] = [sums(kind)]
                rows = sum(len(k) for got in held.values() for k, _ in got)
                limit = max(HELD, 2 * rows)
        (word_keys, word_counts), (pair_keys, pair_counts) = sums(False), sums(True)
        held.clear()
        key, count = np.concatenate([word_keys, pair_keys]), np.concatenate([word_counts, pair_counts])
        section = (key % np.uint64(n_sections)).astype(np.int64)
        pair = np.arange(len(key)) >= len(word_keys)
        parts_, class_ = classes.value
        for s in np.unique(section):
            own = section == s
            k, top = key[own], level(count[own])
            bits = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
            data = np.zeros(bits, dtype=bool)
            for j in range(1, int(top.max()) + 1):
                at, step = places(k[top >= j], j)
                for _ in range(HASHES):
                    data[(at % np.uint64(bits)).astype(np.int64)] = True
                    at = at + step
            before = k[pair[own]] >> np.uint64(32)
            at = np.minimum(np.searchsorted(parts_, before), max(len(parts_) - 1, 0))
            kind = np.where(parts_[at] == before, class_[at], 0) if len(parts_) else np.zeros(len(before), dtype=np.int64)
            kind = np.where(before == start_part, START_CLASS, kind)
            n = count[own][pair[own]]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(s)]), pa.array([bits]), pa.array([np.packbits(data, bitorder="little").tobytes()]), pa.array([int((n == 1).sum())]), pa.array([int((n == 2).sum())]),
                pa.array([np.bincount(kind, minlength=CLASSES).tolist()], type=pa.list_(pa.int64()))], ["section", "bits", "data", "ones", "twos", "types"])

    schema = "section long, pair boolean, keys binary, counts binary"
    dealt = body.mapInArrow(pairs, schema).unionByName(counts.mapInArrow(keyed, schema)).repartition(parts(spark), "section")
    sections = settle(dealt.mapInArrow(built, "section long, bits long, data binary, ones long, twos long, types array<long>"), "filter")
    about = sections.select("section", "bits", "ones", "twos", "types").collect()  # a few numbers for each section
    ones, twos = sum(r.ones for r in about), sum(r.twos for r in about)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    types = np.sum([r.types for r in about], axis=0) if about else np.zeros(CLASSES)
    rest = np.minimum(1.0, discount * types / np.maximum(mass, 1.0))
    segments: list[list[int]] = [[]]
    size = 0
    for r in sorted(about, key=lambda r: r.section):
        if size + r.bits // 8 > SEGMENT_BYTES and segments[-1]:
            segments.append([])
            size = 0
        segments[-1].append(r.section)
        size += r.bits // 8
    return Model(counts, tokens, vocabulary, texts, hot, rest, discount, sections, segments, n_sections)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row.

    ``base_score``: log10 of add-one unigram probabilities from exact counts. ``score``: log10 of the interpolated pair
    model with absolute discounting; counts come from probes of the filter, one broadcast part of it after the other.
    A null or empty text is its end alone. Repeated rows are scored each.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t"), F.lit(None).cast("binary").alias("w"), F.lit(None).cast("binary").alias("p"))
    for i in range(len(model.segments) - 1):
        rows = settle(rows.mapInArrow(_prober(model, model.segment(i)), f"d {kind}, t binary, w binary, p binary"), "probes")
    scored = settle(rows.mapInArrow(_scorer(model, model.segment(len(model.segments) - 1)),
                                    f"r long, d {kind}, n_tokens long, hot_known long, hot_score double, score double, cold array<struct<word:binary,n:long>>"), "scores")
    floor = F.lit(float(np.log10(max(model.tokens + model.vocabulary + 1, 1))))
    cold = scored.select("r", F.explode("cold").alias("c")).select("r", "c.word", "c.n")
    known = model.counts.select("word", F.col("n").alias("_c"))
    sums = cold.join(known, "word", "left").groupBy("r").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("_c", F.lit(0)) + F.lit(1.0)) - floor)).alias("_s"), F.sum(F.when(F.col("_c") > 0, F.col("n")).otherwise(0)).alias("_k"))
    return scored.drop("cold").join(sums, "r", "left").select(
        F.col("d").alias(doc_id), "n_tokens", (F.col("hot_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        (F.col("hot_score") + F.coalesce("_s", F.lit(0.0))).alias("base_score"), "score")


def _levels(words: list[bytes], at: np.ndarray, counts: np.ndarray, rare: np.ndarray, sections: int, filter_: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the words that are ``rare`` (0 for the others, whose counts are exact) and of all pairs; ``at`` is the number of each token's word."""
    h = WORD_HASHES.of(words)
    own = np.zeros(len(words), dtype=np.uint8)
    own[rare] = levels_of(word_key(h[rare]), sections, filter_)
    h = h[at]
    pairs, place = np.unique(pair_key(neighbours(h, counts), h), return_inverse=True)
    return own[at], levels_of(pairs, sections, filter_)[place]


def _exact(words: list[bytes], hot: dict[bytes, int]) -> np.ndarray:
    """Counts of frequent words, -1 for others."""
    return np.fromiter(map(hot.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def _merged(part: pa.RecordBatch, now: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Levels found in this part of the filter together with those of the parts before; an n-gram is in one part only."""
    return tuple(np.maximum(new, np.frombuffer(b"".join(old), dtype=np.uint8)) if (old := part.column(c).to_pylist()) and old[0] is not None else new
                 for c, new in zip("wp", now))


def _prober(model: Model, filter_: Broadcast):
    sections, hot = model.n_sections, model.hot

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found, at, counts = word_codes(part.column("t"), end=True)
                found = as_list(found)
                rare = _exact(found, hot.value) < 0
                words, pairs = _merged(part, _levels(found, at, counts, rare, sections, filter_.value))
                ends = np.cumsum(counts)
                cut = lambda a: pa.array([a[e - n:e].tobytes() for e, n in zip(ends, counts)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), cut(words), cut(pairs)], ["d", "t", "w", "p"])

    return probed


def _scorer(model: Model, filter_: Broadcast):
    sections, n, v, texts, rest, discount, hot = model.n_sections, model.tokens, model.vocabulary, model.texts, model.rest, model.discount, model.hot

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, row = hot.value, TaskContext.get().partitionId() << 40
        floor = np.log10(max(n + v + 1, 1))
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                found, at, counts = word_codes(part.column("t"), end=True)
                words = as_list(found)
                count = _exact(words, exact)
                word, pair = _merged(part, _levels(words, at, counts, count < 0, sections, filter_.value))
                count = count[at]
                known, ends = count >= 0, np.cumsum(counts)
                first = ends - counts
                base = np.where(known, np.log10(np.maximum(count, 0) + 1.0) - floor, 0.0)
                # the context of each token: its exact count if frequent, else the filter's; the text start has as many as texts
                estimate = np.where(known, count, MEANS[word])
                kind = np.where(known, np.minimum(level(count), START_CLASS - 1), 0)
                before, before_kind = np.empty(len(at)), np.empty(len(at), dtype=np.int64)
                before[1:], before_kind[1:] = estimate[:-1], kind[:-1]
                before[first], before_kind[first] = texts, START_CLASS
                alone = (estimate + 1.0) / max(n + v + 1, 1)
                seen = np.minimum(MEANS[pair], before)
                mixed_p = np.where(before > 0, np.maximum(seen - discount, 0) / np.maximum(before, 1) + rest[before_kind] * alone, alone)
                logs = np.log10(np.maximum(mixed_p, 1e-300))
                cold_at = np.flatnonzero(~known)
                cold, n_cold = np.unique(np.searchsorted(ends, cold_at, side="right") * len(words) + at[cold_at], return_counts=True)
                cold_rows = np.searchsorted(cold, np.arange(len(counts) + 1) * len(words)).astype(np.int32)
                cold_words = pa.StructArray.from_arrays([found.take(pa.array(cold % max(len(words), 1))), pa.array(n_cold)], ["word", "n"])
                k = len(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + k)), part.column("d"), pa.array(counts), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(logs, first)),
                    pa.ListArray.from_arrays(pa.array(cold_rows), cold_words)],
                    ["r", "d", "n_tokens", "hot_known", "hot_score", "score", "cold"])
                row += k

    return scored
