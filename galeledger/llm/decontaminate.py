"""Benchmark decontamination by latent semantic retrieval, verified by common subsequences and answers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import parts, ready, slices

# A-Z to a-z, ASCII punctuation and white space to blanks; all other bytes stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RANK, ITEMS_A_DIMENSION = 64, 16  # latent dimensions at least, and items of a block for each beyond
HALF = 16  # a window has two halves of this many words
COSINE = 0.4  # least cosine of a candidate
SHARE, SHARE_WITH_ANSWER = 0.8, 0.6  # least part of an item's words in common order
BLOCK_WORDS = 1 << 17  # most words of the items that are searched in one pass


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def answer_of(text: str, answer: str | None) -> list[bytes]:
    """Words of the answer: as given, else the item's last sentence."""
    if answer is None:
        ends = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
        answer = ends[-1] if ends else ""
    return words_of(answer.encode())


def places_of(words: list) -> dict:
    """Bits of the places of each word."""
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from ``begin`` on, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def common_order(a: list, b: list) -> list[int]:
    """Places in ``b`` of a longest common subsequence, ascending; words that only one has are left out first."""
    both = set(a) & set(b)
    a, at = [x for x in a if x in both], [j for j, y in enumerate(b) if y in both]
    b = [b[j] for j in at]
    masks = places_of(a)
    full = (1 << len(a)) - 1
    v, after = full, [full]  # a bit that is 0 in after[j]: a[i] makes the common subsequence with b[:j] longer
    for y in b:
        u = v & masks[y]
        v = ((v + u) | (v - u)) & full
        after.append(v)
    common = lambda i, j: i - (after[j] & ((1 << i) - 1)).bit_count()
    i, j, used = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            used.append(at[j - 1])
            i, j = i - 1, j - 1
        elif common(i - 1, j) >= common(i, j - 1):
            i -= 1
        else:
            j -= 1
    return used[::-1]


def compact(places: list[int], most: int) -> list[int]:
    """``places`` without the outer ones that stretch over more than ``most`` words; the wider gap goes first."""
    lo, hi = 0, len(places)
    while hi - lo > 1 and places[hi - 1] - places[lo] + 1 > most:
        if places[lo + 1] - places[lo] >= places[hi - 1] - places[hi - 2]:
            lo += 1
        else:
            hi -= 1
    return places[lo:hi]


def common_length(masks: dict[int, int], n: int, b: list[int]) -> int:
    """Length alone of the longest common subsequence, by the bits of one integer; ``masks`` has the places of each word."""
    full = (1 << n) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Items:
    """One block of benchmark items and its latent space; what workers get."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[bytes, int]
    basis: np.ndarray | None = None  # words x rank, times inverse document frequency
    latent: np.ndarray | None = None  # items x rank, unit length


def _blocks(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> Iterator[Items]:
    """The items, block after block; the driver never holds more than a block and a partition of them."""
    block, size = None, 0
    columns = [F.col(item_id).alias("i"), F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")]
    for row in benchmark.select(*columns).orderBy("i", "t").toLocalIterator():
        words = words_of((row.t or "").encode())
        if not words:
            continue
        if block is None or size + len(words) > BLOCK_WORDS and block.ids:
            if block is not None:
                yield block
            block, size = Items([], [], [], {}), 0
        number = lambda w: block.vocabulary.setdefault(w, len(block.vocabulary))
        block.ids.append(row.i)
        block.words.append([number(w) for w in words])
        block.answers.append([number(w) for w in answer_of(row.t, row.a)])
        size += len(words)
    if block is not None:
        yield block


def _document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many texts of the corpus each word of the block occurs, and the number of texts. Sums of one row per word and task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen, known = np.zeros(len(own) + 1, dtype=np.int64), own.keys()
        for batch in batches:
            for part in slices(batch, "t"):
                for text in part.column("t").to_pylist():
                    seen[[own[w] for w in known & set(words_of(text))]] += 1
            seen[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["w", "n"])

    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for w, n in docs.select("t").mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        out[w] = n
    return out[:-1], int(out[-1])


def _subspace(spark: SparkSession, items: Items, idf: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Right singular basis (words x rank) of the block's TF-IDF matrix A by randomised subspace iteration.

    Each round maps the items over the tasks: a task sums a (a' M) over its rows a, the partial products are added by
    word range in a shuffle, and the thin product A'A M comes back to be made orthonormal. M starts as Gaussian.
    """
    n, rank = len(idf), min(len(items.ids), max(RANK, len(items.ids) // ITEMS_A_DIMENSION))
    weighted = [(at := np.array(sorted(c)), np.array([c[w] for w in at.tolist()]) * idf[at]) for c in map(Counter, items.words)]
    shape = pa.table({"at": pa.array([a.astype(np.int64).tobytes() for a, _ in weighted], type=pa.binary()),
                      "v": pa.array([(v / max(np.linalg.norm(v), 1e-12)).tobytes() for _, v in weighted], type=pa.binary())})
    rows = spark.createDataFrame(shape).repartition(min(parts(spark), max(1, shape.num_rows // 64)))
    m = np.random.default_rng(11).standard_normal((n, rank))
    step = 4096
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(m)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(shared.value)
            for batch in batches:
                for a, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist()):
                    at, value = np.frombuffer(a, dtype=np.int64), np.frombuffer(v)
                    out[at] += value[:, None] * (value @ shared.value[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, n, step)), pa.array([out[s:s + step].tobytes() for s in range(0, n, step)], type=pa.binary())], ["s", "p"])

        def added(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p, dtype=np.float64) for p in table.column("p").to_pylist())
            return pa.table({"s": pa.array([key[0].as_py()]), "p": pa.array([total.tobytes()], type=pa.binary())})

        product_rows = rows.mapInArrow(product, "s long, p binary").groupBy("s").applyInArrow(added, "s long, p binary")
        whole = np.zeros((n, rank))
        for s, p in product_rows.collect():
            whole[s:s + step] = np.frombuffer(p, dtype=np.float64).reshape(-1, rank)
        m = np.linalg.qr(whole)[0]
        shared.unpersist()
    return m


def _prepared(docs: DataFrame, items: Items) -> Items:
    df, texts = _document_frequency(docs, items.vocabulary)
    idf = np.log((texts + 1) / (df + 1)) + 1e-3
    basis = _subspace(docs.sparkSession, items, idf)
    items.basis = (basis * idf[:, None]).astype(np.float32)
    latent = np.stack([items.basis[w].sum(axis=0) for w in items.words])
    items.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return items


class Finder:
    """Searches texts for one block's items."""

    def __init__(self, items: Items, cosine: float = COSINE):
        self.items, self.cosine = items, cosine
        self.masks = [places_of(words) for words in items.words]
        self.longest = max(map(len, items.words))
        self.size = np.array([len(words) for words in items.words])
        self.bag_size = np.array([len(own) for own in self.masks])
        self.bag_begin = np.cumsum(self.bag_size) - self.bag_size
        self.bags = np.array([w for own in self.masks for w in own])

    def complete(self, inside: np.ndarray, upto: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which candidates have enough of their item's words, in any order, in the words lo to hi. ``inside``: the vocabulary
        numbers of the words that have one; ``upto``: how many of them stand in front of each word."""
        out = np.empty(len(lo), dtype=bool)
        fresh = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(lo) else out
        first = np.append(np.flatnonzero(fresh), len(lo))
        # bounded gathers
        step = max(1, min(1024, (1 << 23) // len(self.items.vocabulary), (1 << 20) // (self.longest + HALF)))
        some = max(1, (1 << 19) // int(self.bag_size.max()))
        for s in range(0, len(first) - 1, step):
            own = first[s:s + step + 1]
            begin = upto[lo[own[:-1]]]
            size = upto[hi[own[:-1]]] - begin
            seen = np.zeros((len(size), len(self.items.vocabulary)), dtype=bool)
            seen[np.repeat(np.arange(len(size)), size), inside[ranges(begin, size)]] = True
            row = np.repeat(np.arange(len(size)), np.diff(own))
            for x in range(own[0], own[-1], some):
                at = item[x:min(x + some, own[-1])]
                n = self.bag_size[at]
                there = seen[np.repeat(row[x - own[0]:x - own[0] + len(at)], n), self.bags[ranges(self.bag_begin[at], n)]]
                out[x:x + len(at)] = n - np.add.reduceat(there, np.cumsum(n) - n, dtype=np.int64) <= (1 - SHARE_WITH_ANSWER) * self.size[at]
        return out

    def candidates(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, item and cosine of all windows near an item. ``words``: vocabulary numbers, -1 for others."""
        halves = -(-counts // HALF)
        base, begin = np.cumsum(halves) - halves, np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(counts)), counts)
        segment = base[text] + (np.arange(len(words)) - begin[text]) // HALF
        inside = words >= 0
        sums = np.zeros((int(halves.sum()) + 1, self.items.basis.shape[1]), dtype=np.float32)
        own = segment[inside]
        if not len(own):
            return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0),)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        numbers = words[inside]
        for s in range(0, len(first), 8192):  # bounded gathers
            lo, hi = first[s], first[s + 8192] if s + 8192 < len(first) else len(own)
            sums[own[first[s:s + 8192]]] = np.add.reduceat(self.items.basis[numbers[lo:hi]], first[s:s + 8192] - lo, axis=0)
        owner = np.repeat(np.arange(len(counts)), halves)
        pair = sums[:-1].copy()
        same = owner[1:] == owner[:-1]
        pair[:-1][same] += sums[1:-1][same]
        length = np.linalg.norm(pair, axis=1)
        out = []
        for s in range(0, len(pair), 16384):
            near = pair[s:s + 16384] @ self.items.latent.T
            x, i = np.nonzero(near >= self.cosine * np.maximum(length[s:s + 16384], 1e-6)[:, None])
            out.append((x + s, i, near[x, i] / length[x + s]))
        x, i, c = (np.concatenate(a) for a in zip(*out))
        return owner[x], (x - base[owner[x]]) * HALF, i, c

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, int, float, float, bool, int, int]]:
        """(text, item, cosine, share, answer found, first word, end word): the best place of every item found in a text."""
        words: list[bytes] = []
        stops = np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            words += words_of(t)
            stops[i] = len(words)
        numbers = np.fromiter(map(self.items.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        counts = np.diff(stops, prepend=0)
        best: dict[tuple[int, int], tuple] = {}
        text, start, item, cosine = self.candidates(numbers, counts)
        known, begins = numbers >= 0, stops - counts
        near = self.complete(numbers[known], np.append(0, np.cumsum(known)), begins[text] + np.maximum(0, start - self.longest),
                             begins[text] + np.minimum(counts[text], start + 2 * HALF + self.longest), item)
        for t, start, item, cosine in zip(*(a[near].tolist() for a in (text, start, item, cosine))):
            own, n, begin = self.items.words[item], len(self.items.words[item]), int(begins[t])
            lo, hi = begin + max(0, start - n), begin + min(int(counts[t]), start + 2 * HALF + n)
            region = numbers[lo:hi].tolist()
            most = common_length(self.masks[item], n, region)
            if most < SHARE_WITH_ANSWER * n:
                continue
            answer = self.items.answers[item]
            found = bool(answer) and any(region[k:k + len(answer)] == answer for k in range(len(region) - len(answer) + 1))
            if most < SHARE * n and not found:
                continue
            places = compact(common_order(own, region), 3 * n // 2 + 5)  # words in common order, but scattered, are no copy
            size, first, last = len(places), places[0], places[-1]
            if size >= SHARE * n or size >= SHARE_WITH_ANSWER * n and found:
                row = (size / n, cosine, found, lo - begin + first, lo - begin + last + 1)
                best[t, item] = max(best.get((t, item), row), row)
        return [(t, item, c, share, found, a, b) for (t, item), (share, c, found, a, b) in sorted(best.items())]


def _bodies(docs: DataFrame, text: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(text).cast("binary").alias("t"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_found, first_word, end_word): every benchmark item that a text contains.

    Items are the query set, searched block by block against all texts. TF-IDF weights come from the document frequencies of the whole
    corpus; a randomised SVD gives each block a latent space. Windows of 32 words (step 16) with a cosine of ``COSINE`` or more are candidates. One is
    a leak if the item's words are there in order, to 80 %, or to 60 % with the item's answer word for word, within one and a half times its length.
    Words are runs of letters and digits, A-Z lower-cased. Texts and items that are null or have no words match nothing; repeated rows repeat.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"d {kind}, i {item_kind}, cosine double, share double, answer_found boolean, first_word long, end_word long"
    found = None
    for items in _blocks(benchmark, item_id, item_text, answer):
        shared = spark.sparkContext.broadcast(_prepared(_bodies(docs, text), items))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                for part in slices(batch, "t"):
                    hits = finder.hits(part.column("t").to_pylist())
                    columns = list(zip(*hits)) or [()] * 7
                    yield pa.RecordBatch.from_arrays([
                        part.column("d").take(pa.array(columns[0], type=pa.int64())), pa.array([finder.items.ids[i] for i in columns[1]], type=item_type),
                        pa.array(columns[2], type=pa.float64()), pa.array(columns[3], type=pa.float64()), pa.array(columns[4], type=pa.bool_()),
                        pa.array(columns[5], type=pa.int64()), pa.array(columns[6], type=pa.int64())], ["d", "i", "cosine", "share", "answer_found", "first_word", "end_word"])

        item_type = pa.array(items.ids[:1]).type if items.ids and items.ids[0] is not None else pa.int64()
        rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t")).mapInArrow(searched, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("d", doc_id).withColumnRenamed("i", item_id)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item (see :func:`leaks`); rows pass or go where they are."""
    out = docs
    for items in _blocks(benchmark, item_id, item_text, answer):
        shared = docs.sparkSession.sparkContext.broadcast(_prepared(_bodies(docs, text), items))

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                for part in slices(batch, text):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[h[0] for h in finder.hits([t and t.encode() for t in part.column(text).to_pylist()])]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(kept, docs.schema)
    return out
