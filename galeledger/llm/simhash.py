"""SimHash near-duplicates, searched by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import WORD_HASHES, free, ready, shingle_hashes, signed, slices
from .graph import components, linked
from .paragraphs import alike, buckets, tuned

BITS = 64
# Estimated cost of sending one probe, in candidates verified.
PROBE_COST = 4.0
# Cells per part in the histogram of part values that candidate counts are estimated from.
HISTOGRAM_BITS = 14
# Most hashes of a signature in the search for near-duplicates.
NEAR_HASHES = 64


def hashes(body: bytes, words: int, distinct: bool) -> np.ndarray:
    """XXH64 values (seed 42) of a text's shingles: A-Z lower-cased, split at ASCII white space, joined by spaces. A text with
    fewer words is one shingle."""
    found = body.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    n = len(found) - k + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[s:e], 42) for s, e in zip(begins[:n].tolist(), ends[k - 1:].tolist())), dtype=np.uint64, count=n)
    return np.unique(h) if distinct else h


def majority(h: np.ndarray) -> int:
    """Fingerprint (signed) with a 1 where over half the values have one; 0 of no values."""
    ones = np.zeros(BITS, dtype=np.int64)
    for s in range(0, len(h), 1 << 16):
        piece = np.ascontiguousarray(h[s:s + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp long) of every row: the majority bits of the shingles' hashes, counted as often as they occur or, if
    ``distinct``, once. Without words (or null) the fingerprint is 0."""
    ready(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                values = [majority(hashes(body or b"", words, distinct)) for body in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(values, type=pa.int64())], ["d", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t")).mapInArrow(marked, f"d {kind}, fp long").withColumnRenamed("d", doc_id)


def grouped_bits(fps: DataFrame, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` parts of near-equal size, correlated bits together.

    Pair counts over all fingerprints are summed per task to one 64 x 64 table; a part starts at the free bit with
    the strongest correlations and takes the bits most correlated with those it has.
    """
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            b = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += b.T @ b
            n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["i", "n"])

    got = fps.select("fp").mapInArrow(counts, "i long, n double").groupBy("i").agg(F.sum("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for i, n in got:
        flat[i] = n
    total = max(flat[-1], 1.0)
    joint = flat[:-1].reshape(BITS, BITS) / total
    p = np.diag(joint)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(joint - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        own = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (strength[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fp), dtype=np.uint64)
    for i, b in enumerate(bits):
        value |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return value


def _cell(value: np.ndarray, width: int) -> np.ndarray:
    return (value >> np.uint64(max(width - HISTOGRAM_BITS, 0))).astype(np.int64)


def allocated(costs: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds (texts x parts, -1: part unused) that sum to ``budget`` and cost least.

    ``costs[x, i, t + 1]``: estimated cost of threshold t at part i. Dynamic programme over the parts:
    best[s] is the least cost of the parts so far with thresholds that sum to s.
    """
    n, m, steps = costs.shape
    low = -m
    best = np.full((n, budget - low + m + 1), np.inf)
    best[:, -low] = 0
    picks = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for t in range(-1, steps - 1):
            for s in range(best.shape[1]):
                if 0 <= s - t < best.shape[1]:
                    cost = best[:, s - t] + costs[:, i, t + 1]
                    better = cost < new[:, s]
                    new[better, s] = cost[better]
                    pick[better, s] = t
        best = new
        picks.append(pick)
    at = np.full(n, budget - low)
    out = np.zeros((n, m), dtype=np.int8)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][np.arange(n), at]
        at = at - out[:, i]
    return out


def probes(fps: DataFrame, radius: int) -> DataFrame:
    """(part, value, id, probe): every distinct fingerprint indexed under its value of each part, and its probes.

    With m parts, two fingerprints within ``radius`` agree on some part i to within t_i bits, for any thresholds
    with sum radius - m + 1 (-1: the part is skipped). Each fingerprint has its own thresholds, those of least estimated
    cost, and probes all values within t_i of its own.
    """
    m = min(radius + 1, 3)
    budget = radius - m + 1
    groups = grouped_bits(fps, m)
    cells = lambda fp: [_cell(extract(fp, g), len(g)) for g in groups]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((m, 1 << HISTOGRAM_BITS), dtype=np.int64)
        for batch in batches:
            for i, c in enumerate(cells(batch.column(0).to_numpy().view(np.uint64))):
                counts[i] += np.bincount(c, minlength=1 << HISTOGRAM_BITS)
        part, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cell), pa.array(counts[part, cell])], ["p", "c", "n"])

    counts = np.zeros((m, 1 << HISTOGRAM_BITS))  # bounded by the parameter, whatever the corpus
    for p, c, n in fps.select("fp").mapInArrow(histogram, "p long, c long, n long").groupBy("p", "c").agg(F.sum("n")).collect():
        counts[p, c] = n
    total = counts[0].sum()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                signed = whole.column(0).slice(s, 4096).to_numpy()
                fp = signed.view(np.uint64)
                costs = np.full((len(fp), m, radius + 2), np.inf)
                values = [extract(fp, g) for g in groups]
                for i, g in enumerate(groups):
                    near = counts[i, _cell(values[i], len(g))]  # all fingerprints in the cell count as candidates of the value
                    costs[:, i, 0] = 0
                    for t in range(radius + 1):
                        ball = sum(comb(len(g), r) for r in range(t + 1))
                        costs[:, i, t + 1] = near + (ball - 1) * total / 2.0 ** len(g) + PROBE_COST * ball
                got = allocated(costs, budget)
                for i, g in enumerate(groups):
                    own = got[:, i] >= 0
                    yield rows(i, values[i], signed, own)
                    for t in range(1, radius + 1):
                        use = got[:, i] >= t
                        if use.any():
                            for flipped in combinations(range(len(g)), t):
                                mask = np.uint64(sum(1 << b for b in flipped))
                                yield rows(i, values[i][use] ^ mask, signed[use], np.ones(use.sum(), dtype=bool), False)

    def rows(i: int, value: np.ndarray, ids: np.ndarray, probe: np.ndarray, indexed: bool = True) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(value.view(np.int64)), pa.array(ids), pa.array(probe), pa.array(np.full(n, indexed))],
                                          ["part", "value", "id", "probe", "indexed"])

    return fps.select("fp").mapInArrow(sent, "part long, value long, id long, probe boolean, indexed boolean")


def near_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints at ``radius`` or fewer differing bits, as a spanning set."""
    def links(ids: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        probe, indexed = columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False)
        q, x = np.flatnonzero(probe), np.flatnonzero(indexed)
        near = np.bitwise_count(ids[q].view(np.uint64)[:, None] ^ ids[x].view(np.uint64)[None, :]) <= radius
        i, j = np.nonzero(near)
        apart = ids[q[i]] != ids[x[j]]
        return q[i[apart]], x[j[apart]]

    return linked(probes(fps, radius), ["part", "value"], ["probe", "indexed"], links, block=1024)


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, distinct: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents are joined where their fingerprints differ in ``radius`` or fewer bits, through any chain;
    ``component_id`` is the smallest doc_id of the chain. Copies share a fingerprint and are searched once. Rows with a
    null id are kept and get the component's smallest id, null if it has none; repeated ids give repeated rows.
    """
    fps = settle(fingerprints(docs, doc_id, text, words, distinct), "fingerprints")
    own = settle(fps.groupBy("fp").agg(F.min(doc_id).alias("_least")), "distinct")
    return fps.join(_smallest(own, near_fingerprints(own, radius)), "fp").select(doc_id, "fp", "component_id")


def _smallest(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint."""
    joined = components(edges, thin=False).join(own, F.col("node") == F.col("fp"))
    least = joined.groupBy("root").agg(F.min("_least").alias("_all"))
    linked_fps = joined.join(least, "root").select("fp", "_all")
    return settle(own.join(linked_fps, "fp", "left").select("fp", F.coalesce("_all", "_least").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.999, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each group of near-duplicates only the first does.

    Texts are linked where the sets of their ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more. Candidates are texts whose fingerprints
    (majority bits of that set) are joined at ``radius`` or fewer differing bits, through any chain, as :func:`similar` finds them. Fingerprints of pairs near the threshold
    lie further apart, so MinHash bands add candidates: a pair at the threshold is among them with a probability of ``recall``, a closer one with a higher one.
    Every candidate is verified.
    Of each connected group the row with the smallest doc_id stays (nulls last, ties by a hash of the text); of rows alike in id and text, one. Texts
    without words are alike.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    bands, rows_each = tuned(similarity, recall, NEAR_HASHES)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found = [(body or b"").lower().split() for body in part.column("t").to_pylist()]
                size = np.array([len(x) for x in found])
                h, n = shingle_hashes(WORD_HASHES.of([w for x in found for w in x]), np.cumsum(size) - size, size, shingle)
                ends = np.cumsum(n)
                distinct = [np.unique(h[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]
                sets = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in distinct]
                marks = pa.array([majority(x) for x in distinct], type=pa.int64())
                keys = np.zeros((len(n), bands), dtype=np.uint64)  # texts without words meet in one bucket
                if len(h):
                    keys[n > 0] = buckets(h, n[n > 0], bands, rows_each)
                yield pa.RecordBatch.from_arrays([
                    part.column("d"), part.column("th"), marks, pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), type=pa.int32()), signed(keys.ravel())),
                    pa.array(sets, type=pa.binary())], ["d", "th", "fp", "buckets", "shingles"])

    rows = settle(docs.select(F.col(doc_id).alias("d"), text_hash.alias("th"), F.col(text).cast("binary").alias("t")).mapInArrow(
        described, f"d {kind}, th long, fp long, buckets array<long>, shingles binary"), "described")
    texts = settle(rows.groupBy("th").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    fps = settle(rows.select("fp").distinct(), "distinct")
    near = components(near_fingerprints(fps, radius), thin=False).withColumnRenamed("node", "fp")
    close = rows.select("fp", "th").join(near, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp")).alias("bucket"), F.col("th").alias("id"))
    candidates = rows.select(F.explode("buckets").alias("bucket"), F.col("th").alias("id")).unionByName(close).distinct()
    sets = rows.groupBy("th").agg(F.max("shingles").alias("shingles")).withColumnRenamed("th", "id")
    edges = linked(candidates, ["bucket"], ["shingles"], alike(similarity), block=128, more=sets)
    grouped = texts.join(components(edges, thin=False), F.col("th") == F.col("node"), "left").withColumn("root", F.coalesce("root", "th"))
    # min_by passes over null ids only where there are none else
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "th")).alias("best")).select("best.first", "best.th")
    own, first, th, d, t = free(docs, "_hash", "_first", "_th", "_d", "_t")
    stay = settle(stay.withColumnsRenamed({"first": first, "th": th}), "stay")
    keyed = docs.withColumn(own, text_hash)
    kept = keyed.join(stay, (F.col(own) == F.col(th)) & F.col(doc_id).eqNullSafe(F.col(first)), "left_semi").drop(own)
    again = settle(rows.groupBy("d", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("d").alias(d), F.col("th").alias(t)), "repeated-rows")
    if again.isEmpty():
        return kept
    same = F.col(doc_id).eqNullSafe(F.col(d)) & (text_hash == F.col(t))
    once = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(again, same, "left_anti").unionByName(once)
