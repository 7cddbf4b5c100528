"""Repeated paragraphs by MinHash banding, verified by exact Jaccard similarity, one class per component; passages of other bounds beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import WORD_HASHES, mixed, ready, shingle_hashes, slices
from .graph import components, linked
from .passages import passages

SHINGLE = 5
SIMILARITY = 0.8
LEAST_WORDS = 40
# Tuning of the bands: recall wanted at the similarity, and most hashes of a signature.
RECALL, HASHES = 0.99, 40


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows per band: of those that catch a pair at ``similarity`` with probability ``recall``, the ones that
    let the fewest dissimilar pairs through (area below the similarity)."""
    grid = np.linspace(0, similarity, 50)
    best = None
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity ** rows) ** bands >= recall:
                area = (1 - (1 - grid ** rows) ** bands).mean()
                if best is None or area < best[0]:
                    best = area, bands, rows
                break
    if best is None:
        raise ValueError("no bands reach the recall with so few hashes")
    return best[1], best[2]


def buckets(h: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket number of every text and band: hash of the band's minima of the shingles (``h``, ``n`` for each text, none empty)."""
    first = np.cumsum(n) - n
    rng = np.random.default_rng(7)
    a, b = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    out = np.empty((len(n), bands), dtype=np.uint64)
    for i in range(bands):
        key = np.full(len(n), i, dtype=np.uint64)
        for j in range(i * rows, (i + 1) * rows):
            low = np.minimum.reduceat((h * a[j] + b[j]) >> np.uint64(20), first)
            key = mixed(key * np.uint64(3) + low)
        out[:, i] = key
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; short arrays sort faster than ``np.unique`` hashes them."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def paragraphs(docs: DataFrame, doc_id: str, text: str, least_words: int = LEAST_WORDS, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Every line with ``least_words`` or more words: doc_id, para (line number from 0), start, end (code points), n_words, h (XXH64
    of its words, A-Z lower-cased), buckets, shingles (sorted distinct 32-bit hashes)."""
    ready(docs.sparkSession)
    bands, rows = tuned(similarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                at, words, counts, ids = [], [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    start = 0
                    for k, line in enumerate((text or "").split("\n")):
                        found = line.encode().lower().split() if len(line) >= 2 * least_words - 1 else ()
                        if len(found) >= least_words:
                            at.append((i, k, start, start + len(line)))
                            words += found
                            counts.append(len(found))
                            ids.append(xxhash.xxh64_intdigest(b" ".join(found), 42))
                        start += len(line) + 1
                if not at:
                    continue
                size = np.array(counts)
                h, n = shingle_hashes(WORD_HASHES.of(words), np.cumsum(size) - size, size, shingle)
                keys = buckets(h, n, bands, rows)
                ends = np.cumsum(n)
                halves = (h >> np.uint64(32)).astype(np.uint32)
                sets = [distinct(halves[e - k:e]).tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                place = np.array(at)
                yield pa.RecordBatch.from_arrays([
                    part.column("d").take(pa.array(place[:, 0])), *(pa.array(place[:, c]) for c in (1, 2, 3)), pa.array(size), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), type=pa.int32()), pa.array(keys.ravel().view(np.int64))), pa.array(sets, type=pa.binary())],
                    ["d", "para", "start", "end", "n_words", "h", "buckets", "shingles"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(
        cut, f"d {kind}, para long, start long, end long, n_words long, h long, buckets array<long>, shingles binary").withColumnRenamed("d", doc_id)


def alike(similarity: float):
    """Link test of a block: pairs of shingle sets with a Jaccard similarity of at least ``similarity``."""
    def links(ids: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint32) for s in columns[0]]
        size = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            ok = ids[0] != ids[1] and both >= similarity * (size.sum() - both)
            return (np.array([0]), np.array([1])) if ok else (np.empty(0, dtype=int),) * 2
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(at, minlength=len(values)) > 1  # a shingle of one set alone is in no intersection
        rank = np.cumsum(shared) - 1
        keep = shared[at]
        owner, column = owner[keep], rank[at[keep]]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for s in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [s, s + 4096])
            m = np.zeros((len(sets), 4096), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - s] = 1
            both += m @ m.T
        ok = np.triu(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-3, 1)
        x, y = np.nonzero(ok)
        apart = ids[x] != ids[y]
        return x[apart], y[apart]

    return links


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, para, start, end, n_words, class_doc, class_para, class_size, removed) of every paragraph that has a copy or a near copy.

    Paragraphs are lines of ``least_words`` or more words. Equal ones share a hash of 64 bits and are searched once; different ones
    that collide in a band are joined if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more. A class is a connected
    component, named by its first paragraph (smallest doc_id, then line); all others are ``removed``. Null and empty texts have no paragraphs.
    """
    found = settle(paragraphs(docs, doc_id, text, least_words, shingle, similarity), "paragraphs")
    own = settle(found.groupBy("h").agg(F.min(F.struct(F.col(doc_id).alias("doc"), "para")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    keyed = found.select(F.explode("buckets").alias("bucket"), F.col("h").alias("id")).distinct()
    sets = found.groupBy("h").agg(F.max("shingles").alias("shingles")).withColumnRenamed("h", "id")
    edges = linked(keyed, ["bucket"], ["shingles"], alike(similarity), block=128, more=sets)
    roots = components(edges, thin=False)
    joined = own.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h"))
    classes = joined.groupBy("root").agg(F.min("first").alias("class"), F.sum("n").alias("class_size")).where("class_size > 1")
    named = settle(joined.select("h", "root").join(classes, "root").select("h", "class", "class_size"), "classes")
    out = found.drop("buckets", "shingles").join(named, "h")
    first = F.col(doc_id).eqNullSafe(F.col("class.doc")) & (F.col("para") == F.col("class.para"))
    return out.select(doc_id, "para", "start", "end", "n_words", F.col("class.doc").alias("class_doc"), F.col("class.para").alias("class_para"), "class_size", (~first).alias("removed"))


def repeated_anywhere(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``repeated`` and, with ``unit`` "passage" for "line", the ``passages`` that whole lines do not hold: (doc_id, para, start, end, n_words,
    class_doc, class_para, class_size, removed, unit, class_start). A class of passages is left out if all its places lie in lines of one class."""
    lines = settle(repeated(docs, doc_id, text), "lines")
    found = settle(passages(docs, doc_id, text), "passages")
    key = ["class_doc", "class_para", "class_start"]
    inside = lines.select(F.col(doc_id).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.struct("class_doc", "class_para").alias("_c"))
    held = found.join(inside, F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left")
    known = held.groupBy(*key).agg(F.bool_and(F.col("_c").isNotNull()).alias("all"), F.min("_c").alias("low"), F.max("_c").alias("high")).where("all and low = high")
    known = known.select(*(F.col(k).alias(f"_{k}") for k in key))
    other = found.join(known, F.col("class_doc").eqNullSafe(F.col("_class_doc")) & (F.col("class_para") == F.col("_class_para")) & (F.col("class_start") == F.col("_class_start")), "left_anti")
    first = lines.where("not removed").select(F.col("class_doc").alias("_d"), F.col("class_para").alias("_p"), F.col("start").alias("class_start")).dropDuplicates(["_d", "_p"])
    named = lines.join(first, F.col("class_doc").eqNullSafe(F.col("_d")) & (F.col("class_para") == F.col("_p")), "left").drop("_d", "_p").withColumn("unit", F.lit("line"))
    return named.unionByName(other.withColumn("unit", F.lit("passage"))).select(
        doc_id, "para", "start", "end", "n_words", "class_doc", "class_para", "class_size", "removed", "unit", "class_start")
