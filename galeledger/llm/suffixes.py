"""Repeated byte strings: suffixes named at a difference cover, then sorted one bucket at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import mixed, parts, ready, slices as sliced

SPAN = 400  # bytes of a string that may not occur twice
WIDTH = 2  # parameter of the cover
SLICE = 4 << 20  # bytes of texts that are handled together
UNIT = 4 << 20  # places whose names are sorted together within a task
WINDOW = 1 << 20  # bytes that are hashed together
BUCKET = 1 << 20  # names of a bucket on average, at most
FILE_SLICES = 2  # slices of a file: a writer holds 100 rows before it looks at their size, and a reader's batch is a whole file of them
FEW_MB = 64  # marks that are broadcast; more are joined by shuffle
STEP = 6364136223846793005  # odd base of the hash polynomial


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Period v and places below it such that any two numbers reach places together by adding one number below v."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


PERIOD, COVER = difference_cover(WIDTH)
CORE = SPAN - PERIOD + 1  # a string of SPAN bytes holds so many from each of its first PERIOD places


def kept(df: DataFrame, label: str, most: int = 0) -> DataFrame:
    """``df`` written to the shared folder, densely packed, with at most ``most`` rows a file (0: any number), and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    grow = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(WINDOW + SPAN, x, dtype=np.uint64)]))
    return grow(STEP), grow(pow(STEP, -1, 1 << 64))


def eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    n = len(x) - 7
    out = np.empty(max(0, n), dtype=np.uint64)
    for k in range(min(8, max(0, n))):
        out[k::8] = np.frombuffer(x.data, dtype="<u8", count=(n - k + 7) // 8, offset=k)
    return out


def names(body: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the ``length`` bytes from each of the ascending places on: equal strings, equal names."""
    up, down = powers()
    out = np.empty(len(places), dtype=np.uint64)
    i = 0
    while i < len(places):
        a = int(places[i])
        j = int(np.searchsorted(places, a + WINDOW))
        grams = eights(body[a:int(places[j - 1]) + length])
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(grams) * up[:len(grams)])])
        p = places[i:j] - a
        out[i:j] = mixed((total[p + length - 7] - total[p]) * down[p])
        i = j
    return out


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after the other."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def covered(sizes: np.ndarray) -> np.ndarray:
    """Places of the cover in consecutive texts, counted from the start of each, from which CORE bytes follow; none in texts under SPAN bytes."""
    starts = np.cumsum(sizes) - sizes
    long = sizes >= SPAN
    starts, last = starts[long], sizes[long] - CORE
    blocks = last // PERIOD + 1
    at = ranges(np.zeros_like(blocks), blocks)[:, None] * PERIOD + COVER
    return (np.repeat(starts, blocks)[:, None] + at)[at <= np.repeat(last, blocks)[:, None]]


def _bits(total: int) -> int:
    """log2 of the number of buckets, so that a bucket has about BUCKET names."""
    return max(8, math.ceil(math.log2(max(1, total) / BUCKET)))


def _short(named: np.ndarray, bits: int, size: int) -> np.ndarray:
    return named >> np.uint64(max(0, 64 - bits - 8 * size))


def _blobs(named: np.ndarray, bits: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its distinct names in rising order and which of them occur twice here)."""
    values, counts = np.unique(_short(named, bits, size), return_counts=True)
    bucket = values >> np.uint64(min(64, bits + 8 * size) - bits)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, dtype=np.int64)
    payload = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(bucket[a]), payload[a:b].tobytes() + np.packbits(counts[a:b] > 1).tobytes()


def _names_of(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) * 8 // (8 * size + 1)  # n names and n bits, filled up to a byte
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(blob, dtype=np.uint8, count=n * size).reshape(n, size)
    return wide.view(np.uint64).ravel(), np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=n * size), count=n).astype(bool)


def repeated(blobs: DataFrame, size: int) -> DataFrame:
    """(sid, marks) for slices with a name that occurs twice or more anywhere; marks: unit, bucket and bits of its names.

    Buckets are sorted one at a time. A slice sends a name once, however often it occurs there, so copies do not pile up.
    """
    spark = blobs.sparkSession
    dealt = blobs.repartition(parts(spark), "bucket").sortWithinPartitions("bucket")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list) -> pa.RecordBatch:
            read = [_names_of(blob, size) for _, _, blob in rows]
            every = np.sort(np.concatenate([v for v, _ in read]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for (sid, unit, _), (v, twin) in zip(rows, read):
                at = np.searchsorted(twice, v)
                flags = twin | (twice[np.minimum(at, len(twice) - 1)] == v if len(twice) else False)
                if flags.any():
                    out.append((sid, unit, np.packbits(flags).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in out], pa.int64()), pa.array([u for _, u, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int64()),
                                               pa.array([x for *_, x in out], pa.binary())], ["sid", "unit", "bucket", "bits"])

        now, held = None, []
        for batch in batches:
            for sid, unit, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("sid", "unit", "bucket", "blob"))):
                if bucket != now and held:
                    yield found(now, held)
                    held = []
                now = bucket
                held.append((sid, unit, blob))
        if held:
            yield found(now, held)

    flags = kept(dealt.mapInArrow(judged, "sid long, unit int, bucket long, bits binary"), "marks")
    return flags.groupBy("sid").agg(F.collect_list(F.struct("unit", "bucket", "bits")).alias("marks"))


def with_marks(slices: DataFrame, marks: DataFrame) -> DataFrame:
    """Slices with their marks; the marks are broadcast only where few."""
    mb = marks.agg(F.sum(F.aggregate("marks", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["bits"]) + 16))).first()[0] or 0
    return slices.join(F.broadcast(marks) if mb <= FEW_MB << 20 else marks, "sid", "left")


def marked(named: np.ndarray, unit: int, marks: list | None, bits: int, size: int) -> np.ndarray:
    """Which of a unit's names are marked as repeated."""
    own = {m["bucket"]: m["bits"] for m in marks or () if m["unit"] == unit}
    if not own:
        return np.zeros(len(named), dtype=bool)
    short = _short(named, bits, size)
    values = np.unique(short)
    bucket = values >> np.uint64(min(64, bits + 8 * size) - bits)
    good = np.zeros(len(values), dtype=bool)
    for b, packed in own.items():
        lo, hi = np.searchsorted(bucket, np.array([b, b + 1], dtype=np.uint64))
        good[lo:hi] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=hi - lo).astype(bool)
    values = values[good]
    at = np.searchsorted(values, short)
    return values[np.minimum(at, len(values) - 1)] == short if len(values) else np.zeros(len(named), dtype=bool)


def _units(places: np.ndarray) -> Iterator[tuple[int, slice]]:
    for k, a in enumerate(range(0, len(places), UNIT)):
        yield k, slice(a, a + UNIT)


def _sent(slices: DataFrame, places, length: int, bits: int, size: int) -> DataFrame:
    """Blobs of the names of the ``places`` of every slice."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body = np.frombuffer(row.column("body")[0].as_buffer(), dtype=np.uint8)
                at = places(row)
                for unit, part in _units(at):
                    got = list(_blobs(names(body, at[part], length), bits, size))
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([pa.array([row.column("sid")[0].as_py()] * n, pa.int64()), pa.array([unit] * n, pa.int32()), pa.array([b for b, _ in got], pa.int64()),
                                                      pa.array([x for _, x in got], pa.binary())], ["sid", "unit", "bucket", "blob"])

    return slices.mapInArrow(cut, "sid long, unit int, bucket long, blob binary")


def _sizes(row: pa.RecordBatch) -> np.ndarray:
    return row.column("sizes")[0].values.to_numpy().astype(np.int64)


def _candidates(row: pa.RecordBatch) -> np.ndarray:
    runs = row.column("runs")[0].values.to_numpy().astype(np.int64).reshape(-1, 2)
    return ranges(runs[:, 0], runs[:, 1])


def gathered(docs: DataFrame, kind: str, more: bool) -> DataFrame:
    """Slices (sid, ids, sizes, body) of consecutive rows of (d, body); with ``more``, their runs of places as well, counted in the slice."""
    schema = f"sid long, ids array<{kind}>, sizes array<long>, runs array<long>, body binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ids, bodies, runs, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            every = pa.concat_arrays(ids)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), lists(every), lists(pa.array([len(b) for b in bodies], pa.int64())), lists(pa.array(runs, pa.int64())),
                                               pa.array([b"".join(bodies)], pa.binary())], ["sid", "ids", "sizes", "runs", "body"])

        for batch in batches:
            for part in sliced(batch, "body"):
                own = part.column("body").to_pylist()
                ids.append(part.column("d"))
                for i, b in enumerate(own):
                    if more:
                        runs += [x + size for x in part.column("runs")[i].as_py()]
                    bodies.append(b or b"")
                    size += len(b or b"")
                if size >= SLICE:
                    yield out()
                    n, ids, bodies, runs, size = n + 1, [], [], [], 0
        if bodies:
            yield out()

    return docs.mapInArrow(cut, schema)


def _digest(body: bytes, again: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the hash of what is left, from the starts of repeated strings."""
    edge = np.zeros(len(body) + 1, dtype=np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    left = np.frombuffer(body, dtype=np.uint8)[~gone]
    return int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)), hashlib.sha256(left.tobytes()).hexdigest()


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row: what is left of its text's bytes without those in a 400-byte string that also starts anywhere else.

    Null texts count as empty; texts under 400 bytes lose nothing; rows of equal text take everything of 400 bytes or more from each other; a null id stays; other columns are ignored.

    Of any two equal strings at least one pair of places is in the difference cover, at the same distance from their starts. So the strings of CORE bytes at the cover's places are
    named and sorted by buckets; only suffixes that begin in front of a repeated name are candidates. Texts with candidates are put beside those with the same least name, candidates are named over 400
    bytes and sorted by buckets as well. Names have 64 bits: a string is taken for repeated by mistake with a chance of its number of candidates in 2^64. Only their equality counts, so
    their order need not be that of the bytes. A task holds a slice of texts, or one longer text, and one bucket or unit of names.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    all_docs = kept(gathered(docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("body")), kind, False), "slices", FILE_SLICES).drop("runs")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    bits = _bits((all_docs.agg(F.sum(size)).first()[0] or 0) * len(COVER) // PERIOD)
    first, last = 5, 7  # bytes of a name beside its bucket

    marks = repeated(_sent(all_docs, lambda row: covered(_sizes(row)), CORE, bits, first), first)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body, sizes, own = row.column("body")[0].as_py(), _sizes(row), row.column("marks")[0].as_py()
                data = np.frombuffer(body, dtype=np.uint8)
                ends = np.cumsum(sizes)
                at = covered(sizes) if own else np.zeros(0, dtype=np.int64)
                hits, least = [], []
                for unit, part in _units(at):
                    named = names(data, at[part], CORE)
                    flags = marked(named, unit, own, bits, first)
                    hits.append(at[part][flags])
                    least.append(named[flags])
                hits, least = np.concatenate([np.zeros(0, dtype=np.int64), *hits]), np.concatenate([np.zeros(0, dtype=np.uint64), *least])
                cuts = np.searchsorted(hits, np.concatenate([[0], ends]))
                out = []
                for k, (a, b, e, n) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends.tolist(), sizes.tolist())):
                    own_body = body[e - n:e]
                    low = np.maximum(hits[a:b] - (e - n) - PERIOD + 1, 0)
                    high = np.minimum(hits[a:b] - (e - n), n - SPAN) + 1
                    low, high = low[low < high], high[low < high]
                    if len(low):
                        fresh = np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1]])
                        runs = np.stack([low[fresh], np.maximum.reduceat(high, np.flatnonzero(fresh))], axis=1).ravel().tolist()
                        out.append((n, None, None, None, int(least[a:b].min().view(np.int64)), own_body, runs))
                    else:
                        out.append((n, 0, 0, hashlib.sha256(own_body).hexdigest(), None, None, None))
                ids = row.column("ids")[0].values
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[c] for x in out], t) for c, t in enumerate(kinds))], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "near", "body", "runs"])

    result = f"d {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    parted = kept(with_marks(all_docs, marks).mapInArrow(split, f"{result}, near long, body binary, runs array<long>"), "candidates")
    columns = ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    whole = parted.where("near is null").select(*columns)

    order = ["near", F.xxhash64("body"), F.xxhash64("d")]
    close = parted.where("near is not null").select("d", "body", "runs", "near").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    near = kept(gathered(close.select("d", "body", "runs"), kind, True), "neighbours", FILE_SLICES)
    steps = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: x - n)  # sum of the upper less the lower ends
    bits = _bits(near.agg(F.sum(steps)).first()[0] or 0)
    again = repeated(_sent(near, _candidates, SPAN, bits, last), last)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body, ends, sizes, own = row.column("body")[0].as_py(), np.cumsum(_sizes(row)), _sizes(row), row.column("marks")[0].as_py()
                at = _candidates(row) if own else np.zeros(0, dtype=np.int64)
                data = np.frombuffer(body, dtype=np.uint8)
                hits = np.concatenate([np.zeros(0, dtype=np.int64), *(at[part][marked(names(data, at[part], SPAN), unit, own, bits, last)] for unit, part in _units(at))])
                cuts = np.searchsorted(hits, np.concatenate([[0], ends]))
                out = [(n, *_digest(body[e - n:e], hits[a:b] - (e - n))) for a, b, e, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([row.column("ids")[0].values, *(pa.array([x[c] for x in out], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()]))], columns)

    return whole.unionByName(with_marks(near, again).mapInArrow(finished, result)).withColumnRenamed("d", doc_id)
