"""Repeated passages wherever they begin and end: content-defined runs of words, verified exactly and extended to their span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import WORD_HASHES, as_list, mixed, parts, ready, signed, slices, word_codes

UNIT = 40  # words of a unit
PASSAGE = 51  # a passage of so many words always holds a selected unit
AROUND = PASSAGE - UNIT  # words beside a run in which its true end can lie
SPREAD = 2654435761  # odd, and below 2^32 so that products with word numbers fit a long
MOST_BITS = 30  # log2 of the bits of a filter at most; a full one only lets more candidates through


def over(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over x[i:i + n], by doubling; places past the end are left out."""
    out, at, step, power = None, 0, 1, x
    while n:
        if n & 1:
            moved = power[at:]
            out = moved.copy() if out is None else np.concatenate([op(out[:len(moved)], moved), out[len(moved):]])
            at += step
        n >>= 1
        if n:
            power = np.concatenate([op(power[:-step], power[step:]), power[-step:]]) if len(power) > step else power
            step *= 2
    return out


def unit_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the UNIT words from every place on; places with fewer words left hold anything."""
    pair = lambda a, b: mixed(a * np.uint64(3) + b)
    after = lambda x, n: np.concatenate([x[n:], np.zeros(min(n, len(x)), dtype=np.uint64)])
    powers = {1: mixed(words)}
    for n in (1, 2, 4, 8, 16):
        powers[2 * n] = pair(powers[n], after(powers[n], n))
    return pair(powers[32], after(powers[8], 32))


def selected(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the selected units of consecutive texts, and their hashes: of the units that begin in any AROUND + 1
    places in a row the one of the least hash, so any run of PASSAGE words selects the same ones in every text."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(words))
    h = unit_hashes(words)
    least = np.where(left >= PASSAGE, over(h, AROUND + 1, np.minimum), np.uint64(0))
    most = over(least[::-1], AROUND + 1, np.maximum)[::-1]
    at = np.flatnonzero((h == most) & (left >= UNIT) & (h > 0))
    return at, h[at]


class Places:
    """Start and end (code points) and line number of words, by their number in consecutive texts; ``start`` and ``end`` count from the first text."""

    def __init__(self, bodies: list[bytes | None]):
        size = np.array([len(x or b"") + 1 for x in bodies])
        body = b" ".join(x or b"" for x in bodies)
        b = np.frombuffer(body, dtype=np.uint8)
        dark = np.zeros(len(b) + 2, dtype=bool)
        dark[1:-1] = (b != 32) & ((b < 9) | (b > 13))
        edge = np.flatnonzero(dark[1:] != dark[:-1])
        self.first, self.last, self.breaks = edge[::2], edge[1::2], np.flatnonzero(b == 10)
        # Bytes that go on a code point: so many fewer code points than bytes.
        self.inner = None if body.isascii() else np.flatnonzero((b & 0xC0) == 0x80)
        self.base = np.cumsum(size) - size

    def points(self, at: np.ndarray) -> np.ndarray:
        return at if self.inner is None else at - np.searchsorted(self.inner, at)

    def start(self, word: np.ndarray) -> np.ndarray:
        return self.points(self.first[word])

    def end(self, word: np.ndarray) -> np.ndarray:
        return self.points(self.last[word])

    def line(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.breaks, self.first[word])

    def origin(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code point and line at which the text begins."""
        return self.points(self.base[text]), np.searchsorted(self.breaks, self.base[text])


def counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def listed(n: np.ndarray, values: np.ndarray) -> pa.Array:
    """``n`` values each, 32 bits a value, as binary."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(4 * np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(values.astype("<i4"))])


def unlisted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``listed``, filled up to AROUND each, and their numbers; none for null."""
    column = pc.fill_null(column, b"")
    n = pc.binary_length(column).to_numpy() // 4
    out = np.zeros((len(n), AROUND), dtype=np.int64)
    out[np.repeat(np.arange(len(n)), n), counted(n)] = joined_bytes(column, "<i4")
    return out, n


def moved(rows: DataFrame, n: str, contexts: tuple[str, str] | None, places: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``rows`` without their context columns, with ``n`` (how many words of the two ``contexts`` agree, nearest first; as it is if none are given) and
    ``places``: by the name, a place, the distances of the words beside it and the way (1 or -1) it moves past ``n`` of them."""
    used = {*(contexts or ()), *(x for p in places.values() for x in p[:2])}
    kept = [c for c in rows.columns if c not in used]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if contexts:
                (x, k), (y, m) = (unlisted(batch.column(c)) for c in contexts)
                alike = (x == y) & (np.arange(AROUND) < np.minimum(k, m)[:, None])
                count = np.logical_and.accumulate(alike, axis=1).sum(axis=1)
            else:
                count = batch.column(n).to_numpy()
            out = [batch.column(c) for c in kept] + ([pa.array(count.astype(np.int32))] if contexts else [])
            for place, away, way in places.values():
                far = unlisted(batch.column(away))[0][np.arange(len(count)), np.maximum(count - 1, 0)]
                out.append(pc.add(batch.column(place), pa.array(np.where(count > 0, way * far, 0).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(out, [*kept, *([n] if contexts else []), *places])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept] + [f"{n} int"] * bool(contexts) + [f"{p} long" for p in places]
    return rows.mapInArrow(cut, ", ".join(fields))


def filter_of(hashes: DataFrame, h: str = "h") -> Broadcast:
    """Bits of the hashes, at least 8 for each up to 2^MOST_BITS in all, ored together by the executors."""
    n = hashes.count()
    bits = 1 << min(MOST_BITS, max(16, int(8 * n).bit_length()))
    own = F.col(h).bitwiseAND(F.lit(bits - 1))
    got = hashes.select(F.shiftright(own, 6).alias("i"), F.expr(f"shiftleft(1L, cast({h} & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    data = np.zeros(bits >> 6, dtype=np.uint64)
    data[got.column("i").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(data)


def place(th: str, word: str) -> Column:
    """Hash of a word's place in a text."""
    return F.col(th).bitwiseXOR(F.col(word) * F.lit(SPREAD))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts and how many each text has."""
    found, at, size = word_codes(texts)
    return WORD_HASHES.of(as_list(found))[at], size


def inside(values: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Which values' bits are set in a filter."""
    low = values & np.uint64(64 * len(filter_) - 1)
    return (filter_[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def texts_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))


def units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Selected units of every text that has some: d, th (hash of the text), words (their first words' numbers, 32 bits each) and hashes (64 bits each)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words, size = word_hashes(part.column("t"))
                at, h = selected(words, size)
                last = np.cumsum(size)
                row = np.searchsorted(last, at, side="right")
                left, h = (at - (last - size)[row]).astype("<i4"), h.astype("<u8")
                first = np.flatnonzero(np.diff(row, prepend=-1))
                own = row[first]
                bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(row)]))
                yield pa.RecordBatch.from_arrays([
                    part.column("d").take(pa.array(own)), part.column("th").take(pa.array(own)), *(pa.array([a[i:j].tobytes() for i, j in bounds], type=pa.binary()) for a in (left, h))],
                    ["d", "th", "words", "hashes"])

    return texts_of(docs, doc_id, text).mapInArrow(cut, f"d {kind}, th long, words binary, hashes binary")


def joined_bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(as_list(column)), dtype=kind)


def unit_keys(packed: DataFrame) -> DataFrame:
    """(h) of every unit of every text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "hashes"):
                yield pa.RecordBatch.from_arrays([signed(joined_bytes(part.column("hashes"), "<u8"))], ["h"])

    return packed.select("hashes").mapInArrow(cut, "h long")


def units_in(packed: DataFrame, only: Broadcast) -> DataFrame:
    """(d, th, word, stop, h) of the units whose hash is in the filter; ``stop`` is the word after."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "hashes", 1 << 20):
                h, word = joined_bytes(part.column("hashes"), "<u8"), joined_bytes(part.column("words"), "<i4").astype(np.int64)
                hit = np.flatnonzero(inside(h, only.value))
                row = pa.array(np.repeat(np.arange(part.num_rows), pc.binary_length(part.column("hashes")).to_numpy() // 8)[hit])
                yield pa.RecordBatch.from_arrays([part.column("d").take(row), part.column("th").take(row), pa.array(word[hit]), pa.array(word[hit] + UNIT), signed(h[hit])], ["d", "th", "word", "stop", "h"])

    return packed.mapInArrow(cut, f"d {packed.schema['d'].dataType.simpleString()}, th long, word long, stop long, h long")


def contexts(docs: DataFrame, doc_id: str, text: str, starts: Broadcast, ends: Broadcast) -> DataFrame:
    """Words beside the selected units whose places (``place``) are in a filter: of ``starts`` those before (``left``), of ``ends`` those after.

    Columns d, th, word, left, point (start or end of the unit) and line (of its start), 32 bits of the hashes of AROUND words (nearest first), their distances in code points
    and, before the unit, in lines."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words, size = word_hashes(part.column("t"))
                at, _ = selected(words, size)
                last = np.cumsum(size)
                first, row = last - size, np.searchsorted(last, at, side="right")
                own = part.column("th").to_numpy().view(np.uint64)[row] ^ ((at - first[row]).astype(np.uint64) * np.uint64(SPREAD))
                hits = [np.flatnonzero(inside(own, f.value)) for f in (starts, ends)]
                if not any(map(len, hits)):
                    continue
                places, halves = Places(part.column("t").to_pylist()), (words >> np.uint64(32)).astype(np.uint32).view(np.int32)
                del words
                for left, hit in zip((True, False), hits):
                    for lo in range(0, len(hit), 1 << 14):
                        word, text = at[hit[lo:lo + (1 << 14)]], row[hit[lo:lo + (1 << 14)]]
                        origin, origin_line = places.origin(text)
                        line = places.line(word)
                        if left:
                            point, n = places.start(word), np.minimum(word - first[text], AROUND)
                            beside = np.repeat(word, n) - 1 - counted(n)
                            away, lines = np.repeat(point, n) - places.start(beside), np.repeat(line, n) - places.line(beside)
                        else:
                            point, n = places.end(word + UNIT - 1), np.minimum(last[text] - word - UNIT, AROUND)
                            beside = np.repeat(word, n) + UNIT + counted(n)
                            away, lines = places.end(beside) - np.repeat(point, n), np.empty(0, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([
                            part.column("d").take(pa.array(text)), part.column("th").take(pa.array(text)), pa.array(word - first[text]), pa.array(np.full(len(word), left)),
                            pa.array(point - origin), pa.array(line - origin_line), listed(n, halves[beside]), listed(n, away), listed(n if left else np.zeros_like(n), lines)],
                            ["d", "th", "word", "left", "point", "line", "hashes", "points", "lines"])

    return texts_of(docs, doc_id, text).mapInArrow(
        cut, f"d {kind}, th long, word long, left boolean, point long, line long, hashes binary, points binary, lines binary")


def same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def runs(found: DataFrame) -> DataFrame:
    """Units of one text whose first places follow each other in the same way, as one run: columns of the first and last unit."""
    kept = ["d", "th", "fd", "fth"]
    ordered = found.repartition(parts(found.sparkSession), "d", "th").sortWithinPartitions("d", "th", "fd", "fth", F.col("word") - F.col("fword"), "word")
    schema = ordered.select(*kept, "word", "stop", "fword", F.col("word").alias("last"), F.col("fword").alias("flast")).schema

    def goes_on(t: pa.Table, k: str) -> np.ndarray:
        """Which rows, from the second on, have the value of the row before."""
        x, y = t.column(k).slice(1), t.column(k).slice(0, t.num_rows - 1)
        return pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(first: pa.Table, last: pa.Table) -> pa.Table:
            columns = [last.column({"last": "word", "flast": "fword"}.get(k, k)) if k in ("stop", "last", "flast") else first.column(k) for k in schema.names]
            return pa.Table.from_arrays(columns, schema.names)

        held = None  # the first and the last row of the open run
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            word, fword, stop = (t.column(k).to_numpy() for k in ("word", "fword", "stop"))
            on = (word[1:] - fword[1:] == word[:-1] - fword[:-1]) & (word[1:] <= stop[:-1])
            for k in kept:
                on &= goes_on(t, k)
            if held is not None:
                on[0] = True
            start = np.flatnonzero(np.concatenate([[True], ~on]))
            end = np.append(start[1:] - 1, t.num_rows - 1)
            held = t.take(pa.array([start[-1], end[-1]])).combine_chunks()
            if len(start) > 1:
                yield from joined(t.take(pa.array(start[:-1])), t.take(pa.array(end[:-1]))).combine_chunks().to_batches()
        if held is not None:
            yield from joined(held.slice(0, 1), held.slice(1)).combine_chunks().to_batches()

    return ordered.mapInArrow(merged, schema)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, para, start, end, n_words, class_doc, class_para, class_start, class_size, removed) of every run of words that also stands elsewhere.

    Lines do not matter: a run may begin inside a line and go on over any number of them; ``para`` is the line it begins in. Words are
    compared exactly, A-Z lower-cased. Every run of PASSAGE (51) or more words is found; shorter ones of UNIT (40) or more where a unit of theirs is
    selected. Each run is held against the first place (smallest doc_id, then place) of its words and extended word by word as far as both agree. A class is
    a run of first places and all that repeat a part of it; the first stays, the others are ``removed``.
    """
    ready(docs.sparkSession)
    packed = settle(units(docs, doc_id, text), "packed-units")
    again = settle(unit_keys(packed).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-units")
    found = settle(units_in(packed, filter_of(again)), "units")
    own = found.groupBy("h").agg(F.min(F.struct("d", "th", "word")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.col("f.d").alias("fd"), F.col("f.th").alias("fth"), F.col("f.word").alias("fword"))
    itself = same(("d", "fd"), ("th", "fth"))
    placed = found.hint("merge").join(own, "h").where(~(itself & (F.col("word") != F.col("fword")) & (F.col("word") < F.col("fword") + UNIT)))
    whole = settle(runs(placed), "runs")
    ends = [whole.select(F.explode(F.array(place("th", a), place("fth", b))).alias("h")).distinct() for a, b in (("word", "fword"), ("last", "flast"))]
    near = settle(contexts(docs, doc_id, text, *map(filter_of, ends)), "contexts")

    first = itself & (F.col("word") == F.col("fword"))
    heads, others = whole.where(first), whole.where(~first)
    sides = {"left": ("left", "hashes"), "start": ("left", "point"), "starts": ("left", "points"), "line": ("left", "line"), "lines": ("left", "lines"),
             "right": ("right", "hashes"), "end": ("right", "point"), "ends": ("right", "points")}
    at = lambda p, cols: near.where(F.col("left") == F.lit(sides[cols[0]][0] == "left")).select(F.col("d").alias(f"{p}d"), F.col("th").alias(f"{p}th"), F.col("word").alias(f"{p}w"), *(F.col(sides[c][1]).alias(f"{p}{c}") for c in cols))
    def met(rows: DataFrame, p: str, cols: list[str], d: str, th: str, word: str) -> DataFrame:
        """With columns of the context at a place, where there is one."""
        return rows.join(at(p, cols), same((f"{p}d", d)) & (F.col(f"{p}th") == F.col(th)) & (F.col(f"{p}w") == F.col(word)), "left").drop(f"{p}d", f"{p}th", f"{p}w")

    # One end after the other: contexts are dealt out for one end at a time, and the second end's joins carry numbers, not the first end's arrays.
    joined = met(met(others, "b", ["left"], "fd", "fth", "fword"), "a", ["left", "start", "starts", "line", "lines"], "d", "th", "word")
    joined = settle(moved(joined, "l", ("aleft", "bleft"), {"line": ("aline", "alines", -1), "start": ("astart", "astarts", -1)}), "left-ends")
    joined = met(met(joined, "z", ["right"], "fd", "fth", "flast"), "y", ["right", "end", "ends"], "d", "th", "last")
    joined = moved(joined, "r", ("yright", "zright"), {"end": ("yend", "yends", 1)})
    spans = settle(joined.select("d", "th", "word", "stop", "fd", "fth", "fword", "flast", "l", "r", "line", "start", "end").dropDuplicates(
        ["d", "th", "word", "fd", "fth", "fword"]), "spans")  # rows alike in id and text give their contexts twice

    h = heads.select(*(F.col(c).alias(f"h_{c}") for c in ("d", "th", "word", "stop", "last")))
    into = spans.join(h, same(("fd", "h_d")) & (F.col("fth") == F.col("h_th")) & F.col("fword").between(F.col("h_word"), F.col("h_last")))
    key = ["h_d", "h_th", "h_word"]
    sizes = into.groupBy(*key).agg((F.count(F.lit(1)) + 1).alias("class_size"), F.max(F.when(F.col("fword") == F.col("h_word"), F.col("l")).otherwise(0)).alias("l"),
                                   F.max(F.when(F.col("flast") == F.col("h_last"), F.col("r")).otherwise(0)).alias("r"))
    grown = h.join(sizes.withColumnsRenamed({k: f"s{k}" for k in key}), same(*((k, f"s{k}") for k in key))).drop(*(f"s{k}" for k in key))
    grown = moved(met(grown, "a", ["start", "starts", "line", "lines"], "h_d", "h_th", "h_word"), "l", None, {"h_line": ("aline", "alines", -1), "h_start": ("astart", "astarts", -1)})
    grown = moved(met(grown, "y", ["end", "ends"], "h_d", "h_th", "h_last"), "r", None, {"h_end": ("yend", "yends", 1)})
    grown = settle(grown.select(*key, "class_size", (F.col("h_stop") - F.col("h_word") + F.col("l") + F.col("r")).alias("h_n"), "h_line", "h_start", "h_end").dropDuplicates(key), "heads")
    # What lies in a run that stands in an earlier text has its class there.
    within = grown.join(spans.select("d", "th", "start", "end"), same(("h_d", "d")) & (F.col("h_th") == F.col("th")) & (F.col("h_start") >= F.col("start")) & (F.col("h_end") <= F.col("end")))
    within = within.select(*(F.col(k).alias(f"w{k}") for k in key)).distinct()
    grown = settle(grown.join(within, same(*((k, f"w{k}") for k in key)), "left_anti"), "classes")
    named = into.select(*key, "d", "line", "start", "end", (F.col("stop") - F.col("word") + F.col("l") + F.col("r")).alias("n"), F.lit(True).alias("removed"))
    named = named.join(grown.select(*(F.col(k).alias(f"g{k}") for k in key), F.col("h_line").alias("class_para"), F.col("h_start").alias("class_start"), "class_size"), same(*((k, f"g{k}") for k in key)))
    named = named.select("d", "line", "start", "end", "n", F.col("h_d").alias("class_doc"), "class_para", "class_start", "class_size", "removed")
    top = grown.select(F.col("h_d").alias("d"), F.col("h_line").alias("line"), F.col("h_start").alias("start"), F.col("h_end").alias("end"), F.col("h_n").alias("n"), F.col("h_d").alias("class_doc"),
                       F.col("h_line").alias("class_para"), "h_start", "class_size", F.lit(False).alias("removed")).withColumnRenamed("h_start", "class_start")
    return named.unionByName(top).withColumnsRenamed({"d": doc_id, "line": "para", "n": "n_words"})
