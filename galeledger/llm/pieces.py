"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Chunks, coded
from .common import ready, slices

SPACE = "▁"
# No piece has a space mark after another character, so a path always passes the state in front of one.
CHUNK = " *[^ ]+| +"  # a chunk is kept with spaces for the marks, in half the memory
# What a worker holds beside the caches of other steps: chunks of its store and bytes of text that are encoded at a time.
MOST_CHUNKS, MOST_TEXT = 300_000, 1 << 20
_TRANSDUCERS: dict[str, "Transducer"] = {}


class Transducer:
    """Normaliser, pieces and byte fallback of a model as one transducer over characters.

    The normaliser's arcs read a character and write it, or the space mark for a space. The piece transducer has the pieces as
    states: an arc from piece a reads the characters of piece b (a way through a tree of characters, compiled once) and writes b's id at
    weight -score(b), which is the rank of the merge that makes b. The weight is infinite, so the arc is left out, where the
    model's merges would not leave a and b apart. A character that is no piece is an arc that writes its bytes at weight 0. With a text composed,
    states are (place, last piece); the tropical shortest path to the end is the encoding.
    """

    def __init__(self, path: str, most_pairs: int = 1 << 19):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.made = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}  # the others no merge ends in
        self.tree: dict = {}
        for piece in self.made:
            node = self.tree
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = piece, 0.0 - self.scores[piece], {}  # the piece, its weight, and whether it may follow another
        self.pairs, self.most_pairs = 0, most_pairs
        self.spines: dict[tuple[str, bool], list[tuple[str, float, float]]] = {}
        self.spelled = [b""] * n
        for piece, i in self.ids.items():
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        self.chunks = Chunks(CHUNK, lambda chunks: coded([self.path(c.replace(" ", SPACE)) for c in chunks]), most=MOST_CHUNKS)

    @staticmethod
    def normalised(text: str) -> str:
        """Identity but for the space marks: one in front, one for every space."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """The model's merges: the pair with the best-scored union first, leftmost on ties."""
        scores, n = self.scores, len(text)
        parts: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-scores[u], i, u) for i in range(n - 1) if (u := text[i:i + 2]) in scores]
        heapify(queue)
        left = n
        while queue and left > down_to:
            _, i, union = heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(union):
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = union, "", after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    u = parts[a] + parts[b]
                    if u in scores:
                        heappush(queue, (-scores[u], a, u))
        return [p for p in parts if p]

    def spine(self, piece: str, right: bool) -> list[tuple[str, float, float]]:
        """The parts at one edge of a piece while it is being merged: part, rank of the merge that makes it, rank of the one that takes it in."""
        key = piece, right
        if key not in self.spines:
            out, until, part = [], float("inf"), piece
            while True:
                made = -self.scores[part] if len(part) > 1 else float("-inf")
                out.append((part, made, until))
                if len(part) == 1:
                    break
                until, part = made, self.merged(part, 2)[right]
            self.spines[key] = out
        return self.spines[key]

    def arc(self, a: str, b: str) -> bool:
        """Whether b may follow a: when the two meet, no part at the end of a and part at the start of b that exist at the same time have a
        union that is merged before either is taken in. Of equal merges the left one comes first."""
        scores = self.scores
        for x, x_made, x_until in self.spine(a, True):
            for y, y_made, y_until in self.spine(b, False):
                if x_made < y_until and y_made < x_until:
                    score = scores.get(x + y)
                    if score is not None and -score < x_until and -score <= y_until:
                        return False
        return True

    def path(self, chunk: str) -> list[int]:
        """Ids on the shortest path through the transducer composed with one chunk: places are relaxed from left to right.

        Merges are deterministic, so one last piece at most leads to a place at finite weight, and a place keeps that one alone.
        """
        if chunk.startswith(SPACE * 2):
            # pieces of space marks alone have one common score: the order of merges decides, not a weight
            return self.written(self.merged(chunk))
        n, infinite, tree = len(chunk), float("inf"), self.tree
        cost: list[float] = [0.0] + [infinite] * n
        last: list[str] = [""] * (n + 1)
        for start in range(n):
            base = cost[start]
            if base == infinite:
                continue
            before, node = last[start], tree.get(chunk[start])
            if node is None or "" not in node:
                if base < cost[start + 1]:
                    cost[start + 1], last[start + 1] = base, chunk[start]
            stop = start
            while node is not None:
                stop += 1
                if "" in node:
                    piece, weight, follows = node[""]
                    if base + weight < cost[stop]:
                        ok = not before or follows.get(before)
                        if ok is None:
                            ok = self.kept(follows, before, piece)
                        if ok:
                            cost[stop], last[stop] = base + weight, piece
                node = node.get(chunk[stop]) if stop < n else None
        if cost[n] == infinite:
            return self.written(self.merged(chunk))
        at, found = n, []
        while at:
            found.append(last[at])
            at -= len(last[at])
        return self.written(found[::-1])

    def kept(self, follows: dict[str, bool], before: str, piece: str) -> bool:
        """Whether ``piece`` may follow ``before``, remembered while there are few pairs."""
        ok = self.arc(before, piece)
        if self.pairs < self.most_pairs:
            self.pairs += 1
            follows[before] = ok
        return ok

    def written(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            at = self.ids.get(piece)
            out += [at] if at is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks.encode([self.normalised(t or "").replace(SPACE, " ") for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the ids without the space put in front."""
        whole = b"".join(map(self.spelled.__getitem__, ids))
        return whole[1:] if whole[:1] == b" " else whole


def transducer(path: str) -> Transducer:
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>) of every row.

    ``round_trip``: the ids decode to the very text; false only where the text has the space mark itself,
    which decodes to a space. Null and empty texts have no ids. Repeated rows give repeated rows.
    """
    ready(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            for part in slices(batch, "t", MOST_TEXT):
                texts = part.column("t").to_pylist()
                ids, n = own.encode(texts)
                ends = np.cumsum(n)
                lists = [ids[e - k:e] for e, k in zip(ends.tolist(), n.tolist())]
                back = [own.decode(one.tolist()) == (t or "").encode() for one, t in zip(lists, texts)]
                crc = [zlib.crc32(one.astype("<u4")) for one in lists]
                offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(n), pa.array(crc, type=pa.int64()), pa.array(back), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))],
                    ["d", "n_pieces", "ids_crc32", "round_trip", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(coded, f"d {kind}, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>").withColumnRenamed("d", doc_id)


def decoded(ids: DataFrame, model: str, doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """(doc_id, text): texts of id arrays; bytes that are no UTF-8 become the replacement character."""
    ready(ids.sparkSession)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            texts = [own.decode(one or []).decode("utf-8", "replace") for one in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(texts, type=pa.string())], ["d", "text"])

    kind = ids.schema[doc_id].dataType.simpleString()
    return ids.select(F.col(doc_id).alias("d"), F.col(column).alias("i")).mapInArrow(spelled, f"d {kind}, text string").withColumnRenamed("d", doc_id)
