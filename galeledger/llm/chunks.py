"""Texts to ids by way of their distinct chunks: each chunk is encoded once per worker, whole texts are put together by array gathers."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np


Coded = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids; where those of every chunk begin; how many they are


def coded(ids: list[list[int]]) -> Coded:
    """Id lists of chunks as arrays."""
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
    return flat, np.cumsum(size) - size, size


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``size`` values from ``begin`` on, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Chunks(dict):
    """Ids of text chunks, kept for the next batch; beyond ``most`` chunks the rarely used ones are forgotten.

    ``pattern`` must cut a text only where its encoding cannot depend on the other side; ``encode`` gets distinct
    chunks and returns their ids. ``end`` is an id put after every text, if given.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], Coded], end: int | None = None, most: int = 600_000):
        super().__init__()
        self.find, self.encode_chunks, self.end, self.most = re.compile(pattern).findall, encode, end, most
        self._start()

    def _start(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.empty(1 << 20, dtype=np.uint32)
        self.begin, self.count, self.uses = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.known = self.used = 0
        if self.end is not None:
            self[None] = 0
            self._keep(coded([[self.end]]))

    def forget(self) -> None:
        """Keep the half of the chunks that was used most, and of it those used more than once."""
        floor = max(2, int(np.partition(self.uses[:self.known], self.known // 2)[self.known // 2]) + 1)
        kept = [(c, at) for c, at in self.items() if c is not None and self.uses[at] >= floor]
        at = np.fromiter((at for _, at in kept), dtype=np.int64, count=len(kept))
        old = self.flat, self.begin[at], self.count[at]
        self._start()
        self.update(zip((c for c, _ in kept), range(len(self), len(self) + len(kept))))
        self._keep((gathered(*old), np.cumsum(old[2]) - old[2], old[2]))

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        at = self[chunk] = len(self)
        return at

    def _keep(self, new: Coded) -> None:
        ids, begin, size = new
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.known + len(size) > len(self.begin):
            self.begin, self.count, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.count, self.uses))
        self.flat[self.used:self.used + len(ids)] = ids
        self.begin[self.known:self.known + len(size)] = self.used + begin
        self.count[self.known:self.known + len(size)] = size
        self.used += len(ids)
        self.known += len(size)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many belong to each. A null text is empty."""
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and every collection would walk the whole store
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.forget()
        chunks: list[str | None] = []
        stops = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            chunks += self.find(text or "")
            if self.end is not None:
                chunks.append(None)
            stops[i] = len(chunks)
        return self._joined(self._known(chunks), stops)

    def encode_cut(self, chunks: list[str], at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are cut already: distinct chunks, the number of each chunk in them, and how many chunks each text has."""
        collects = gc.isenabled()
        gc.disable()
        try:
            if len(self) > self.most:
                self.forget()
            own, stops = self._known(chunks)[at], np.cumsum(counts)
            if self.end is not None:
                own, stops = np.insert(own, stops, self[None]), stops + np.arange(1, len(stops) + 1)
            return self._joined(own, stops)
        finally:
            if collects:
                gc.enable()

    def _known(self, chunks: list[str | None]) -> np.ndarray:
        """Numbers of chunks; new ones are encoded."""
        at = np.fromiter(map(self.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if self.new:
            self._keep(self.encode_chunks(self.new))
            self.new = []
        return at

    def _joined(self, at: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.uses[:self.known] += np.bincount(at, minlength=self.known)
        size = self.count[at]
        upto = np.concatenate([[0], np.cumsum(size)])[stops]
        return gathered(self.flat, self.begin[at], size), np.diff(upto, prepend=0)
