"""One-pass source for text files whose header must be found per file, registered as ``headed_text``.

The planner only lists files and cuts them into byte ranges. A task finds the header of a file in its
first bytes, goes to its own range and reads it once, in blocks; only wanted cells leave the reader, and rows outside
a time range not even that. Files may order, add or lack columns.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import importable

BOM, NBSP = "\ufeff", "\u00a0"
HEAD, BLOCK = 1 << 16, 1 << 22
OPEN_COST = 1 << 20  # bytes that opening one more file counts as
PACKED = (".gz", ".bz2", ".zst", ".lz4")  # compressed as a whole: one range
SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
ORDER = [("source_file", "string"), ("source_block", "bigint"), ("source_row", "bigint")]
ISO_TIME = re.compile(r"\d{4}-\d{2}-\d{2}")

# How the header line is told: by being the first that is not blank, the first comment with a comma, or the first with two commas that is no comment.
RULES = {
    "first": lambda line: bool(line.strip()),
    "comment": lambda line: line.startswith("#") and "," in line,
    "commas": lambda line: not line.lstrip().startswith("#") and line.count(",") >= 2,
}


def readable(paths: Sequence[str]) -> bool:
    """Whether every path is in a store that Arrow opens; Spark may know more of them."""
    return all("://" not in p and not re.match(r"[a-z]+:", p) or p.split(":", 1)[0] in SCHEMES for p in paths)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, size) of the files of paths, folders and globs, sorted; hidden files are left out. None at all is an error."""
    found: dict[str, int] = {}
    for path in paths:
        base = re.split(r"[*?\[]", path, maxsplit=1)[0]
        base = base if base == path else base.rsplit("/", 1)[0] or "/"
        store, top = _opened(base)
        prefix = base[:len(base) - len(top)] if base.endswith(top) else ""
        info = store.get_file_info(top.rstrip("/") or "/")
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(info.path, recursive=True)) if info.type == fs.FileType.Directory else []
        pattern = re.compile(fnmatch.translate(_opened(path.replace(base, top, 1) if base != path else top)[1]).replace(".*", "[^/]*")) if base != path else None
        for f in files:
            inner = f.path[len(top.rstrip("/")):]
            if f.type == fs.FileType.File and not re.search(r"/[._]", inner) and (pattern is None or pattern.fullmatch(f.path)):
                found[prefix + f.path] = f.size
    if not found:
        raise FileNotFoundError(f"[PATH_NOT_FOUND] no file at {', '.join(paths)}")
    return sorted(found.items())


@dataclass
class Ranges(InputPartition):
    ranges: list  # (path, first byte, byte behind the last or None)


def packed_ranges(files: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Byte ranges of at most ``most`` bytes; small ones share a partition."""
    cut = [(path, a, None if path.endswith(PACKED) else min(a + most, size), min(most, size - a)) for path, size in files if size for a in ([0] if path.endswith(PACKED) else range(0, size, most))]
    out, room = [], 0
    for path, a, b, n in cut:
        if not out or n + OPEN_COST > room:
            out.append([])
            room = max(most, n + OPEN_COST)
        out[-1].append((path, a, b))
        room -= n + OPEN_COST
    return [Ranges(x) for x in out]


def _cells(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), []) if '"' in line else line.split(sep)


@dataclass
class Head:
    names: list[str]
    line: str
    end: int  # byte behind the header line


def head_of(path: str, rule: str, sep: str) -> Head | None:
    """Header of a file; None for a file without any data line, an error for one with data and no header."""
    store, name = _opened(path)
    stream = store.open_input_stream(name)
    body, at, some, fresh = b"", 0, False, b" "
    while fresh:
        fresh = stream.read(HEAD)
        body += fresh
        while (cut := body.find(b"\n")) >= 0 or (not fresh and body):
            raw = body[:cut + 1] if cut >= 0 else body
            body, at = body[len(raw):], at + len(raw)
            line = raw.decode("utf-8", "replace").rstrip("\r\n").replace(BOM, "")
            if RULES[rule](line):
                text = re.sub(r"^[# ]+", "", line).strip() if rule == "comment" else line
                return Head([c.replace(NBSP, " ").strip() for c in _cells(text, sep)], line, at)
            some = some or bool(line.strip()) and not line.lstrip().startswith("#")
    if some:
        raise ValueError(f"no header found in {path}")
    return None


def blocks(path: str, first: int, stop: int | None, after: int) -> Iterator[list[str]]:
    """Lines of a file that begin in [first, stop) and behind byte ``after``, block by block."""
    store, name = _opened(path)
    if stop is None:
        stream, at = store.open_input_stream(name), 0
        while at < after:
            at += len(stream.read(after - at))
        rest = b""
    else:
        first = max(first, after)
        if first >= stop:
            return
        stream = store.open_input_file(name)
        at = first if first == after or not first else first - 1
        stream.seek(at)
        rest = b""
        if at < first:  # the line that holds byte first - 1 belongs to the range before
            while b"\n" not in rest and (more := stream.read(HEAD)):
                rest += more
            cut = rest.find(b"\n") + 1
            if not cut:
                return
            at, rest = at + cut, rest[cut:]
    done = False
    while not done and (stop is None or at < stop):
        more = stream.read(BLOCK)
        rest += more
        done = not more
        if stop is not None and at + len(rest) >= stop and (end := rest.find(b"\n", max(0, stop - 1 - at))) >= 0:
            rest, done = rest[:end + 1], True
        cut = len(rest) if done else rest.rfind(b"\n") + 1
        text, rest, at = rest[:cut].decode("utf-8", "replace"), rest[cut:], at + cut
        if text:
            text = text.replace("\r\n", "\n").replace(BOM, "")
            yield (text[:-1] if text.endswith("\n") else text).split("\n")


class HeadedReader(DataSourceReader):
    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[Ranges]:
        return packed_ranges(listed(self.plan["paths"]), self.plan["range"]) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        p = self.plan
        names = [*p["wanted"].values(), *(n for n, _ in ORDER)]
        heads: dict[str, Head | None] = {}
        for path, first, stop in partition.ranges:
            if path not in heads:
                heads = {path: head_of(path, p["rule"], p["sep"])}
            head = heads[path]
            if head is None:
                continue
            check_head(path, head, p["required"])
            places = [head.names.index(n) if n in head.names else None for n in p["wanted"]]
            timed = next((i for n, i in zip(p["wanted"].values(), places) if n == p["time"]), None)
            row = 0
            for lines in blocks(path, first, stop, head.end):
                lines = [x for x in lines if x and not x.isspace() and x != head.line and not (p["rule"] != "first" and x.lstrip().startswith("#"))]
                cells = [_cells(x, p["sep"]) for x in lines]
                if timed is not None and (p["since"] or p["until"]):
                    cells = [c for c in cells if _inside(c[timed] if timed < len(c) else "", p["since"], p["until"])]
                n = len(cells)
                columns = [pa.nulls(n, pa.string()) if i is None else pa.array([c[i] or None if i < len(c) else None for c in cells], pa.string()) for i in places]
                order = [pa.array([path] * n, pa.string()), pa.array([first] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())]
                row += n
                yield pa.RecordBatch.from_arrays([*columns, *order], names)


def _inside(text: str, since: str | None, until: str | None) -> bool:
    """Whether a time may lie in [since, until): only texts that begin with year, month and day can be told apart here."""
    if not ISO_TIME.match(text):
        return True
    day = text[:10]
    return (not since or day >= since[:10]) and (not until or day <= until[:10])


def check_head(path: str, head: Head, required: Sequence[str]) -> None:
    for name in required:
        if name not in head.names:
            raise ValueError(f"column {name!r} not found in {path}")


class HeadedText(DataSource):
    """Options: ``plan``, a JSON object as :func:`read_headed` writes it."""

    @classmethod
    def name(cls) -> str:
        return "headed_text"

    def schema(self) -> str:
        wanted = json.loads(self.options["plan"])["wanted"]
        return ", ".join([*(f"`{c}` string" for c in wanted.values()), *(f"{n} {t}" for n, t in ORDER)])

    def reader(self, schema) -> HeadedReader:
        return HeadedReader(json.loads(self.options["plan"]))


def read_headed(
    spark: SparkSession, paths: str | Sequence[str], wanted: dict[str, str], sep: str, rule: str = "first", required: Sequence[str] = (),
    time: str | None = None, since: str | None = None, until: str | None = None,
) -> DataFrame:
    """Text columns picked by header name (``wanted``: header name -> output name), with file and row order.

    Empty cells and columns that a file lacks are NULL; a file without a ``required`` column raises: the first file at once, others when they are read.
    Lines that repeat the header, blank lines and, but for rule ``first``, comments are left out. ``since`` and ``until`` (days, both included) spare rows whose
    ``time`` cell begins with another day; the caller filters exactly.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    first = listed(paths)[0][0]
    head = head_of(first, rule, sep)
    if head:
        check_head(first, head, required)
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    plan = {"paths": paths, "wanted": wanted, "sep": sep, "rule": rule, "required": list(required), "time": time, "since": since, "until": until, "range": size}
    importable(spark).dataSource.register(HeadedText)
    return spark.read.format("headed_text").option("plan", json.dumps(plan)).load()
