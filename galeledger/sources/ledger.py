"""Appends that add every key once, by a ledger of written keys beside the data.

An append reads the ledger and never the target. Its rows and its ledger entry are written aside first; renaming the entry to the next number publishes it, and only one
writer can take a number. The other filters its rows by the entries that came in between and tries the next number, so two writers never both add a key. Rows are moved beside
the others after that; what a writer that died in between left aside is moved by the next append.

``_ledger`` and ``_aside`` are hidden from readers of the target by their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle

FEW = 512  # distinct new keys that are looked up by hash, through the Bloom filters of the ledger's files


class Store:
    """The folder of a target, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *names))

    def names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def take(self, source: tuple[str, ...], target: tuple[str, ...]) -> bool:
        """Rename; False where the target is there already."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self._at("")).toUri(), self.conf)
        try:
            context.rename(self._at(*source), self._at(*target), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(self._at(*target)):
                return False
            raise
        return True


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_held_{k}"]) for k in keys])


class KeyedAppend:
    """One append, in two steps: :meth:`prepare` writes aside what is new, :meth:`commit` publishes it."""

    def __init__(self, df: DataFrame, keys: Sequence[str], path: str):
        self.spark, self.keys, self.path = df.sparkSession, list(keys), path
        self.store = Store(self.spark, path)
        self.schema = df.schema
        self.rows = settle(df.withColumn("_h", F.xxhash64(*[F.col(k) for k in self.keys])), "append")
        self.seen = 0
        self._adopt()

    def entries(self) -> int:
        return len([n for n in self.store.names("_ledger") if n.isdigit()])

    def _adopt(self) -> None:
        """A target without ledger gets one from its rows, once."""
        if self.entries():
            return
        if any("=" in n for n in self.store.names()):
            raise ValueError(f"{self.path} is partitioned by folder; appends by ledger keep one flat table")
        if any(n.endswith(".parquet") for n in self.store.names()):
            old = self.spark.read.schema(self.schema).parquet(self.path).withColumn("_h", F.xxhash64(*[F.col(k) for k in self.keys]))
            name = uuid.uuid4().hex
            self._write_keys(old, name)
            self.store.take(("_aside", name, "keys"), ("_ledger", self._number(0)))

    @staticmethod
    def _number(n: int) -> str:
        return f"{n:012d}"

    def _write_keys(self, rows: DataFrame, name: str) -> None:
        self.store.fs.mkdirs(self.store._at("_ledger"))
        keys = rows.select(*self.keys, "_h").distinct().sortWithinPartitions("_h")
        keys.write.option("parquet.bloom.filter.enabled#_h", "true").parquet(os.path.join(self.path, "_aside", name, "keys"))

    def held(self, first: int, last: int) -> DataFrame | None:
        """Keys of the entries from ``first`` up to before ``last``."""
        if first >= last:
            return None
        paths = [os.path.join(self.path, "_ledger", self._number(n)) for n in range(first, last)]
        keys = self.spark.read.schema(self.rows.select(*self.keys, "_h").schema).parquet(*paths)
        few = [r["_h"] for r in self.rows.select("_h").distinct().limit(FEW + 1).collect()]
        keys = keys.where(F.col("_h").isin(few)) if len(few) <= FEW else keys
        return keys.select(F.col("_h").alias("_held_h"), *[F.col(k).alias(f"_held_{k}") for k in self.keys])

    def prepare(self) -> KeyedAppend:
        """Write the rows with keys that no entry holds, and their keys, aside."""
        last = self.entries()
        held = self.held(self.seen, last)
        if held is not None:
            self.rows = settle(self.rows.join(held, (self.rows["_h"] == held["_held_h"]) & _same(self.keys, self.rows, held), "left_anti"), "append")
        self.seen, self.name = last, uuid.uuid4().hex
        self.empty = self.rows.isEmpty()
        if not self.empty:
            self._write_keys(self.rows, self.name)
            self.rows.drop("_h").write.parquet(os.path.join(self.path, "_aside", self.name, "rows"))
            # The entry names its rows, so that whoever finds them aside can finish the move.
            self.store.fs.create(self.store._at("_aside", self.name, "keys", f"_rows-{self.name}")).close()
        return self

    def commit(self) -> DataFrame:
        """Publish; the rows that were added."""
        while not self.empty and not self.store.take(("_aside", self.name, "keys"), ("_ledger", self._number(self.seen))):
            self.prepare()
        _move(self.store)
        return self.rows.drop("_h")


def _move(store: Store) -> None:
    """Bring the rows of published entries beside the others."""
    aside = set(store.names("_aside"))
    for entry in [n for n in store.names("_ledger") if n.isdigit()] if aside else []:
        for name in [n.removeprefix("_rows-") for n in store.names("_ledger", entry) if n.startswith("_rows-")]:
            if name in aside:
                for part in [n for n in store.names("_aside", name, "rows") if n.endswith(".parquet")]:
                    store.take(("_aside", name, "rows", part), (part,))
                store.fs.delete(store._at("_aside", name), True)


def append_new_keys(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Write only rows whose key the target does not hold yet; returns what was written.

    Run twice, the second run writes nothing. Keys are held with the types of ``df``, so ``007`` and ``7`` stay apart, and a NULL key
    equals a held NULL key. Several rows of a new key are all written.
    """
    return KeyedAppend(df, keys, path).prepare().commit()
