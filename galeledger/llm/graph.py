"""Connected components and pair search inside buckets, with hot groups dealt over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import parts

BLOCK = 256


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node each is joined to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        far = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])


def components(edges: DataFrame, thin: bool = True) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): the smallest node that edges lead to.

    With ``thin`` only a spanning forest of each batch of edges is kept first. Edges of :func:`linked` are thinned where they are made: a second Python
    step in that stage would double the workers of every executor, and all of them would be used, and fill their caches, from then on.

    Alternating large-star and small-star steps on tables; each round is written to the shared
    folder. Minima are combined before the shuffle, so a centre with very many neighbours is
    no hot key. Nodes of no edge, and edges from a node to itself, give no row. Null nodes are left out.
    """
    now = edges.where("a is not null and b is not null and a != b").select("a", "b")
    now = now.mapInArrow(_forest, "a long, b long") if thin else now
    now, mark = settle(now.where("a != b").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        near = star.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(near.select("e.*").where("a != b").distinct(), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if seen == mark:
            break
        mark = seen
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(rows: DataFrame, keys: list[str], columns: list[str], links: Callable, block: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between rows that share a bucket and that ``links`` accepts.

    ``rows``: key columns, ``id`` long and some of ``columns``; the others come from ``more``, by id, for rows with company only.
    ``links(ids, columns)`` gets the rows of one block and returns two index arrays of linked rows. A bucket of any size is
    cut into blocks of about ``block`` rows and each pair of blocks is one unit of work, so every pair is looked at while no
    task holds more than a few blocks; only a spanning forest of a batch's links leaves it.
    """
    spark = rows.sparkSession
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # The planner cannot know how many rows a Python step emits; without the hint it may broadcast them.
    cut = rows.hint("merge").join(n, keys).withColumn("_c", F.ceil(F.col("_n") / block)).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_c")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_o")
    dealt = cut.select(*keys, *rows.drop(*keys).columns, "_b", other).withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    dealt = dealt.withColumn("_u", F.xxhash64(*keys, "_i", "_j"))
    dealt = dealt if more is None else dealt.join(more, "id")
    payload = columns
    unit = ["_u", *keys, "_i", "_j"]
    sent = dealt.select(*unit, "id", *payload).repartition(parts(spark), *unit).sortWithinPartitions(*unit).select("_u", "id", *payload)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(t: pa.Table) -> pa.RecordBatch:
            u, ids = t.column("_u").to_numpy(), t.column("id").to_numpy()
            columns = [t.column(c).combine_chunks() for c in payload]
            cuts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
            xs, ys = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s > 1:
                    x, y = links(ids[s:e], [c.slice(s, e - s) for c in columns])
                    if len(x):
                        nodes, root = roots(ids[s:e][x], ids[s:e][y])
                        xs.append(nodes[nodes != root])
                        ys.append(root[nodes != root])
            none = np.empty(0, dtype=np.int64)
            nodes, root = roots(np.concatenate(xs or [none]), np.concatenate(ys or [none]))
            far = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            u = t.column("_u").to_numpy()
            if not len(u):
                continue
            last = int(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))[-1])
            held = t.slice(last).combine_chunks()
            if last:
                yield edges(t.slice(0, last))
        if held is not None and held.num_rows:
            yield edges(held)

    return sent.mapInArrow(verified, "a long, b long")
