"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import parts, ready

PRIME = (1 << 127) - 1
BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
BACK = pow(BASE, -1, PRIME)
ROOT = bytes(16)
LIMIT = 1 << 14  # nodes that one task takes as one component
FEW = 1 << 17  # heavy nodes that are broadcast; more are joined by shuffle
FORK = 100  # conversations that share the start of one of them
TURNS = 6  # shared turns are fewer than this
CHUNK = 12  # log2 of the ids of one piece of a list


def _int(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix hash of every turn within its conversation, as far as this partition knows; last a row that says how the partition ends."""
    pid, first, now, k, h, head = TaskContext.get().partitionId(), None, None, 0, 0, True
    binary, names = pa.binary(16), ["pid", "head", "c", "k", "h", "t", "cp", "first"]
    for batch in batches:
        heads, ks, hs, ts = [], [], [], []
        for c, t in zip(batch.column("c").to_pylist(), batch.column("t").to_pylist()):
            if c != now:
                head = now is None
                first = c if head else first
                now, k, h = c, 0, 0
            t = int(t, 16) % PRIME
            k, h = k + 1, (h * BASE + t) % PRIME
            heads.append(head)
            ks.append(k)
            hs.append(_bytes(h))
            ts.append(_bytes(t))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array(heads, pa.bool_()), batch.column("c"), pa.array(ks, pa.int64()), pa.array(hs, binary).cast(pa.binary()),
                                          pa.array(ts, binary).cast(pa.binary()), batch.column("cp"), pa.nulls(n, pa.int64())], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([head]), pa.array([now]), pa.array([k]), pa.array([_bytes(h)]), pa.array([None], pa.binary()),
                                          pa.array([None], pa.int32()), pa.array([first])], names)


def placed(conversations: DataFrame) -> DataFrame:
    """(c, k, h, t, cp): every turn with its place k from 1 in conversation c, the hash h of the first k turns, its own hash t and its code points.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any length may cross partitions. Hashes of pieces can be joined, so
    only the end of every partition goes through the driver, and what a partition begins with is added to its first conversation.
    """
    spark = ready(conversations.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), mark.alias("t"), F.length(text).alias("cp"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # rows alike in all else may be dealt apart
    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("t"), F.asc("salt")]
    dealt = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("c", "t", "cp")
    scanned = settle(dealt.mapInArrow(_scan, "pid int, head boolean, c long, k long, h binary, t binary, cp int, first long"), "turns")
    carry, at = {}, None
    for e in sorted(scanned.where("first is not null").select("pid", "head", "c", "k", "h", "first").collect(), key=lambda e: e["pid"]):
        if at is not None and at[0] == e["first"]:
            carry[e["pid"]] = at[1:]
        k0, h0 = carry.get(e["pid"], (0, 0)) if e["head"] else (0, 0)
        at = e["c"], k0 + e["k"], (h0 * pow(BASE, e["k"], PRIME) + _int(bytes(e["h"]))) % PRIME
    turns = scanned.where("first is null")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, hs = batch.column("k").to_pylist(), batch.column("h").to_pylist()
            for i, (pid, head) in enumerate(zip(batch.column("pid").to_pylist(), batch.column("head").to_pylist())):
                if head and pid in carry:
                    k0, h0 = carry[pid]
                    ks[i], hs[i] = k0 + ks[i], _bytes((h0 * pow(BASE, ks[i], PRIME) + _int(hs[i])) % PRIME)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(ks, pa.int64()), pa.array(hs, pa.binary()), batch.column("t"), batch.column("cp")], ["c", "k", "h", "t", "cp"])

    return turns.mapInArrow(carried, "c long, k long, h binary, t binary, cp int") if carry else turns.select("c", "k", "h", "t", "cp")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = lambda name: batch.column(name).to_pylist()
        ids, prevs = [], []
        for more, h, t, before, own in zip(col("more"), col("h"), col("t"), col("before"), col("own")):
            full = _int(h) if before == own else ((_int(before) - _int(own)) * pow(BASE, more, PRIME) + _int(h)) % PRIME
            ids.append(_bytes(full))
            prevs.append(_bytes((full - _int(t)) * BACK % PRIME))
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("depth"), pa.array(ids, pa.binary()), pa.array(prevs, pa.binary()), batch.column("cp"), batch.column("len")],
                                         ["c", "depth", "id", "prev", "cp", "len"])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, depth, id, prev, cp, len): one row per rebuilt conversation and prefix of it, the empty one included; ``id`` names the prefix, ``prev`` the one before."""
    own = F.when(F.col("k") < TURNS, F.struct("k", "h", "cp"))
    convs = turns.groupBy("c").agg(F.max("k").alias("n"), F.sort_array(F.collect_list(own)).alias("heads"))
    convs = settle(convs.withColumns({"shared": (F.crc32(F.col("c").cast("string").cast("binary")) % TURNS).cast("int"), "source": F.col("c") - F.col("c") % FORK}), "conversations")
    starts = convs.where(F.col("c") == F.col("source")).select("source", F.col("heads").alias("start"))
    none = F.lit(ROOT)
    hash_at = lambda a, i: F.coalesce(F.get(F.col(a)["h"], i), none)
    convs = convs.join(starts, "source", "left").withColumn("start", F.expr("slice(coalesce(start, array()), 1, shared)"))
    size = F.size("start")
    convs = convs.select("c", "shared", "start", hash_at("start", size - 1).alias("before"), hash_at("heads", F.col("shared") - 1).alias("own"),
                         size.cast("long").alias("m"), (size + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).cast("long").alias("len"))
    convs = settle(convs, "forks")
    head = F.struct(F.lit(0).cast("long").alias("k"), none.alias("h"), F.lit(0).alias("cp"))
    first = convs.select("c", "len", "start", F.explode(F.concat(F.array(head), "start")).alias("e")).select(
        "c", F.col("e.k").alias("depth"), F.col("e.h").alias("id"), F.when(F.col("e.k") > 0, hash_at("start", (F.col("e.k") - 2).cast("int"))).alias("prev"), F.col("e.cp").alias("cp"), "len")
    rest = turns.join(convs.drop("start"), "c").where("k > shared").select(
        "c", (F.col("m") + F.col("k") - F.col("shared")).alias("depth"), (F.col("k") - F.col("shared")).alias("more"), "h", "t", "before", "own", "cp", "len")
    return settle(first.unionByName(rest.mapInArrow(_joined, "c long, depth long, id binary, prev binary, cp int, len long")), "prefixes")


def centroid_rollup(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums over subtrees of a forest given as parent indices (-1: none here; parents come before children).

    A component is split at its centroid: the deepest node with more than half of it below and at itself. What lies there is summed once
    and added along the path from the centroid up to the top; the parts left go on by themselves. Every node is in at most log2 of them.
    """
    sums = [[0] * len(parent) for _ in values]
    trees: dict[int, list[int]] = {}
    top = list(range(len(parent)))
    for v, p in enumerate(parent):
        top[v] = top[p] if p >= 0 else v
        trees.setdefault(top[v], []).append(v)
    stack = list(trees.values())
    label = [0] * len(parent)  # number of the component a node is in
    fresh = 0
    while stack:
        part = stack.pop()
        fresh += 1
        below = dict.fromkeys(part, 1)
        for v in part:
            label[v] = fresh
        here = fresh
        for v in reversed(part):
            if v != part[0]:
                below[parent[v]] += below[v]
        centre = next(v for v in reversed(part) if 2 * below[v] > len(part))
        above, under, of = [], {}, {}
        for v in part:
            if v == centre:
                continue
            p = parent[v]
            side = v if p == centre and v != part[0] else of.get(p) if v != part[0] else None
            if side is None:
                above.append(v)
            else:
                of[v] = side
                under.setdefault(side, []).append(v)
        totals = [own[centre] + sum(own[v] for vs in under.values() for v in vs) for own in values]
        v = centre
        while v >= 0 and label[v] == here:
            for s, t in zip(sums, totals):
                s[v] += t
            v = parent[v]
        label[centre] = 0
        stack += [above] if above else []
        stack += under.values()
    return sums


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of components that lie one after the other, parents before children."""
    def solved(t: pa.Table) -> list[pa.RecordBatch]:
        ids, prevs = t.column("id").to_pylist(), t.column("prev").to_pylist()
        at = {x: i for i, x in enumerate(ids)}
        sums = centroid_rollup([at.get(p, -1) for p in prevs], [t.column("leaf").to_pylist(), t.column("saved").to_pylist()])
        for name, s in zip(("leaves_sum", "saved_sum"), sums):
            i = t.schema.get_field_index(name)
            t = t.set_column(i, name, pa.array([a + b for a, b in zip(t.column(i).to_pylist(), s)], pa.int64()))
        return t.to_batches()

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        comps = t.column("comp").to_pylist()
        cut = next((i for i in range(len(comps) - 1, 0, -1) if comps[i] != comps[i - 1]), 0)
        if cut:  # whole components; the last may go on in the next batch
            yield from solved(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from solved(held)


NODE = "id binary, prev binary, conv long, depth long, n_convs long, n_children long, leaf long, saved long, w long, leaves_sum long, saved_sum long, comp binary"


def solved(nodes: DataFrame) -> DataFrame:
    """Subtree sums within components of bounded size, one after the other in a task."""
    columns = [f.split()[0] for f in NODE.split(", ")]
    dealt = nodes.select(*columns).repartition(parts(nodes.sparkSession), "comp").sortWithinPartitions("comp", "depth")
    return dealt.mapInArrow(_components, NODE)


def rolled(nodes: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """Subtree sums of one tree of any size: components of more than ``limit`` nodes are split at their centroids, all in one round of joins.

    ``w`` is the number of rows at and below a node, known without any roll-up; by it the centroid is the deepest node with more than half of its component.
    ``paths``: (c, depth, id) of the conversations that stand for a node, from which come ancestors at a depth.
    """
    done, active = [], settle(nodes, "heavy")
    while True:
        stats = active.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("w").alias("total"))
        large = settle(stats.where(F.col("size") > limit), "large")
        if large.isEmpty():
            return _union([*done, solved(active)])
        done.append(solved(active.join(large.select("comp"), "comp", "left_anti")))
        big = active.join(large, "comp")
        centre = big.where(2 * F.col("w") > F.col("total")).groupBy("comp").agg(F.max_by(F.struct("id", "depth", "conv", "w"), "depth").alias("x"))
        centre = settle(centre, "centroids")
        big = big.join(centre, "comp")
        at = lambda name, c, depth: (paths.select(F.col("c").alias(f"{name}c"), F.col("depth").alias(f"{name}d"), F.col("id").alias(name)),
                                     (F.col(f"{name}c") == c) & (F.col(f"{name}d") == depth))
        for name, c, depth in (("own", F.col("conv"), F.col("x.depth")), ("kid", F.col("conv"), F.col("x.depth") + 1), ("up", F.col("x.conv"), F.col("depth"))):
            side, on = at(name, c, depth)
            big = big.join(side, on, "left").drop(f"{name}c", f"{name}d")
        big = big.withColumns({"inside": F.col("own").eqNullSafe(F.col("x.id")) & (F.col("depth") >= F.col("x.depth")), "above": F.col("up").eqNullSafe(F.col("id")) & (F.col("depth") < F.col("x.depth"))})
        big = settle(big, "split")
        totals = big.where("inside").groupBy("comp").agg(F.sum("leaf").alias("leaf_total"), F.sum("saved").alias("saved_total"))
        big = big.join(totals, "comp")
        centred = F.col("id") == F.col("x.id")
        gets = centred | F.col("above")
        big = big.withColumns({"leaves_sum": F.col("leaves_sum") + F.when(gets, F.col("leaf_total")).otherwise(0), "saved_sum": F.col("saved_sum") + F.when(gets, F.col("saved_total")).otherwise(0),
                               "w": F.col("w") - F.when(F.col("above"), F.col("x.w")).otherwise(0), "comp": F.when(F.col("inside"), F.col("kid")).otherwise(F.col("comp"))})
        big = settle(big.select(*active.columns, centred.alias("final")), "parts")
        done.append(big.where("final").drop("final"))
        active = big.where("not final").drop("final")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def listed(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the ids c that end at a node, ascending and comma-joined. Lists are made in pieces and hashed as a stream, so none is ever held whole."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = ends.withColumn("piece", F.shiftright("c", CHUNK)).groupBy("id", "piece").agg(text.alias("ids"))
    dealt = pieces.repartition(parts(ends.sparkSession), "id").sortWithinPartitions("id", "piece").select("id", F.col("ids").cast("binary").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for i, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if i != now:
                    out += [(now, sha.hexdigest())] if sha else []
                    now, sha = i, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.binary()), pa.array([s for _, s in out])], ["id", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["id", "ends_sha256"])

    return dealt.mapInArrow(hashed, "id binary, ends_sha256 string")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversation c begins with the first turns (crc32 of its decimal id, modulo 6) of conversation c - c % 100 (``%`` with the sign of c), where that exists, and goes on
    with its own turns behind as many. Turns are ordered by turn, null first; equal ones by role, then by hash. Null role or text counts as empty; rows without conv_id are
    left out; repeated rows are turns of their own; other columns are ignored; an empty table has no nodes. Prefixes are compared by 127-bit hashes.

    Nodes with more than ``limit`` rows at and below them are heavy; what hangs below a heavy node is a component for one task. The heavy tree is rolled up
    by rounds of joins until its components fit as well.
    """
    rows = rebuilt(placed(conversations))
    low = lambda c: F.min(c).alias(c)
    nodes = rows.groupBy("id").agg(low("depth"), F.min("c").alias("conv"), F.count(F.lit(1)).alias("n_convs"), low("cp"), low("prev"), F.sum(F.col("len") - F.col("depth") + 1).alias("w"))
    nodes = settle(nodes, "nodes")
    kids = nodes.where("prev is not null").groupBy(F.col("prev").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nothing = F.lit(0).cast("long")
    nodes = nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", nothing)).withColumns({
        "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("cp"), "leaves_sum": nothing, "saved_sum": nothing}).drop("cp")
    nodes = settle(nodes, "family")
    heavy = nodes.where(F.col("w") > limit)
    names = heavy.select("id", F.lit(True).alias("heavy"))
    names = F.broadcast(names) if names.count() <= FEW else names
    marked = rows.select("c", "depth", "id").join(names, "id", "left")
    tops = marked.where("heavy is null").groupBy("c").agg(F.min_by("id", "depth").alias("comp"))
    light = solved(nodes.where(F.col("w") <= limit).join(tops.withColumnRenamed("c", "conv"), "conv"))
    light = settle(light, "light")
    hung = light.where(F.col("id") == F.col("comp")).groupBy(F.col("prev").alias("id")).agg(F.sum("leaves_sum").alias("more_leaves"), F.sum("saved_sum").alias("more_saved"))
    grown = heavy.join(hung, "id", "left").withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", nothing), "saved": F.col("saved") + F.coalesce("more_saved", nothing), "comp": F.lit(ROOT)})
    stand = heavy.select(F.col("conv").alias("c")).distinct()
    paths = settle(marked.where("heavy").select("c", "depth", "id").join(stand, "c"), "paths")
    columns = [f.split()[0] for f in NODE.split(", ")]
    every = light.select(*columns).unionByName(rolled(grown.select(*columns), paths, limit).select(*columns))
    parents = nodes.select(F.col("id").alias("prev"), F.col("conv").alias("parent_conv_id"))
    out = every.join(parents, "prev", "left").join(listed(rows.where("depth = len").select("id", "c")), "id", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
