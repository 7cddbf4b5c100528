import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from galeledger.llm.tries import centroid_rollup, placed, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    total = {}
    for key in sorted(members, key=len, reverse=True):
        n = len(members[key]) - 1
        total[key] = (sum(total[k][0] for k in kids[key]) or 1, sum(total[k][1] for k in kids[key]) + (n * len(key[-1][1]) if key else 0))
    return sorted((min(m), len(key), min(members[key[:-1]]) if key else -1, len(m), len(kids[key]), *total[key],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(key)))).encode()).hexdigest()) for key, m in members.items())


def got(df, limit):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in trie(df, limit).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 60), *range(100, 160), 255, 301, 302, 4097, 8200]:
        for k in range(rng.randint(1, 9)):
            out.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc😀", ""])))
    out += [(c, 0, "user", "hello") for c in range(400, 480)]  # one first turn of many
    out += [(c, k, "user", "same") for c in range(500, 590) for k in range(7)]  # one conversation many times
    out += [(700, k, "user", f"turn {k}") for k in range(300)]  # one long conversation
    out += [(701, k, "user", f"turn {k}") for k in range(200)]
    out += [(None, 1, "user", "no id"), (800, None, None, None), (800, None, "user", "x"), (800, 1, None, "y"), (800, 1, None, "y"), (800, 1, None, "y")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1 << 14, 40, 6])
def test_nodes_against_brute_force(spark, rows, limit):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"c": F.lit(0), "id": F.lit("x"), "depth": F.lit(1)})
    assert got(df, limit) == brute(rows)


def test_places_cross_partitions(spark, rows):
    turns = placed(spark.createDataFrame(rows, SCHEMA)).collect()
    per = defaultdict(list)
    for r in turns:
        per[r.c].append(r.k)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values()) and len(per[700]) == 300


def test_nothing(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA), 4) == brute([(1, 0, "user", "a")])


def test_rollup_of_random_forests():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        for shape in (lambda i: i - 1, lambda i: rng.randrange(-1, i), lambda i: max(-1, i - rng.randint(1, 3))):
            parent = [-1] + [shape(i) for i in range(1, n)]
            values = [[rng.randrange(9) for _ in range(n)], [1] * n]
            want = [list(v) for v in values]
            for i in range(n - 1, -1, -1):
                if parent[i] >= 0:
                    for w in want:
                        w[parent[i]] += w[i]
            assert centroid_rollup(parent, values) == want
