"""Appends by a ledger of keys: one writer, two writers, a writer that died."""

from pyspark.sql import functions as F

from galeledger.sources.ledger import KeyedAppend, _move, append_new_keys

SCHEMA = "k string, j int, x double"


def rows(spark, path):
    return sorted(((r.k, r.j, r.x) for r in spark.read.parquet(path).collect()), key=repr)


def test_two_writers_add_a_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), (None, 1, 1.0), ("b", 1, 1.5)], SCHEMA)
    two = spark.createDataFrame([("b", 1, 2.0), ("c", None, 2.0), (None, 1, 2.0)], SCHEMA)
    first, second = KeyedAppend(one, ["k", "j"], path).prepare(), KeyedAppend(two, ["k", "j"], path).prepare()
    assert second.commit().count() == 3
    assert [(r.k, r.x) for r in first.commit().collect()] == [("a", 1.0)]
    assert rows(spark, path) == sorted([("a", 1, 1.0), ("b", 1, 2.0), ("c", None, 2.0), (None, 1, 2.0)], key=repr)
    assert append_new_keys(one.unionByName(two), ["k", "j"], path).count() == 0


def test_the_target_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    append_new_keys(spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("j"), F.rand(1).alias("x")), ["k"], path)
    for part in (tmp_path / "t").glob("part-*.parquet"):
        part.write_bytes(b"no parquet any more")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    append = KeyedAppend(spark.createDataFrame([("17", 1, 0.0), ("x", 1, 0.0)], SCHEMA), ["k"], path)
    assert all("/_ledger/" in f for f in append.held(0, append.entries()).inputFiles())
    assert [r.k for r in append.prepare().commit().collect()] == ["x"]
    many = spark.range(4000, 6000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("j"), F.lit(0.0).alias("x"))
    assert append_new_keys(many, ["k"], path).count() == 1000


def test_rows_of_a_dead_writer_are_moved_by_the_next(spark, tmp_path):
    path = str(tmp_path / "t")
    dead = KeyedAppend(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), ["k"], path).prepare()
    assert dead.store.take(("_aside", dead.name, "keys"), ("_ledger", dead._number(0)))  # and no more
    KeyedAppend(spark.createDataFrame([("lost", 1, 1.0)], SCHEMA), ["k"], path).prepare()  # never published
    append_new_keys(spark.createDataFrame([("a", 1, 9.0), ("b", 1, 2.0)], SCHEMA), ["k"], path)
    assert rows(spark, path) == [("a", 1, 1.0), ("b", 1, 2.0)]
    _move(dead.store)
    assert rows(spark, path) == [("a", 1, 1.0), ("b", 1, 2.0)]


def test_a_target_without_ledger_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, 1.0)], SCHEMA).write.parquet(path)
    append_new_keys(spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0)], SCHEMA), ["k"], path)
    assert rows(spark, path) == [("a", 1, 1.0), ("b", 1, 2.0)]
