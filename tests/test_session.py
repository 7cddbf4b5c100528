"""Choice of the shared folder, and durable cuts of lineage."""

import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from galeledger import session


def fake(conf=None, master="local[2]"):
    state = {"dir": None}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf), sparkContext=context)


def test_named_folder_wins():
    assert session.shared_folder(fake("hdfs://x/y")) == "hdfs://x/y"


def test_local_mode_makes_one_folder_and_keeps_it():
    spark = fake()
    assert session.shared_folder(spark) == session.shared_folder(spark) != ""


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(master="yarn"))


def test_settle_keeps_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "array(id, id + 1) AS a", "cast(null AS double) AS x")
    out = session.settle(df)
    assert out.schema.simpleString() == df.schema.simpleString() and out.exceptAll(df).count() == 0
    assert session.settle(df.where("id < 0")).count() == 0


def test_scratch_paths_never_repeat(spark):
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_settled_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a settled query go as it ends; the setting is what it was, threads side by side included, and its source can be run again."""
    jvm = spark.sparkContext._jvm
    folders = [str(d) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*")}
    rows = spark.range(5000).withColumn("k", F.col("id") % 700).groupBy("k").agg(F.sum("id").alias("s"))
    setting, before = spark.conf.get(session.DROP_SHUFFLES, None), left()
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: session.settle(rows.where(F.col("k") != i), f"t{i}"), range(8)))
    assert spark.conf.get(session.DROP_SHUFFLES, None) == setting
    until = time.time() + 20
    while left() - before and time.time() < until:
        time.sleep(0.2)
    assert not left() - before
    assert [d.count() for d in done] == [699] * 8
    assert rows.count() == 700 == session.settle(rows).count()
