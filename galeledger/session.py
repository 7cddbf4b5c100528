"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _INSIDE, _BEFORE = threading.Lock(), [0], [None]


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "galeledger") -> SparkSession:
    """Session for tests and the bench. A cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen in local mode with nothing set;
    on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="galeledger-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so retries cannot mix."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of a query as it ends, not when the driver happens to collect its garbage: nobody reads those of a written table again.

    Threads may settle side by side in one session: the first one in sets it, the last one out puts back what was there.
    """
    with _LOCK:
        if not _INSIDE[0]:
            _BEFORE[0] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        _INSIDE[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _INSIDE[0] -= 1
            if not _INSIDE[0]:
                spark.conf.unset(DROP_SHUFFLES) if _BEFORE[0] is None else spark.conf.set(DROP_SHUFFLES, _BEFORE[0])


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably, fixes values that a recomputation could change, and
    gives the planner real file sizes to base its join choice on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over the configured number of shuffle partitions.

    Used in front of a step that emits many rows per input row: the count is
    explicit, so adaptive execution does not merge the small inputs into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
