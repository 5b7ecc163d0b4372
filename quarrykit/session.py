"""Session helpers shared by every operator: workers' import path and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partitions that one shuffle may have: more cost the driver more than they save.
MOST_PARTITIONS = 1 << 17
_homes: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of rows that Spark hands a Python worker at a time; a task holds several times as many, in both processes.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_SPARK_DEFAULT = "67108864b"


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from wherever the driver imported it, and take rows in batches of ``BATCH`` bytes
    where the session leaves Spark's own setting as it is."""
    if spark.conf.get(BATCH_SETTING, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a session in one process (``local[...]``, as in tests) may leave
    it unset and gets a temporary folder; on a cluster that is an error, as executors do not share local folders."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quarrykit-checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in this session's own folder of the shared one; the session's folder goes when its JVM ends."""
    home = _homes.get(spark.sparkContext.applicationId)
    if home is None:
        home = f"{checkpoint_dir(spark)}/quarrykit-{uuid.uuid4().hex}"
        path, fs = _hadoop(spark, home)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _homes[spark.sparkContext.applicationId] = home
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later jobs survive a lost executor without recomputing it,
    and plans on top start from its real size."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    found = df.sparkSession.read.schema(df.schema).parquet(folder)
    found._durable_folder = folder
    return found


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that sends neither side to all tasks. Spark sizes a table by its files and a row's width: it counts neither the
    rows that an explode or a Python step adds nor what compression saves, and may take a table of millions of rows for one of a few MB."""
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing will read again, as in loops that write one a round."""
    folder = getattr(df, "_durable_folder", None)
    if folder is not None:
        path, fs = _hadoop(df.sparkSession, folder)
        fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, mb: int = 8) -> int:
    """Shuffle partitions for about ``mb`` MB each of the bytes that ``df`` reads: never fewer than the session's setting, nor more
    than ``MOST_PARTITIONS``. Sizes are those of the plan's sources, whose sum a join cannot exceed as Spark's guess for it does.

    A source without a size (rows of an RDD) counts nothing.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(least, min(MOST_PARTITIONS, -(-size // (mb << 20))))
