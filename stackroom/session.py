"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows beyond this size go to Python in another batch: 10,000 long texts at once are more than a task should hold.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it isn't installed but run from a checkout; bound what they get at once, where the session doesn't."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a lazy parquet scan."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster is refused, as
    data would end up on one machine's disk.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stackroom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage; in so many parts at most.

    Files there are replicated by the storage, so losing an executor does not lose the rows.
    """
    shared_folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a table in the shared folder: for many rows, which take a fraction of a checkpoint's space."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of finished steps' shuffle files: Spark deletes them once the driver's garbage collector finds that nothing refers to them, which by itself may not run for long. Those of the very last job stay until another has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c):
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a scan has fewer splits than twice the cores (a few small files); else as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * n else df.repartition(n)


def state_of(df: DataFrame) -> str:
    """What df reads, as it is now: its files' names, sizes and times; for a plan without files, the plan."""
    spark = df.sparkSession
    files = sorted(df.inputFiles())
    if not files:
        return f"plan {df.semanticHash()}"
    digest = hashlib.sha256()
    for folder, own in groupby(files, key=lambda f: f.rpartition("/")[0]):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        known = {s.getPath().getName(): s for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
        for f in own:
            s = known.get(unquote(f.rpartition("/")[2]))
            digest.update(f"{f} {s.getLen() if s else None} {s.getModificationTime() if s else None}\n".encode())
    return digest.hexdigest()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
