"""Shared helpers of the training-data operators: table access, worker imports, shared-folder tables, joins on hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A key with more than one in HOT of all rows is hot. There are fewer than HOT such keys, whatever the input.
HOT = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed on the nodes (or given by --py-files); this only adds the driver's
    own path, which matters when the driver was started from another folder.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder (tests); a cluster gets an error, as its executors would write to disks of their own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="specloom-")
        sc.setCheckpointDir(path)
        path = sc._jsc.sc().getCheckpointDir().get()
    return path


#: Lets a finished execution's shuffle files go at once: what it gave is in the shared folder by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back; a lost executor loses nothing of it.

    The folder goes by drop(), or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/specloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._specloom_path = path
    at, fs = _folder(spark, path)
    fs.deleteOnExit(at)
    return out


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_specloom_path", None)
        if path:
            at, fs = _folder(df.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def join_dealt(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right by key, where right holds each key once and, under size, how many rows of left have it.

    Rows of hot keys are dealt over several salts, and right's row of such a key is repeated for each; total is left's
    number of rows. Fewer than HOT keys can have more than total / HOT rows, so the broadcast table of them is bounded.
    """
    parts = F.ceil(F.col(size) * HOT / F.lit(max(1, total))).cast("int")
    hot = right.where(F.col(size) * HOT > F.lit(total)).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(spread, F.col("_parts"))).cast("int")).drop("_hot", "_parts")
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) * HOT > F.lit(total), parts - 1).otherwise(F.lit(0))))).drop(size)
    return salted.join(dealt, [key, "_salt"], how).drop("_salt")
