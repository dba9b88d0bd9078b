"""What all executors share: a folder, and this package."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LEFT: list[tuple] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder when this driver ends; what a crash leaves is up to the folder's clean-up."""
    if not _LEFT:
        atexit.register(_remove)
    _LEFT.append((spark.sparkContext, path))


def _remove() -> None:
    for sc, path in _LEFT:
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{shared_dir(spark)}/quarry-package-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    stream.write(packed.getvalue())
    stream.close()
    sc.addPyFile(path)
    remove_at_exit(spark, path)
    sc._quarry_shipped = True


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until the driver ends, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """``df`` with column ``name``: each row's place in that order, from 0 on.

    Rows are sorted within ranges and written; a range's start is the sum of the sizes before it, one number for each
    partition, so that no task sees more than its range, however the keys are spread. Ties need a further key to be
    stable.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    staged = table(ordered, "numbered")
    sizes = staged.groupBy("_p").agg(F.count("*").alias("_size"), F.min("_m").alias("_first"))
    before = F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return staged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_version(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files of a table."""
    at, fs = _path(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}\t{f.getLen()}\t{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def built_once(spark: SparkSession, name: str, build) -> str:
    """The folder ``name``, made by ``build(path)`` unless it is there.

    It lies in ``spark.quarry.index.dir``, where later sessions find it too, or else in the shared folder until this
    driver ends. It appears by a rename, so that nobody sees half of it; of two that build it at once, one is kept.
    """
    kept = spark.conf.get("spark.quarry.index.dir", None)
    path = f"{(kept or shared_dir(spark)).rstrip('/')}/{name}"
    at, fs = _path(spark, path)
    if not fs.exists(at):
        staging = f"{path}-{uuid.uuid4().hex}"
        build(staging)
        if not fs.rename(_path(spark, staging)[0], at):
            fs.delete(_path(spark, staging)[0], True)
        if not kept:
            remove_at_exit(spark, path)
    return path
