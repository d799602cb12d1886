"""Session helpers: tuned builder, table loading, lineage cutting."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, name: str = "groundwork", **conf: str) -> SparkSession:
    """Session with adaptive execution on. Partition counts stay with the cluster's own settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**TUNING, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table, dealt to all cores when its file comes in fewer splits than half of them.

    A file with few row groups would otherwise keep per-row text work in as many tasks.
    """
    scan = table(spark, sf_dir, name)
    want = spark.sparkContext.defaultParallelism
    return scan.repartition(want) if scan.rdd.getNumPartitions() * 2 <= want else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, from ``spark.checkpoint.dir``.

    Without that setting, a session on one machine gets a temporary folder; on a cluster,
    where no other machine would see such a folder, this is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a compressed table at ``folder``, which the caller removes: a fraction of a checkpoint, and files tell their size."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints deleted that no table refers to any more.

    Spark deletes them when the driver's JVM collects its garbage, which one with much memory does too late for the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which import it for the Arrow functions; once per session.

    Workers see neither the driver's ``sys.path`` nor, on a cluster, its files.
    """
    sc = spark.sparkContext
    if getattr(sc, "_groundwork_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "groundwork"), "zip", root, "groundwork"))
    sc._groundwork_shipped = True
