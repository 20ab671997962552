"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, but on a local master only, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylight-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def app_folder(spark: SparkSession) -> str:
    """This application's tables; they go when the driver's Python ends, or by ``cleared``."""
    folder = f"{shared_dir(spark)}/quarrylight/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(delete, spark, folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark can; nothing happens if the JVM is gone."""
    with suppress(Py4JError, OSError, AttributeError):
        jvm = spark.sparkContext._gateway.jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The plan of what follows starts at the files: a lost executor costs the
    tasks it ran, never the stages before, and results of order-dependent code
    are fixed once.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    # No success marker: nothing reads it, and a local file system starts two processes for it, which share the driver's memory while they begin.
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quarrylight/" not in folder:
                raise ValueError(f"not a stored table: {folder}")
            delete(df.sparkSession, folder)


def cleared(spark: SparkSession) -> None:
    """Delete all of this application's stored tables, once the results that read them are written."""
    delete(spark, f"{shared_dir(spark)}/quarrylight/{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """A table's scan, dealt out to all cores if it has fewer splits than those; a scan of more splits stays as it is.

    For reads of few files before dear work on each row; the rows shuffled are
    then few.  ``df`` must be a plain scan, since its partitions are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
