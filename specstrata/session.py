"""Session helpers: table access, lineage cuts, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: ``spark.checkpoint.dir`` or the session's checkpoint directory.

    Where neither is set a temporary folder serves a session on one machine
    and goes with it; on a cluster that is an error, as no machine can read
    another's folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="specstrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark takes it, with the scheme of its file system: the one it names, else the default one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def located(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Scheme of a folder's file system, as Spark takes it, and what ``opened`` needs of the folder."""
    uri = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, folder)).toUri()
    return uri.getScheme(), uri.getPath() if uri.getScheme() == "file" else uri.toString()


def opened(scheme: str, root: str):
    """In a task: the file system of a ``located`` folder and the folder's path in it."""
    from pyarrow import fs

    system, base = (fs.LocalFileSystem(), root) if scheme == "file" else fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a table written in the shared folder: columns compressed, read selectively and with known sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/specstrata/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables of all sessions in the shared folder; no DataFrame that reads one may still be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/specstrata")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
