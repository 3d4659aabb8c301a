"""Durable intermediate results: a folder that all executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a purely local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="strandline-")
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def computed_once(df: DataFrame) -> DataFrame:
    """`df`, computed now and read back from the shared folder, so that what follows does not compute it again and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, after what a crash within `replace` may have left aside is put back."""
    p, fs = _place(spark, path)
    aside, _ = _place(spark, f"{path.rstrip('/')}.old")
    if not fs.exists(p) and fs.exists(aside):
        fs.rename(aside, p)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished folder in the place of another one, which stays until the new one is complete.

    The old folder is moved aside, to `<path>.old`, before the new one takes
    its name, and deleted after that. A crash in between leaves it there, from
    where `exists` or the next call puts it back.
    """
    there = exists(spark, path)
    old, fs = _place(spark, path)
    aside, _ = _place(spark, f"{path.rstrip('/')}.old")
    fresh, _ = _place(spark, new)
    if not fs.exists(fresh):
        raise FileNotFoundError(new)
    fs.delete(aside, True)
    if there:
        fs.rename(old, aside)
    if not fs.rename(fresh, old):
        if there:
            fs.rename(aside, old)
        raise OSError(f"could not move {new} to {path}")
    fs.delete(aside, True)
