"""Shared helpers: tables, durable cuts of the lineage, Arrow output."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    A session without that setting gets a folder of its own if it is purely
    local, and one beside the warehouse if that is on a shared file system; on
    a cluster whose warehouse is a local path there is none, and this raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="strandline-")
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in warehouse or warehouse.startswith("file:"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = warehouse.rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and read it back from the shared checkpoint folder."""
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hex_order(col, seed: int):
    """60 pseudo-random bits of a key, the same in Spark and in plain SQL (MD5)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def sorted_runs(batches):
    """(table, bounds) of sorted batches: whole runs of equal values in the first three columns, and where each begins, with the end."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        key = np.stack([t.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield t.slice(0, cuts[-1]), np.concatenate(([0], cuts))
            t = t.slice(cuts[-1])
        rest = t
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def sorted_groups(batches):
    """A table for each run of equal values in the first three columns of sorted batches."""
    for t, bounds in sorted_runs(batches):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield t.slice(a, b - a)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one stage has freed would stay with the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function over batches that gives its freed memory back when a task ends.

    What an earlier task of the same worker has left in reference cycles (a
    function and its module's names, with a model in them) goes first.
    """

    def out(batches):
        gc.collect()
        yield from run(batches)
        release_memory()

    return out
