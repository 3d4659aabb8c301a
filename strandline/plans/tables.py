"""The driver's tables in the engine's terms.

An embedding is a model: its label is the chain, its id the model, its first
63 values are 21 residues. Orders and line items stand for schemes and atoms,
parts bought together for sequence hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import ensemble

RESIDUES = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a model, centred, straight from the arrays."""
    e = table(spark, sf_dir, "embeddings")
    axis = lambda k: F.transform(F.sequence(F.lit(0), F.lit(RESIDUES - 1)), lambda r: F.get("embedding", 3 * r + k).cast("double"))
    return ensemble.centred(e.select(F.col("label").alias("chain"), F.col("vec_id").alias("model"), axis(0).alias("px"), axis(1).alias("py"), axis(2).alias("pz")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a residue: chain, model, seq, x, y, z."""
    e = table(spark, sf_dir, "embeddings")
    at = F.sequence(F.lit(0), F.lit(RESIDUES - 1))
    rows = e.select(F.col("label").alias("chain"), F.col("vec_id").alias("model"), F.posexplode(F.transform(at, lambda r: F.struct(*[F.get("embedding", 3 * r + k).cast("double").alias(c) for k, c in enumerate("xyz")]))).alias("r", "p"))
    return rows.select("chain", "model", (F.col("r") + 1).cast("long").alias("seq"), "p.x", "p.y", "p.z")


#: Rows of a partition that is sorted in one task.
SORTED = 2_000_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions in which so many rows are sorted: the session's, or more where these would hold more than `SORTED`. So a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED))


def hits_parts(spark: SparkSession, sf_dir: str) -> int:
    """`parts` of the hits: a line meets itself and its two neighbours."""
    return parts(spark, 3 * table(spark, sf_dir, "lineitem").count())


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order as hits: query, target, and measures made of their rows."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")  # noqa: E741
    n = hits_parts(spark, sf_dir)
    a = l.select("l_orderkey", F.col("l_linenumber").alias("n1"), F.col("l_partkey").alias("query"), "l_quantity", "l_discount")
    b = l.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("l_partkey").alias("target"), F.col("l_tax").alias("tax2"), F.col("l_quantity").alias("q2"))
    p = a.repartition(n, "l_orderkey").join(b.repartition(n, "l_orderkey"), "l_orderkey").filter(F.abs(F.col("n1") - F.col("n2")) <= 1)
    ordinal = F.col("l_orderkey") * 100 + F.col("n1") * 10 + F.col("n2")
    return p.select("query", "target", (F.col("tax2") / 40).alias("evalue"), (F.col("l_quantity") * 2).alias("pident"), F.col("q2").cast("int").alias("alnlen"), (1 - F.col("l_discount")).alias("qcov"), (1 - F.col("tax2")).alias("tcov"), ordinal.alias("ordinal"))
