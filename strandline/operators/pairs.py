"""Pair operators: models of a chain, residues of a model, contacts within a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import distance


def pair(df: DataFrame, keys: list[str], order: str, mode: str = "lt", blocks: int = 1) -> DataFrame:
    """Rows of one group with each other, columns suffixed _1 and _2.

    mode lt: each unordered pair once; ne: both orders; all: also with itself.
    An equi-join on the keys with the order as residual condition. With
    `blocks` a group is dealt over that many blocks and the join is also by
    pair of blocks, so that one large group, or the whole table where there
    are no keys, is not one task; each row then travels `blocks` times.
    """
    if not keys and blocks < 2:
        raise ValueError("pairs of a whole table need blocks")
    a = df.select(*keys, *[F.col(c).alias(f"{c}_1") for c in df.columns if c not in keys])
    b = df.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"{c}_2") for c in df.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    first, second = F.col(f"{order}_1"), F.col(f"{order}_2")
    if blocks > 1:

        def dealt(side, n):
            side = side.withColumn(f"__b{n}", F.pmod(F.xxhash64(f"{order}_{n}"), F.lit(blocks)).cast("int"))
            meets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, F.col(f"__b{n}")).alias("i"), F.greatest(k, F.col(f"__b{n}")).alias("j"))))
            side = side.withColumn("__at", meets)
            return side.withColumns({f"__i{n}": F.col("__at.i"), f"__j{n}": F.col("__at.j")}).drop("__at")

        a, b = dealt(a, 1), dealt(b, 2)
        # Rows of one block meet where both blocks of the pair are theirs.
        on = on & (F.col("__i1") == F.col("__i2")) & (F.col("__j1") == F.col("__j2")) & ((F.col("__b1") != F.col("__b2")) | (F.col("__i1") == F.col("__j1")))
    on = on & {"lt": first < second, "ne": first != second, "all": F.lit(True)}[mode]
    return a.join(b, on).drop(*[f"__{k}" for k in keys], "__b1", "__b2", "__i1", "__i2", "__j1", "__j2")


def mirror(matrix: DataFrame, keys: list[str], i: str = "i", j: str = "j", value: str = "value", diagonal: float | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A full square matrix from its upper half, read once. ids (keys, i): what the diagonal is for; without it, what the matrix holds."""
    ways = F.array(F.struct(F.col(i).alias("__i"), F.col(j).alias("__j")), F.struct(F.col(j).alias("__i"), F.col(i).alias("__j")))
    out = matrix.select(*keys, value, F.inline(ways)).select(*keys, F.col("__i").alias(i), F.col("__j").alias(j), value)
    if diagonal is None:
        return out
    ids = out.select(*keys, i).distinct() if ids is None else ids
    return out.unionByName(ids.select(*keys, i, F.col(i).alias(j), F.lit(diagonal).alias(value)))


#: A cube and half of its neighbours: of two neighbouring cubes one has the other among these.
HALF = [(0, 0, 0), *((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0))]


def contacts(points: DataFrame, keys: list[str], cutoff: float, order: str = "seq", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(keys, i, j, d) with 0 < d < cutoff, i < j.

    Points are put into cubes of the cutoff's size; each meets the points of
    its own cube and of half of the neighbouring ones, so the join is by cube,
    not by group, and each pair of cubes meets once.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff).cast("long")
    at = points.select(*keys, F.col(order).alias("i"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(z).alias("az"), cell(x).alias("cx"), cell(y).alias("cy"), cell(z).alias("cz"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(step, ("sx", "sy", "sz"), strict=True)], F.lit(step == (0, 0, 0)).alias("own")) for step in HALF])
    near = at.select(*keys, F.col("i").alias("j"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("az").alias("bz"), "cx", "cy", "cz", F.inline(steps))
    near = near.select(*keys, "j", "bx", "by", "bz", "own", *[(F.col(f"c{c}") + F.col(f"s{c}")).alias(f"c{c}") for c in "xyz"])
    d = distance(*[F.col(c) for c in ("ax", "ay", "az", "bx", "by", "bz")])
    met = at.join(near, [*keys, "cx", "cy", "cz"]).filter(~F.col("own") | (F.col("i") < F.col("j")))
    return met.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), d.alias("d")).filter((F.col("d") > 0) & (F.col("d") < cutoff))
