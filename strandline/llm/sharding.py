"""Sharding by histogram sort. DataFrame functions only.

Rows are ordered by one integer key: 12 bits of the text's MD5 (a cell), then
48 bits of the id's. Splitters for equal bytes are found by rounds of
probes: each round counts the exact bytes in the equal parts of every open
splitter's interval over all partitions and keeps the part in which the
splitter lies. The first round probes the cells' own borders, so equal texts
stay in one shard unless equal sizes forbid it. Rows move once, at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.base import cut

CELL_BITS, ID_BITS = 12, 48
#: Parts of an interval in the later rounds.
PROBES = 1024


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys at which shards 1.. begin. keyed: (key, size). What comes to the driver is bounded: shards x PROBES sums a round."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    open_ = {s: (0, 1 << (CELL_BITS + ID_BITS), 0) for s in range(shards - 1)}
    out: dict[int, int] = {}
    while open_:
        spans = sorted({(lo, hi, below) for lo, hi, below in open_.values()})
        first = spans[0][1] - spans[0][0] == 1 << (CELL_BITS + ID_BITS)
        probes = 1 << CELL_BITS if first else PROBES
        bin_, steps = F.lit(None).cast("long"), []
        for i, (lo, hi, _) in enumerate(spans):
            steps.append(max(1, -(-(hi - lo) // probes)))
            bin_ = F.when((F.col("key") >= lo) & (F.col("key") < hi), F.lit(i * probes) + F.expr(f"(key - {lo}L) div {steps[-1]}L")).otherwise(bin_)
        got = {r["bin"]: r["bytes"] for r in keyed.select(bin_.alias("bin"), "size").filter("bin is not null").groupBy("bin").agg(F.sum("size").alias("bytes")).collect()}
        for s, (lo, hi, below) in list(open_.items()):
            i = spans.index((lo, hi, below))
            step, edge, at = steps[i], lo, below
            for b in range(probes):
                more = got.get(i * probes + b, 0)
                if at + more > goals[s]:
                    break
                at, edge = at + more, lo + (b + 1) * step
            nearer, other = goals[s] - at, at + more - goals[s]
            if min(nearer, other) <= slack or step == 1:
                out[s] = edge if nearer <= other else edge + step
                del open_[s]
            else:
                open_[s] = (edge, min(hi, edge + step), at)
    keys = [out[s] for s in range(shards - 1)]
    return [max(keys[: i + 1]) for i in range(len(keys))]


def histogram_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, tolerance: float = 0.002, extra: dict | None = None) -> DataFrame:
    """(doc_id, size, *extra, shard, slot) for each row: shards of near equal bytes, slots without gaps in each.

    Size: UTF-8 bytes plus 1; null or empty text: 1. Null and empty texts are
    equal. Null ids share one key.
    Repeated rows have neighbouring slots. Empty table: empty result. A shard
    differs from the ideal by `tolerance` of it, or by a part of the row on
    its border where rows are larger than that. A hot text is one cell; its
    rows are spread over tasks by the id's hash, in parts of about the square
    root of all rows.
    """
    extra = extra or {}
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    bits = lambda text, digits: F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
    cell = bits(F.coalesce(F.col(text_col), F.lit("")), CELL_BITS // 4)
    low = bits(F.concat(F.lit("id:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), ID_BITS // 4)
    base = cut(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), (F.shiftleft(cell, ID_BITS) + low).alias("key"), *[c.alias(k) for k, c in extra.items()]))
    per_part = max(1, math.isqrt(base.count()))
    splitters = find_splitters(base.select("key", "size"), shards, tolerance)
    shard = sum((F.when(F.col("key") >= F.lit(k), 1).otherwise(0) for k in splitters), F.lit(0))
    rows = base.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright("key", ID_BITS).cast("int"))
    # A row for each of the 4096 cells at most, so the broadcast is bounded.
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_part)).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(cells), "cell")
    fine = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << ID_BITS) - 1)), 20) * F.col("parts")
    rows = rows.withColumn("part", F.shiftright(fine, ID_BITS - 20)).drop("parts")
    counts = rows.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "cell", "part").orderBy("key", "doc_id", "size")
    placed = rows.withColumn("rn", F.row_number().over(within)).join(starts, ["shard", "cell", "part"])
    return placed.select("doc_id", "size", *extra, "shard", (F.col("start") + F.col("rn") - 1).alias("slot"))
