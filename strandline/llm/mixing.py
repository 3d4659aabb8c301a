"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source is a stream of words: its documents in a hashed order, one after
another, cut into blocks of `block_words`. The schedule is a row of slots;
slot i takes the point frac((i + 1/2) * golden ratio), mapped through the
sources' cumulative shares to a source. The slots of a source are ranked, and
rank r reads block r modulo the source's blocks; the last slot of a source is
cut where its target is met. Golden-ratio points leave each source at most
O(log slots) slots away from its share at any prefix; what a source still
lacks at the end is appended as closing slots.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.llm.base import cut, hex_order

#: Fixed value: the golden ratio's fractional part.
GOLDEN = 0.6180339887498949
#: The order key has 60 bits; cells are the equal parts of [0, 1) by which points meet sources.
ORDER_BITS, CELLS = 60, 1024
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
SALTS = 64


def word_count(text):
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """totals (skey, source_size), a row for each source -> with target.

    The level at which sources stop gaining is found in one pass: by falling
    need, a prefix of the sources is capped, and the rest share what is left
    by weight. All windows here run over one row for each source.
    """
    one = W.partitionBy(F.lit(0))
    n = len(weights)
    at = F.row_number().over(one.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(at, F.lit(n)) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(one))
    before = one.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(one)["level"])
    return t.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).select("skey", "source_size", "target", "goal")


def schedule(targets: DataFrame, slots: int, block_words: int) -> DataFrame:
    """(skey, slot, rank, block, upto): the slots in use; `upto`: words of the block that the slot reads."""
    spark = targets.sparkSession
    upto_now = W.partitionBy(F.lit(0)).orderBy("skey").rowsBetween(W.unboundedPreceding, 0)
    t = targets.filter("source_size > 0").withColumn("words", F.round("target").cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    t = t.withColumn("rounds", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    t = t.withColumn("needed", F.expr(f"rounds * blocks + (rest + {block_words - 1}) div {block_words}"))
    t = t.withColumn("hi", F.sum("target").over(upto_now) / F.col("goal"))
    t = t.withColumn("lo", F.lag("hi", 1, 0.0).over(W.partitionBy(F.lit(0)).orderBy("skey")))
    t = t.withColumn("hi", F.when(F.lead("skey").over(W.partitionBy(F.lit(0)).orderBy("skey")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    t = t.withColumn("at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("skey")) - 1).withColumn("sources", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    t = t.select("skey", "blocks", "rounds", "rest", "needed", "lo", "hi", "at", "sources")
    by_cell = t.select("skey", "lo", "hi", F.explode(F.expr(f"sequence(least({CELLS - 1}, cast(floor(lo * {CELLS}) as int)), least({CELLS - 1}, cast(floor(hi * {CELLS}) as int)))")).alias("cell"))
    point = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(F.col("u") * CELLS).cast("int")))
    dealt = points.join(by_cell, (points.cell == by_cell.cell) & (points.u >= by_cell.lo) & (points.u < by_cell.hi)).select("skey", "slot")
    chunk = max(1, math.isqrt(max(slots, 1)))
    dealt = cut(dealt.withColumn("chunk", F.expr(f"slot div {chunk}")))
    counts = dealt.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    ranked = dealt.withColumn("rn", F.row_number().over(W.partitionBy("skey", "chunk").orderBy("slot"))).join(starts, ["skey", "chunk"])
    ranked = ranked.select("skey", "slot", (F.col("start") + F.col("rn") - 1).alias("rank"))
    given = dealt.groupBy("skey").agg(F.count(F.lit(1)).alias("given"))
    t = t.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    closing = t.filter("needed > given").select("skey", "at", "sources", F.explode(F.expr("sequence(given, needed - 1)")).alias("rank"))
    # Closing slots come after all others, by rank, and no two sources share one.
    every = ranked.unionByName(closing.select("skey", (F.lit(slots) + F.col("rank") * F.col("sources") + F.col("at")).alias("slot"), "rank"))
    used = every.join(t.select("skey", "blocks", "rounds", "rest", "needed"), "skey").filter("rank < needed")
    full, last = F.lit(block_words), F.expr(f"rest - (rank - rounds * blocks) * {block_words}")
    return used.select("skey", "slot", "rank", F.expr("rank % blocks").alias("block"), F.when(F.expr("rank div blocks >= rounds"), F.least(full, last)).otherwise(full).alias("upto"))


def _scheduled(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, cap, block_words: int, seed: int, extra: dict) -> tuple[DataFrame, DataFrame]:
    """Each reading of a row's words in a slot, in the schedule's numbering (slot null: words never read), and the rows without words."""
    skey = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    base = cut(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), skey.alias("skey"), hex_order(F.col(id_col), seed).alias("okey"), *[c.alias(k) for k, c in extra.items()]))
    rows = base.count()
    width = (1 << ORDER_BITS) // max(1, math.isqrt(rows)) + 1
    base = base.withColumn("part", F.expr(f"okey div {width}"))
    parts = cut(base.groupBy("skey", "part").agg(F.sum("size").alias("words")))
    targets = cut(source_targets(parts.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, cap))
    goal = (targets.agg(F.max("goal")).first() or [0])[0] or 0.0
    slots = schedule(targets, math.ceil(goal / block_words), block_words)

    earlier = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(targets, "skey").select("skey", "part", "start", "source_size", "target")
    inside = W.partitionBy("skey", "part").orderBy("okey", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("upto_here", F.sum("size").over(inside)).join(offsets, ["skey", "part"]).withColumn("a", F.col("start") + F.col("upto_here") - F.col("size"))
    kept = ["doc_id", "size", "source_size", "target", "source", *extra]
    none = placed.filter("size = 0").select(*kept)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(a div {block_words}, (a + size - 1) div {block_words})")))
    pieces = pieces.select("skey", "a", *kept, "block", F.expr(f"greatest(a - block * {block_words}, 0)").alias("from_"), F.expr(f"least(a + size - block * {block_words}, {block_words})").alias("to_"))
    read = pieces.join(slots.select("skey", "block", "slot", "upto"), ["skey", "block"], "left").withColumn("slot", F.when(F.col("upto") > F.col("from_"), F.col("slot")))
    before = F.col("block") * F.lit(block_words) - F.col("a")
    return read.select("skey", "a", *kept, "slot", F.col("from_").alias("at"), (before + F.col("from_")).alias("word_from"), (before + F.least("to_", F.coalesce("upto", "to_"))).alias("word_to")), none


def interleave_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, cap=CAP, block_words: int = 256, seed: int = 17, extra: dict | None = None) -> DataFrame:
    """The mix itself: (slot, at, source, doc_id, word_from, word_to, *extra), a row for each reading of words word_from <= w < word_to of a row.

    Ordered by (slot, at) the rows are the interleaved stream; `at` is the
    first word's place in its slot. All words of a slot are of one source.
    Rows and options are those of `mix_sources`.
    """
    extra = extra or {}
    read, _ = _scheduled(docs, id_col, text_col, source_col, weights, share, cap, block_words, seed, extra)
    return read.filter("slot is not null").select("slot", "at", "source", "doc_id", "word_from", "word_to", *extra)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, cap=CAP, block_words: int = 256, seed: int = 17, extra: dict | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots, source, *extra) for each row of `docs`.

    taken: its words in `interleave_sources`; first_slot: the first slot of the
    schedule that reads it (null: none does); n_slots: how many slots do.

    Null text: size 0, taken 0. A null source is a source, the last one.
    Repeated rows each have words of their own. Ties in the order key fall by
    id and size, so reruns agree. Empty table: empty result. Only ids, sizes
    and sources are shuffled; a source's rows are ordered in hashed parts of
    about the square root of all rows, so no task gets a whole source.
    `extra`: further columns to carry, name -> Column.
    """
    extra = extra or {}
    read, none = _scheduled(docs, id_col, text_col, source_col, weights, share, cap, block_words, seed, extra)
    kept = ["doc_id", "size", "source_size", "target", "source", *extra]
    got = F.when(F.col("slot").isNull(), F.lit(0)).otherwise(F.col("word_to") - F.col("word_from"))
    some = read.groupBy("skey", "a", *kept).agg(F.sum(got).cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    never = none.select(*kept, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    return some.select(*kept, "taken", "first_slot", "n_slots").unionByName(never).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots", "source", *extra)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **options) -> DataFrame:
    """The mix in whole documents: each row of `docs` as often as the schedule reads it, columns as they are.

    A row counts as read once for each full reading, a last reading by the
    nearest whole number; each source has at most one read in part. Null and
    empty texts, and those without words, are never read. A null source is a
    source, the last one; a null id is an id. Rows that share id and text are
    read as often, together, as the schedule reads them all: their readings are
    dealt out evenly. Columns may have any names; none is read but the three
    named. Empty table: empty result. slot_col: a further column with the first
    slot of the schedule that reads a row's id and text, by which the rows are
    in the order of the mix.
    """
    named = (f"mixed_{k}" for k in itertools.count())
    content, group, copies, rows, slot, salt, place, before = (next(n for n in named if n not in docs.columns) for _ in range(8))
    digest = F.xxhash64(F.col(text_col))
    taken = mix_sources(docs, id_col, text_col, source_col, extra={"content": digest}, **options)
    times = F.expr("cast(floor(taken / size + 0.5) as int)")
    # Rows that are not read are in the number of rows, too.
    groups = taken.filter("size > 0").groupBy("doc_id", "content").agg(F.sum(times).alias(copies), F.count(F.lit(1)).alias(rows), F.min("first_slot").alias(slot))
    groups = cut(groups.filter(F.col(copies) > 0).select(F.col("doc_id").alias(group), F.col("content").alias(place), copies, rows, slot))
    keyed = docs.withColumn(content, digest)
    each, more = F.expr(f"`{copies}` div `{rows}`"), F.expr(f"`{copies}` % `{rows}`")

    def read(some):
        met = keyed.join(some, keyed[id_col].eqNullSafe(some[group]) & (keyed[content] == some[place]))
        return met.select(*[keyed[c] for c in docs.columns], content, copies, rows, slot)

    kept = [*docs.columns, slot, place]
    whole = read(groups.filter(more == 0)).withColumn(place, each).select(*[F.col(f"`{c}`") for c in kept])
    uneven = groups.filter(more > 0)
    if not uneven.isEmpty():
        whole = whole.unionByName(_dealt_out(read(uneven), id_col, content, copies, rows, salt, place, before).select(*[F.col(f"`{c}`") for c in kept]))
    whole = whole.filter(F.col(place) > 0).withColumn(content, F.explode(F.sequence(F.lit(1), F.col(place).cast("int"))))
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(slot).alias(slot_col)] if slot_col else []))


def _dealt_out(met: DataFrame, id_col: str, content: str, copies: str, rows: str, salt: str, place: str, before: str) -> DataFrame:
    """Repeated rows with `place`, their own number of readings: the first ones are read once more. They are numbered in salted parts, as they may be many."""
    odd = cut(met.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    key, number = [F.col(id_col), F.col(content)], f"{rows}_n"
    parts = odd.groupBy(*key, salt).agg(F.count(F.lit(1)).alias(place))
    earlier = F.coalesce(F.sum(place).over(W.partitionBy(*key).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(id_col).alias("i"), F.col(content).alias("c"), F.col(salt).alias("s"), earlier.alias(before))
    same = odd[id_col].eqNullSafe(starts["i"]) & (odd[content] == starts["c"]) & (odd[salt] == starts["s"])
    numbered = odd.withColumn(number, F.row_number().over(W.partitionBy(*key, salt).orderBy(F.lit(0)))).join(starts, same).select(*[odd[c] for c in odd.columns], number, before)
    once_more = F.col(before) + F.col(number) <= F.expr(f"`{copies}` % `{rows}`")
    return numbered.withColumn(place, F.expr(f"`{copies}` div `{rows}`") + F.when(once_more, 1).otherwise(0))
