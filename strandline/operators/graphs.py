"""Graph operators over pairs of keys: an independent set by local priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.relational import pairs_by_rule
from strandline.sources.scratch import computed_once


def independent(nodes: DataFrame, pairs: DataFrame, key: str = "key", prefer: list | None = None, seed: int = 0) -> DataFrame:
    """(key, kept, partner) for each distinct key of `nodes`: a maximal set of keys no two of which are a pair.

    pairs (query, target), in any order and number; pairs with oneself, with a
    null, or with a key that is not in `nodes` say nothing. A key is kept if
    none of its partners that come before it is kept, so the result is that of
    going through the keys one by one, whatever the partitions. Before comes
    what `prefer` (sort expressions over the columns of `nodes`) puts first,
    then what a seeded hash does. partner: for a key that is not kept, the
    first of the kept keys that it is paired with. Rows that repeat a key
    count as their first one. Empty tables: every key is kept.

    A round decides every key that has no undecided partner before it, and
    drops what is paired with these; joins and a checkpoint for each. With the
    hash alone the number of rounds grows with the logarithm of the keys; an
    order of `prefer` that runs along a long chain of pairs takes more.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    named = {f"__p{n}": c for n, c in enumerate(prefer or [])}
    # A number by which all keys are in order: a sort of the keys, once.
    first = nodes.filter(F.col(key).isNotNull()).withColumn("__mark", mark)
    ordered = first.orderBy(*named.values(), "__mark", key).select(F.col(key).alias("id")).withColumn("at", F.monotonically_increasing_id())
    places = computed_once(ordered).groupBy("id").agg(F.min("at").alias("at"))
    places = computed_once(places)
    a, b = places.select(F.col("id").alias("query"), F.col("at").alias("a")), places.select(F.col("id").alias("target"), F.col("at").alias("b"))
    met = pairs.select("query", "target").join(a, "query").join(b, "target").filter("a <> b")
    edges = computed_once(met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    # Keys without a partner before them are decided at once.
    free = edges.select(F.col("hi").alias("at")).distinct()
    kept = computed_once(places.select("at").join(free, "at", "left_anti"))
    open_, whole, rest = computed_once(free), kept, edges
    while not open_.isEmpty():
        dropped = rest.join(kept.select(F.col("at").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("at")).distinct()
        dropped = computed_once(dropped)
        rest = rest.join(dropped.select(F.col("at").alias("lo")), "lo", "left_anti").join(dropped.select(F.col("at").alias("hi")), "hi", "left_anti").join(kept.select(F.col("at").alias("lo")), "lo", "left_anti")
        rest = computed_once(rest.select("lo", "hi"))
        left = open_.join(dropped, "at", "left_anti")
        kept = computed_once(left.join(rest.select(F.col("hi").alias("at")).distinct(), "at", "left_anti"))
        open_ = computed_once(left.join(kept, "at", "left_anti"))
        whole = whole.unionByName(kept)
    why = edges.join(whole.select(F.col("at").alias("lo")), "lo", "left_semi").groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("lo"))
    names = places.select(F.col("id").alias("partner"), F.col("at").alias("lo"))
    out = places.join(whole.withColumn("kept", F.lit(True)), "at", "left").join(why, "at", "left").join(names, "lo", "left")
    return out.select(F.col("id").alias(key), F.coalesce("kept", F.lit(False)).alias("kept"), F.when(F.col("kept").isNull(), F.col("partner")).alias("partner"))


def drop_related(stats: DataFrame, pairs: DataFrame, rule: str, key: str = "pidc", prefer: list | None = None, seed: int = 0) -> DataFrame:
    """Rows of `stats` without those that a named pair rule relates to a row that stays.

    pairs: query, target and the measures that the rule reads; where one is
    missing the rule does not hold. Rows with a null key stay.
    """
    found = independent(stats, pairs_by_rule(pairs, rule), key, prefer, seed)
    return stats.join(found.filter(~F.col("kept")).select(key), key, "left_anti")
