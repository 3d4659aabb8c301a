"""Relational operators over parsed structures and their summaries. All are DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions.columns import mask_low_occupancy, unless, unlike
from strandline.sources.scratch import computed_once

XYZ = ("A_Cartn_x", "A_Cartn_y", "A_Cartn_z")
#: Versioned rule sets: which chains a dataset version leaves out, as SQL predicates over chain statistics.
VERSIONS: dict[str, list[str]] = {
    "raw": [],
    "multi_model": ["model_count < 2"],
    "v0.9": ["model_count < 2", "CA_count < 3"],
    "extreme": ["model_count < 2", "CA_count < 3", "meanRMSD > 10 AND stdevRMSD < 0.01 AND meanTMS < 0.2 AND stdevTMS < 0.1"],
}

#: Rules that pairs of chains satisfy: hits (fractions for coverage) with the spread of the two chains' models.
PAIR_RULES: dict[str, str] = {
    "identical": "pident >= 100 AND (qcov >= 1 OR tcov >= 1) AND (coalesce(meanRMSD < 1.0, false) OR coalesce(meanTMS = 1.0, false))",
    "homologous": "evalue < 1e-3 AND pident >= 30 AND alnlen >= 20 AND qcov >= 0.9 AND tcov >= 0.9",
}


# ---- from parsed files to coordinates


def drop_hetero(atoms: DataFrame, column: str = "A_group_PDB") -> DataFrame:
    return atoms.filter(unlike(F.col(column), "HETATM"))


def keep_alpha(atoms: DataFrame, column: str = "A_label_atom_id", name: str = "CA") -> DataFrame:
    return atoms.filter(F.col(column) == name)


def common_chains(atoms: DataFrame, scheme: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables, only chains that are in both."""
    a, s = [F.col("pid"), F.col("A_label_asym_id").alias("chain")], [F.col("pid"), F.col("S_asym_id").alias("chain")]
    atoms_in = atoms.withColumn("chain", F.col("A_label_asym_id")).join(scheme.select(*s).distinct(), ["pid", "chain"], "left_semi")
    scheme_in = scheme.withColumn("chain", F.col("S_asym_id")).join(atoms.select(*a).distinct(), ["pid", "chain"], "left_semi")
    return atoms_in, scheme_in


def join_scheme(atoms: DataFrame, scheme: DataFrame) -> DataFrame:
    """Atoms with their residue's scheme row, by residue number as text within a chain.

    The outer join followed by a filter on the atom's name keeps exactly the
    atoms, so it is a right join here.
    """
    keyed = scheme.withColumn("A_label_seq_id", F.col("S_seq_id"))
    return keyed.join(atoms, ["pid", "chain", "A_label_seq_id"], "right")


def coerce(df: DataFrame, doubles=(), longs=()) -> DataFrame:
    """Text to numbers; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in doubles} | {c: F.col(c).try_cast("bigint") for c in longs})


def mask_coordinates(df: DataFrame, occupancy: str = "A_occupancy", columns=XYZ, threshold: float = 0.5) -> DataFrame:
    return df.withColumns({c: mask_low_occupancy(F.col(c), F.col(occupancy), threshold) for c in columns})


def drop_missing(df: DataFrame, columns=("A_Cartn_x",)) -> DataFrame:
    return df.dropna(subset=list(columns))


def impute(df: DataFrame, value: float = 0.0, columns=XYZ) -> DataFrame:
    """Fill each missing coordinate with `value`."""
    return df.fillna(value, list(columns))


def parse_structures(atoms: DataFrame, scheme: DataFrame, fill: float | None = None) -> DataFrame:
    """atom_site and poly_seq rows (with pid) -> one row for each chain, model and residue."""
    atoms, scheme = common_chains(keep_alpha(drop_hetero(atoms)), scheme)
    df = join_scheme(atoms, scheme)
    df = coerce(df, doubles=(*XYZ, "A_occupancy"), longs=("A_id", "A_pdbx_PDB_model_num", "S_seq_id", "A_label_seq_id", "S_pdb_seq_num"))
    df = mask_coordinates(df)
    df = drop_missing(df) if fill is None else impute(df, fill)
    columns = ["A_pdbx_PDB_model_num", "S_seq_id", "S_mon_id", "A_label_atom_id", "A_id", *XYZ]
    return df.select("pid", "chain", F.concat_ws("_", "pid", "chain").alias("pidc"), *columns)


def missing_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be there and are not."""
    return expected.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def exclude(df: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not listed as outliers."""
    return df.join(exclusions.select(*keys), keys, "left_anti")


def long_enough(counts: DataFrame, least: int = 3, column: str = "CA_count") -> DataFrame:
    return counts.filter(F.col(column) >= least)


# ---- counts and statistics


def model_counts(atoms: DataFrame, key: str = "pidc", model: str = "A_pdbx_PDB_model_num") -> DataFrame:
    """Models and residues of each chain, and whether it has several models."""
    n, rows = F.countDistinct(model), F.count(F.lit(1))
    out = atoms.groupBy(key).agg(n.alias("model_count"), rows.alias("rows"))
    return out.select(key, "model_count", F.expr("rows div model_count").alias("CA_count"), F.when(F.col("model_count") > 1, "multi").otherwise("single").alias("kind"))


def mean_coordinates(atoms: DataFrame) -> DataFrame:
    """Mean and sample deviation of each residue's coordinates over the models."""
    per_axis = [f(c).alias(f"{name}_{c[-1]}") for c in XYZ for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return atoms.groupBy("pidc", "S_seq_id", "S_mon_id").agg(F.min_by("A_id", "A_pdbx_PDB_model_num").alias("A_id"), *per_axis)


def inconsistent_sequences(atoms: DataFrame) -> DataFrame:
    """Residues that are not the same in all models."""
    return atoms.groupBy("pidc", "S_seq_id").agg(F.countDistinct("S_mon_id").alias("kinds")).filter("kinds > 1")


def spread(df: DataFrame, keys: list[str], value: str, name: str, ddof: int = 1, digits: int | None = None, least: int = 1) -> DataFrame:
    """min, max, mean and deviation of a value; null with fewer than `least` values."""
    v = F.round(value, digits) if digits is not None else F.col(value)
    dev = F.stddev_samp(v) if ddof else F.stddev_pop(v)
    enough = lambda c: F.when(F.count(v) >= least, c)
    return df.groupBy(*keys).agg(enough(F.min(v)).alias(f"min{name}"), enough(F.max(v)).alias(f"max{name}"), enough(F.avg(v)).alias(f"mean{name}"), enough(dev).alias(f"stdev{name}"))


def group_to_list(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def frequency(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def tally(df: DataFrame, keys: list[str], success: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(success).alias("succeeded"), F.count_if(unless(success)).alias("failed"))


def quartiles(df: DataFrame, keys: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """accuracy: approximate quartiles with a relative rank error of 1 / accuracy, in bounded memory; else exact ones, which hold a group's distinct values."""
    shares = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    q = F.percentile(value, shares) if accuracy is None else F.percentile_approx(value, shares, accuracy)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lowest"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(value).alias("highest"))


def _ranked(df: DataFrame, keys: list[str], order: list, part: Column | None, name: str) -> DataFrame:
    """1-based row numbers within `keys`. Without keys the rows are numbered by parts of ranges, so that no task numbers them all.

    part: an expression that rises with the order; without it rows are dealt
    by range, and kept so in the shared folder.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    cut = df.withColumn("__part", part) if part is not None else computed_once(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = cut.withColumn("__rn", F.row_number().over(W.partitionBy("__part").orderBy(*order))).join(starts, "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__rn")).drop("__part", "__n", "__start", "__rn")


def binned_means(df: DataFrame, value: str, size: int, keys: list[str] | None = None, order: list | None = None, part: Column | None = None) -> DataFrame:
    """Means of consecutive values in sorted order, `size` at a time; a remainder is left out."""
    keys = keys or []
    numbered = _ranked(df, keys, order or [value], part, "rn")
    out = numbered.withColumn("bin", F.expr(f"(rn - 1) div {size}")).groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") == size).drop("n")


def density(df: DataFrame, value: str, factor: float = 0.4, points: int = 200) -> DataFrame:
    """Gaussian kernel density of a value on an even grid.

    Equal values are counted once, so the grid meets distinct values only;
    three numbers travel to the driver.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = factor * s["sd"]
    lo, hi = s["lo"] - 3 * h, s["hi"] + 3 * h
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(lo) + k * F.lit((hi - lo) / (points - 1)))).alias("x")
    z = (F.col("x") - F.col("v")) / h
    return counts.select("v", "n", at).groupBy("x").agg((F.sum(F.col("n") * F.exp(-0.5 * z * z)) / (s["n"] * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int = 50) -> DataFrame:
    bucket = F.least(F.lit(bins), F.expr(f"width_bucket({value}, {lo}, {hi}, {bins})"))
    return df.filter(F.col(value).between(lo, hi)).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_share(df: DataFrame, keys: list[str], order: list, value: str, name: str = "share") -> DataFrame:
    w = W.partitionBy(*keys)
    running = F.sum(value).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, running / F.sum(value).over(w))


# ---- ranking


def top_k(df: DataFrame, keys: list[str], score: str, k: int = 20, ties: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(score), *(ties or []))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_model(atoms: DataFrame, key: str = "pidc", model: str = "A_pdbx_PDB_model_num", order: str | None = None) -> DataFrame:
    """Rows of each chain's first model: the lowest number, or the first to appear by `order`."""
    first = atoms.groupBy(key).agg((F.min_by(model, order) if order else F.min(model)).alias("__first"))
    return atoms.join(first, key).filter(F.col(model) == F.col("__first")).drop("__first")


def sort_for_report(df: DataFrame, high: str, low: str, *ties: str) -> DataFrame:
    """Highest first, then lowest first; missing values last in both."""
    return df.orderBy(F.desc_nulls_last(high), F.asc_nulls_last(low), *ties)


def page(df: DataFrame, order: list, offset: int, rows: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(rows)


def flat_report(rows: DataFrame, stats: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of a group with the group's statistics on its first row only."""
    joined = rows.join(stats, key, "left").withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return joined.withColumns({c: F.when(F.col("__rn") == 1, F.col(c)) for c in columns}).drop("__rn")


# ---- sequence hits


def drop_self(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("query") != F.col("target"))


def dedupe_pairs(hits: DataFrame, order: str = "ordinal", parts: int | None = None) -> DataFrame:
    """The first hit of each unordered pair; at one place in the order the smaller query is first. parts: partitions in which they are sorted, else the session's."""
    keyed = hits.withColumns({"__a": F.least("query", "target"), "__b": F.greatest("query", "target")})
    if parts is not None:
        keyed = keyed.repartition(parts, "__a", "__b")
    w = W.partitionBy("__a", "__b").orderBy(order, "query", "target")
    return keyed.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__a", "__b")


def homology(evalue: float = 1e-3, pident: float = 30, alnlen: int = 20, qcov: float = 0.9, tcov: float = 0.9) -> Column:
    """Coverage is a fraction."""
    return (F.col("evalue") < evalue) & (F.col("pident") >= pident) & (F.col("alnlen") >= alnlen) & (F.col("qcov") >= qcov) & (F.col("tcov") >= tcov)


def split_homologues(hits: DataFrame, keep_self: bool = False, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(homologues, the others); null values are no homologues. keep_self: hits with oneself stay, as in older tables."""
    base = hits if keep_self else drop_self(hits)
    rule = homology(**thresholds)
    return base.filter(rule), base.filter(unless(rule))


def neighbours(hits: DataFrame, order: str = "ordinal") -> DataFrame:
    """For each key what it hits, then what hits it, each in file order."""
    there = hits.select(F.col("query").alias("key"), F.col("target").alias("other"), F.lit(0).alias("way"), order)
    back = hits.select(F.col("target").alias("key"), F.col("query").alias("other"), F.lit(1).alias("way"), order)
    ordered = F.sort_array(F.collect_list(F.struct("way", order, "other")))
    return there.unionByName(back).groupBy("key").agg(F.transform(ordered, lambda x: x["other"]).alias("homologues"))


# ---- dataset rules and summaries


def prune(stats: DataFrame, rules: list[str]) -> DataFrame:
    """Rows that no rule removes. A rule that is unknown (a null in it) removes nothing."""
    for rule in rules:
        stats = stats.filter(unless(F.expr(rule)))
    return stats


def pairs_by_rule(pairs: DataFrame, rule: str) -> DataFrame:
    """The pairs that satisfy a named rule; where a value it needs is missing they do not."""
    return pairs.filter(F.coalesce(F.expr(PAIR_RULES[rule]), F.lit(False)))


def dataset_version(stats: DataFrame, version: str) -> DataFrame:
    return prune(stats, VERSIONS[version])


def one_chain_each(chains: DataFrame, entry: str = "pid", key: str = "pidc", seed: int = 0) -> DataFrame:
    """One chain of each entry, chosen by a seeded hash (MD5, as SQL has it)."""
    w = W.partitionBy(entry).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return chains.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def chain_stats(counts: DataFrame, rmsd: DataFrame, tm: DataFrame, homologues: DataFrame) -> DataFrame:
    """One row a chain: counts, RMSD and TM statistics, homologues; inputs keyed by pidc, missing ones null."""
    out = counts.select("pidc", "CA_count", "model_count").join(rmsd, "pidc", "left").join(tm, "pidc", "left").join(homologues.select(F.col("key").alias("pidc"), "homologues"), "pidc", "left")
    return out.withColumn("homologues", F.coalesce("homologues", F.array().cast("array<string>"))).withColumnRenamed("pidc", "Pidc")


def entry_stats(entries: DataFrame, chains: DataFrame, homomeric: DataFrame) -> DataFrame:
    """One row an entry: title, chains, kind, year, protein chains.

    entries (pid, head, year, all_chains), chains (pid, pidc), homomeric (pid).
    """
    listed = chains.groupBy("pid").agg(F.sort_array(F.collect_set("pidc")).alias("all_prot_only_chains"))
    flag = homomeric.select("pid").distinct().withColumn("__hom", F.lit(True))
    out = entries.join(flag, "pid", "left").join(listed, "pid", "left")
    return out.select(F.col("pid").alias("Pid"), "head", "all_chains", F.when(F.col("__hom"), "hom").otherwise("het").alias("hethom"), "year", "all_prot_only_chains")


def transfer_plan(datasets: DataFrame, chains: DataFrame, archives: DataFrame, done: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Tasks still to do: every archive of every chain of every dataset, but for those done. The three lists are configuration."""
    tasks = datasets.join(chains, "dataset").join(archives, "dataset")
    if only is not None:
        tasks = tasks.join(only, "pidc", "left_semi")
    return tasks.join(done, ["dataset", "pidc", "archive"], "left_anti")


def expect(df: DataFrame, rows: int, what: str = "rows") -> DataFrame:
    """`df`, or an error if it has another number of rows. The count is one action."""
    n = df.count()
    if n != rows:
        raise ValueError(f"expected {rows} {what}, found {n}")
    return df


def search_entries(meta: DataFrame, heteromeric: bool, rows: int, method: str = "SOLUTION NMR") -> DataFrame:
    """Best-scored entries with one kind of protein in several copies, or with several kinds."""
    rule = (F.col("protein_entities") > 1) if heteromeric else (F.col("protein_entities") == 1) & (F.col("protein_instances") > 1)
    return meta.filter((F.col("method") == method) & rule).orderBy(F.desc("score"), "pid").limit(rows)
