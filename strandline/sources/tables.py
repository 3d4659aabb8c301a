"""Text tables, key lists, FASTA, scraped HTML rows, matrices."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from strandline.schemas import HITS, SSV
from strandline.sources.scratch import exists, replace


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_ssv(spark: SparkSession, path: str) -> DataFrame:
    """Parsed chains, one space-separated file each, keyed by file name."""
    rows = spark.read.schema(SSV).option("sep", " ").option("header", True).csv(path)
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return rows.select(key.alias("pidc"), F.split_part(key, F.lit("_"), F.lit(1)).alias("pid"), F.split_part(key, F.lit("_"), F.lit(2)).alias("chain"), *SSV.names)


def read_written_ssv(spark: SparkSession, path: str) -> DataFrame:
    """The chains that `write_ssv` wrote, keyed by their folder's name."""
    kept = StructType([StructField("pidc", StringType()), *SSV.fields])
    return spark.read.schema(kept).option("sep", " ").option("header", True).csv(path).select("pidc", *SSV.names)


def write_hits(hits: DataFrame, path: str, sep: str = "\t") -> None:
    hits.select(*HITS.names).write.mode("overwrite").option("sep", sep).csv(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(id, states) of a FASTA file of structural-alphabet strings, as an external encoder writes them: twenty letters, in either case."""
    return read_fasta(spark, path).select("id", F.upper("seq").alias("states"))


def attach_states(sequences: DataFrame, states: DataFrame) -> DataFrame:
    """(id, seq, states, problem) of all ids on either side: problem says why the two strings do not belong together, or is null."""
    both = sequences.select("id", "seq").join(states.select("id", "states"), "id", "full_outer")
    problem = F.when(F.col("seq").isNull(), "no sequence").when(F.col("states").isNull(), "no states").when(F.length("seq") != F.length("states"), "different lengths").when(F.col("states").rlike("[^ACDEFGHIKLMNPQRSTVWY]"), "unknown state")
    return both.select("id", "seq", "states", problem.alias("problem"))


def read_hits(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Search hits with their place in the file as `ordinal`: unique, and rising within a file."""
    return spark.read.schema(HITS).option("sep", sep).csv(path).withColumn("ordinal", F.monotonically_increasing_id())


def read_keys(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Keys separated by white space, sorted and distinct; the first `skip` lines of each file are headings."""
    files = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text"))
    lines = files.select(F.posexplode(F.split("text", "\r?\n")).alias("no", "line")).filter(F.col("no") >= skip)
    return lines.select(F.explode(F.split(F.trim("line"), r"\s+")).alias("key")).filter("key <> ''").distinct().orderBy("key")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of FASTA records."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]*)", 1)
    return records.select(head.alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "").alias("seq"))


def scrape_rows(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Conformer table rows of HTML: (keep, row, Protein name, Conformers, Family).

    A row needs a name cell and a cell of identifiers; the family is its
    link's text or null. Identifiers keep their first order, once each.
    """
    row = F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr")
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    ids = F.array_distinct(F.regexp_extract_all(plain(F.get("cells", F.lit(1))), F.lit(r"\b[0-9][A-Za-z0-9]{3}\b"), F.lit(0)))
    link = F.regexp_extract("tr", r"(?is)<a\b[^>]*>(.*?)</a>", 1)
    rows = pages.select(*(keep or []), row).withColumn("cells", cells).filter(F.size("cells") >= 2)
    rows = rows.select(*(keep or []), "row", plain(F.get("cells", F.lit(0))).alias("Protein name"), ids.alias("Conformers"), F.nullif(plain(link), F.lit("")).alias("Family"))
    return rows.filter("`Protein name` <> ''")


def read_matrices(spark: SparkSession, path: str, member: str = "mat") -> DataFrame:
    """(pidc, i, j, value) of square matrices in NPZ files, i and j from 1."""
    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.npz$", 1).alias("pidc"), "content")

    def run(frames):
        for pdf in frames:
            for key, content in zip(pdf["pidc"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content))[member]
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"pidc": key, "i": i.ravel() + 1, "j": j.ravel() + 1, "value": m.ravel().astype(float)})

    return files.mapInPandas(run, "pidc string, i int, j int, value double")


def read_search_response(responses: DataFrame, column: str = "body") -> DataFrame:
    """Identifiers and scores of a search service's JSON answers, best first."""
    schema = "result_set array<struct<identifier: string, score: double>>"
    return responses.select(F.inline(F.from_json(column, schema)["result_set"])).orderBy(F.desc("score"), "identifier")


def read_trajectories(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Trajectory tables: Parquet in long form takes the place of a hierarchical file."""
    return spark.read.schema(schema).parquet(path)


def trajectory_problems(topology: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Systems whose topology and trajectory differ in atoms, or that lack one of them. Both (pidc, atoms)."""
    both = topology.select("pidc", F.col("atoms").alias("topology_atoms")).join(trajectory.select("pidc", F.col("atoms").alias("trajectory_atoms")), "pidc", "full_outer")
    return both.filter(~F.col("topology_atoms").eqNullSafe(F.col("trajectory_atoms")))


# ---- sinks


def write_chains(atoms: DataFrame, path: str) -> None:
    """The coordinate table, rewritten whole, sorted within files so that a chain's row groups are few."""
    atoms.repartitionByRange("pidc").sortWithinPartitions("pidc", "A_pdbx_PDB_model_num", "S_seq_id").write.mode("overwrite").parquet(path)


def write_ssv(atoms: DataFrame, path: str) -> None:
    atoms.select("pidc", *SSV.names).repartition("pidc").sortWithinPartitions("pidc", "A_pdbx_PDB_model_num", "S_seq_id").write.mode("overwrite").partitionBy("pidc").option("sep", " ").option("header", True).csv(path)


def write_keys(keys: DataFrame, path: str, column: str = "pidc", per_line: int = 1, heading: str | None = None) -> None:
    """Sorted distinct keys, several on a line if asked, under a heading with their number."""
    ordered = keys.select(F.col(column).alias("k")).distinct()
    if per_line == 1 and heading is None:
        ordered.orderBy("k").write.mode("overwrite").text(path)
        return
    # A list file is one file by nature: keys, not rows of data.
    n = F.row_number().over(W.orderBy("k")) - 1
    lines = ordered.withColumn("n", n).groupBy(F.expr(f"n div {per_line}").alias("line")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("n", "k"))), lambda x: x["k"])).alias("value"))
    if heading is not None:
        lines = lines.unionByName(ordered.agg(F.lit(-1).cast("long").alias("line"), F.format_string(heading, F.count(F.lit(1))).alias("value")))
    lines.orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(path)


def update_keys(spark: SparkSession, keys: DataFrame, path: str, column: str = "pidc") -> None:
    """Add keys to a list: union, distinct, sorted. The new list is written beside the old one and takes its place when it is complete."""
    fresh = keys.select(F.col(column).alias("key"))
    if exists(spark, path):
        fresh = fresh.unionByName(read_keys(spark, path)).distinct()
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    write_keys(fresh, new, "key")
    replace(spark, new, path)


def write_fasta(sequences: DataFrame, path: str, width: int = 80, legacy: bool = False) -> None:
    from strandline.functions.columns import fasta_wrap

    sequences.select(F.concat(F.lit(">"), "id", F.lit("\n"), fasta_wrap(F.col("seq"), width, legacy)).alias("value")).write.mode("overwrite").text(path)


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """(id, seq): one-letter sequences of each chain's first model."""
    from strandline.functions.columns import aa3_to_1
    from strandline.operators.relational import first_model

    rows = first_model(atoms).groupBy("pidc").agg(F.sort_array(F.collect_list(F.struct("S_seq_id", aa3_to_1(F.col("S_mon_id")).alias("a")))).alias("r"))
    return rows.select(F.col("pidc").alias("id"), F.concat_ws("", F.transform("r", lambda x: x["a"])).alias("seq"))


def write_clusters(maps: DataFrame, path: str, column: str = "clusters") -> None:
    maps.select("chain", F.to_json(column).alias(column)).write.mode("overwrite").json(path)


def write_top_pairs(top: DataFrame, path: str) -> None:
    """Lines like (3, 7) 0.125, best first, one folder a chain."""
    line = F.format_string("(%d, %d) %.3f", "m1", "m2", "score")
    top.repartition("chain").sortWithinPartitions("chain", "rank").select("chain", line.alias("value")).write.mode("overwrite").partitionBy("chain").text(path)


def alignment_text(rows: DataFrame, style: str = "full") -> DataFrame:
    """(query, target, text) of aligned pairs (query, target, tm1, tm2, rmsd, n_ali, seq_x, marks, seq_y).

    style full: names, lengths, scores and the alignment; table: one line of
    tab-separated numbers; fasta: the two gapped sequences. Pairs that could
    not be aligned have no text.
    """
    length = lambda c: F.length(F.regexp_replace(c, "-", ""))
    same = F.aggregate(F.zip_with(F.split("seq_x", ""), F.split("seq_y", ""), lambda a, b: ((a == b) & (a != "-")).cast("int")), F.lit(0), lambda n, v: n + v)
    if style == "full":
        text = F.format_string("Structures: %s (%d residues), %s (%d residues)\nAligned: %d, RMSD: %.2f, identical: %.3f\nTM-score: %.4f by the first, %.4f by the second\n\n%s\n%s\n%s\n", F.col("query"), length("seq_x"), F.col("target"), length("seq_y"), F.col("n_ali"), F.col("rmsd"), same / F.greatest(F.col("n_ali"), F.lit(1)), F.col("tm1"), F.col("tm2"), F.col("seq_x"), F.col("marks"), F.col("seq_y"))
    elif style == "table":
        text = F.format_string("%s\t%s\t%.4f\t%.4f\t%.2f\t%.3f\t%d\t%d\t%d", F.col("query"), F.col("target"), F.col("tm1"), F.col("tm2"), F.col("rmsd"), same / F.greatest(F.col("n_ali"), F.lit(1)), length("seq_x"), length("seq_y"), F.col("n_ali"))
    elif style == "fasta":
        text = F.format_string(">%s\n%s\n>%s\n%s\n", F.col("query"), F.col("seq_x"), F.col("target"), F.col("seq_y"))
    else:
        raise ValueError(f"no style {style}")
    return rows.select("query", "target", F.when(F.col("rmsd").isNotNull(), text).alias("text"))


def write_report(df: DataFrame, path: str) -> None:
    """Parquet beside a CSV whose list cells are JSON."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def write_matrices(matrix: DataFrame, path: str) -> None:
    matrix.repartitionByRange("pidc").write.mode("overwrite").parquet(path)
