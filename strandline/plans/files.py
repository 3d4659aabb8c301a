"""Queries through files: tables are written by the sinks, or as structure files, and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import distance
from strandline.operators import ensemble, relational
from strandline.plans.tables import hits, points, table
from strandline.schemas import ATOM_SITE, POLY_SEQ
from strandline.sources import named, structures, tables
from strandline.sources.scratch import fresh_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_PTS = """pts AS (SELECT label AS chain, vec_id AS model, (r + 1)::BIGINT AS seq, embedding[3*r+1]::DOUBLE AS x, embedding[3*r+2]::DOUBLE AS y, embedding[3*r+3]::DOUBLE AS z
  FROM embeddings, range(21) t(r))"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _listed(rows: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """The lines of each key, in order, as one text. A file is one value by nature."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line))), lambda r: r[line])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("lines"))


def cif_files(spark, d) -> DataFrame:
    """(pid, text): each chain as an mmCIF file with its models; every tenth residue has a low occupancy, every model a hetero atom."""
    p = points(spark, d)
    ca = p.select(F.concat(F.lit("E"), F.col("chain").cast("string")).alias("pid"), "model", "seq", F.format_string("ATOM %d CA ALA A %d %s %s %s %s %d", F.col("model") * 100 + F.col("seq"), "seq", *[F.col(c).cast("string") for c in "xyz"], F.when(F.col("seq") % 10 == 0, "0.30").otherwise("1.00"), "model").alias("line"))
    het = p.filter("seq = 1").select(F.concat(F.lit("E"), F.col("chain").cast("string")).alias("pid"), "model", F.lit(99).cast("long").alias("seq"), F.format_string("HETATM %d CA CA A . 9.0 9.0 9.0 1.00 %d", F.col("model") * 100 + 99, "model").alias("line"))
    body = _listed(ca.unionByName(het), "pid", ["model", "seq"], "line")
    loop = lambda category, names: "loop_\n" + "\n".join(f"{category}.{n}" for n in names) + "\n"
    head = F.format_string("data_%s\n_struct.title 'Entry %s'\n_pdbx_database_status.recvd_initial_deposition_date 1999-03-04\n", "pid", "pid")
    scheme = loop("_pdbx_poly_seq_scheme", structures.SCHEME_FIELDS.values()) + "\n".join(f"{k} ALA {k} A" for k in range(1, 23)) + "\n"
    return body.select("pid", F.concat(head, F.lit(loop("_atom_site", structures.ATOM_FIELDS.values())), "lines", F.lit("\n#\n" + scheme)).alias("text"))


@query("cif_parse", f"WITH {_PTS} SELECT 'E' || chain AS pid, 'A' AS chain, 'E' || chain || '_A' AS pidc, model, seq, 'ALA' AS mon, model * 100 + seq AS atom_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM pts WHERE seq % 10 <> 0")
def cif_parse(spark, d):
    atoms, scheme, _ = structures.parse_mmcif(cif_files(spark, d))
    rows = relational.parse_structures(atoms, scheme)
    return rows.select("pid", "chain", "pidc", F.col("A_pdbx_PDB_model_num").alias("model"), F.col("S_seq_id").alias("seq"), F.col("S_mon_id").alias("mon"), F.col("A_id").alias("atom_id"), *[F.round(f"A_Cartn_{c}", 5).alias(c) for c in "xyz"])


@query("cif_rows", f"WITH {_PTS} SELECT 'E' || chain AS pid, (count(*) + count(DISTINCT model))::BIGINT AS atoms, count(DISTINCT model)::BIGINT AS hetero, 22::BIGINT AS scheme FROM pts GROUP BY chain")
def cif_rows(spark, d):
    atoms, scheme, _ = structures.parse_mmcif(cif_files(spark, d))
    a = atoms.select("pid", *ATOM_SITE.names).groupBy("pid").agg(F.count(F.lit(1)).alias("atoms"), F.count_if(F.col("A_group_PDB") == "HETATM").alias("hetero"))
    return a.join(scheme.select("pid", *POLY_SEQ.names).groupBy("pid").agg(F.count(F.lit(1)).alias("scheme")), "pid")


@query("cif_headers", "SELECT 'E' || label AS pid, 'Entry E' || label AS head, 1999 AS year, 'A' AS chains, count(*)::INT AS model_count FROM embeddings GROUP BY label")
def cif_headers(spark, d):
    from strandline.functions.columns import deposition_year

    head = structures.parse_mmcif(cif_files(spark, d))[2]
    return head.select("pid", "head", deposition_year(F.col("deposition")).alias("year"), F.array_join("all_chains", ",").alias("chains"), "model_count")


def pdb_files(spark, d) -> DataFrame:
    """(pid, text): each chain as a PDB file; coordinates a hundredfold, as its fields have three places; models end in TER and a hetero atom."""
    key = F.concat(F.lit("E"), F.col("chain").cast("string")).alias("pid")
    p = points(spark, d)
    ca = p.select(key, "model", "seq", F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00", "seq", "seq", F.col("x") * 100, F.col("y") * 100, F.col("z") * 100).alias("line"))
    begin = p.filter("seq = 1").select(key, "model", F.lit(0).cast("long").alias("seq"), F.format_string("MODEL     %4d", "model").alias("line"))
    end = p.filter("seq = 1").select(key, "model", F.lit(99).cast("long").alias("seq"), F.lit("TER\nHETATM   99  CA  CAL B  99       9.000   9.000   9.000  1.00  0.00\nENDMDL").alias("line"))
    return _listed(ca.unionByName(begin).unionByName(end), "pid", ["model", "seq"], "line").select("pid", F.col("lines").alias("text"))


@query("pdb_parse", f"WITH {_PTS} SELECT 'E' || chain AS pid, model, 'A' AS chain, seq, round(x * 100, 2) + 0 AS x, round(y * 100, 2) + 0 AS y, round(z * 100, 2) + 0 AS z FROM pts WHERE abs(round(x * 100, 2) - x * 100) < 0.0045 AND abs(round(y * 100, 2) - y * 100) < 0.0045 AND abs(round(z * 100, 2) - z * 100) < 0.0045")
def pdb_parse(spark, d):
    """Rows whose coordinates are not at the border of a rounding to two places."""
    rows = structures.parse_pdb(pdb_files(spark, d)).select("pid", "model", "chain", F.col("seq_id").alias("seq"), "x", "y", "z")
    near = points(spark, d).select(F.concat(F.lit("E"), F.col("chain").cast("string")).alias("pid"), "model", "seq", *[(F.abs(F.round(F.col(c) * 100, 2) - F.col(c) * 100) < 0.0045).alias(f"ok{c}") for c in "xyz"]).filter("okx AND oky AND okz").select("pid", "model", "seq")
    return rows.join(near, ["pid", "model", "seq"], "left_semi").select("pid", "model", "chain", "seq", *[(F.round(c, 2) + 0.0).alias(c) for c in "xyz"])


@query("traces_of_any_format", f"WITH {_PTS}, n AS (SELECT chain, count(*)::BIGINT AS n, count(DISTINCT model)::BIGINT AS models FROM pts GROUP BY chain) SELECT 'cif' AS kind, 'E' || chain AS pid, n, models FROM n UNION ALL SELECT 'pdb', 'E' || chain, n, models FROM n UNION ALL SELECT 'xyz', 'E' || chain, n, models FROM n")
def traces_of_any_format(spark, d):
    p = points(spark, d).withColumn("pid", F.concat(F.lit("E"), F.col("chain").cast("string")))
    atoms = p.select("pid", "model", "seq", F.format_string("CA %.5f %.5f %.5f", "x", "y", "z").alias("line"))
    counts = p.filter("seq = 1").select("pid", "model", F.lit(0).cast("long").alias("seq"), F.lit("21\na comment").alias("line"))
    xyz = _listed(atoms.unionByName(counts), "pid", ["model", "seq"], "line").select("pid", F.col("lines").alias("text"))
    named = lambda kind, files: files.select(F.concat(F.lit(f"{kind} "), "pid").alias("pid"), "text")
    every = named("cif", cif_files(spark, d)).unionByName(named("pdb", pdb_files(spark, d))).unionByName(named("xyz", xyz))
    got = structures.parse_traces(every).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    part = lambda k: F.split_part("pid", F.lit(" "), F.lit(k))
    return got.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models")).select(part(1).alias("kind"), part(2).alias("pid"), "n", "models")


@query("fasta_files", "SELECT doc_id::VARCHAR AS id, length(s) AS length, md5(s) AS digest FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents) WHERE s <> ''")
def fasta_files(spark, d):
    path = fresh_folder(spark)
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    tables.write_fasta(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), letters.alias("seq")).filter("seq <> ''"), path)
    return tables.read_fasta(spark, path).select("id", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


@query("state_strings", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'no states' WHEN doc_id % 3 = 1 THEN 'different lengths' END AS problem FROM documents")
def state_strings(spark, d):
    path, ids = fresh_folder(spark), table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    tables.write_fasta(ids.filter("doc_id % 3 <> 0").select("id", F.when(F.col("doc_id") % 3 == 1, "dvq").otherwise("dvqp").alias("seq")), path)
    sequences = ids.select("id", F.lit("ACDE").alias("seq"))
    return tables.attach_states(sequences, tables.read_states(spark, path)).select("id", "problem")


@query("key_list_files", "SELECT DISTINCT c_mktsegment || '_' || c_nationkey AS key FROM customer")
def key_list_files(spark, d):
    path = fresh_folder(spark)
    tables.write_keys(table(spark, d, "customer").select(F.concat_ws("_", F.lit(None).cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pidc")), path, per_line=16, heading="%d keys")
    return tables.read_keys(spark, path, skip=1)


@query("key_list_update", "SELECT DISTINCT 'K' || c_custkey AS key FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def key_list_update(spark, d):
    path = fresh_folder(spark)
    for rule in ("c_custkey % 2 = 0", "c_custkey % 3 = 0", "c_custkey % 6 = 0"):
        tables.update_keys(spark, table(spark, d, "customer").filter(rule).select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("pidc")), path)
    return tables.read_keys(spark, path)


def _atoms(spark, d) -> DataFrame:
    p = points(spark, d)
    return p.select(F.concat(F.lit("C"), F.col("chain").cast("string"), F.lit("_A")).alias("pidc"), F.col("model").alias("A_pdbx_PDB_model_num"), F.col("seq").alias("S_seq_id"), F.lit("ALA").alias("S_mon_id"), (F.col("model") * 100 + F.col("seq")).alias("A_id"), *[F.col(c).alias(f"A_Cartn_{c}") for c in "xyz"])


@query("ssv_files", f"WITH {_PTS} SELECT 'C' || chain || '_A' AS pidc, model, seq, 'ALA' AS mon, model * 100 + seq AS atom_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def ssv_files(spark, d):
    path = fresh_folder(spark)
    tables.write_ssv(_atoms(spark, d), path)
    got = tables.read_written_ssv(spark, path)
    return got.select("pidc", F.col("A_pdbx_PDB_model_num").alias("model"), F.col("S_seq_id").alias("seq"), F.col("S_mon_id").alias("mon"), F.col("A_id").alias("atom_id"), *[F.round(f"A_Cartn_{c}", 6).alias(c) for c in "xyz"])


@query("chain_files", f"WITH {_PTS} SELECT 'C' || chain || '_A' AS id, repeat('A', 21) AS seq FROM pts GROUP BY chain")
def chain_files(spark, d):
    path = fresh_folder(spark)
    tables.write_chains(_atoms(spark, d), path)
    return tables.chain_sequences(spark.read.parquet(path))


_HITS = """hits AS (SELECT a.l_partkey AS query, b.l_partkey AS target, b.l_tax / 40 AS evalue, a.l_quantity * 2 AS pident, b.l_quantity::INTEGER AS alnlen, 1 - a.l_discount AS qcov, 1 - b.l_tax AS tcov
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 1)"""


@query("hits_files", f"WITH {_HITS} SELECT query::VARCHAR AS query, count(*) AS n, round(sum(evalue), 6) AS evalue, sum(alnlen)::BIGINT AS alnlen, sum(round(qcov * 100))::BIGINT AS qcov FROM hits GROUP BY 1")
def hits_files(spark, d):
    path = fresh_folder(spark)
    tables.write_hits(hits(spark, d), path)
    got = tables.read_hits(spark, path)
    return got.groupBy("query").agg(F.countDistinct("ordinal").alias("n"), F.round(F.sum("evalue"), 6).alias("evalue"), F.sum("alnlen").alias("alnlen"), F.sum(F.round(F.col("qcov") * 100).cast("bigint")).alias("qcov"))


@query("matrix_files", "SELECT n_regionkey::VARCHAR AS pidc, a.n_nationkey AS i, b AS j, (a.n_nationkey * b)::DOUBLE AS value FROM nation a, range(3) t(b)")
def matrix_files(spark, d):
    path = fresh_folder(spark)
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("pidc"), F.col("n_nationkey").alias("i"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("j"))
    tables.write_matrices(n.withColumn("value", (F.col("i") * F.col("j")).cast("double")), path)
    return spark.read.parquet(path).select("pidc", "i", F.col("j").cast("long").alias("j"), "value")


@query("cluster_files", "SELECT n_regionkey AS chain, '{\"1\":[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']}' AS clusters FROM nation GROUP BY 1")
def cluster_files(spark, d):
    path = fresh_folder(spark)
    maps = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("chain")).agg(F.map_from_arrays(F.array(F.lit(1)), F.array(F.sort_array(F.collect_list("n_nationkey")))).alias("clusters"))
    tables.write_clusters(maps, path)
    return spark.read.schema("chain int, clusters string").json(path)


@query("top_pair_files", "SELECT c_nationkey AS chain, '(' || c_custkey || ', ' || rank || ') ' || rank || '.500' AS value FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def top_pair_files(spark, d):
    path = fresh_folder(spark)
    top = relational.top_k(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", 5, ["c_custkey"])
    tables.write_top_pairs(top.select(F.col("c_nationkey").alias("chain"), F.col("c_custkey").alias("m1"), F.col("rank").alias("m2"), (F.col("rank") + 0.5).alias("score"), "rank"), path)
    return spark.read.schema("value string, chain int").text(path).select("chain", "value")


@query("report_files", "SELECT n_regionkey AS pid, count(*)::BIGINT AS n, '[\"' || string_agg(n_name, '\",\"' ORDER BY n_name) || '\"]' AS chains FROM nation GROUP BY 1")
def report_files(spark, d):
    path = fresh_folder(spark)
    tables.write_report(table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("n_name")).alias("chains")), path)
    return spark.read.schema("pid int, n bigint, chains string").option("header", True).option("escape", '"').csv(f"{path}/csv")


@query("trajectory_check", "SELECT c.c_custkey AS pidc, 10 AS topology_atoms, max(o.n) AS trajectory_atoms FROM customer c LEFT JOIN (SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1 HAVING max(o.n) IS DISTINCT FROM 10")
def trajectory_check(spark, d):
    topology = table(spark, d, "customer").select(F.col("c_custkey").alias("pidc"), F.lit(10).alias("atoms"))
    trajectory = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pidc")).agg(F.count(F.lit(1)).cast("int").alias("atoms"))
    return tables.trajectory_problems(topology, trajectory)


@query("trajectory_files", f"WITH {_PTS} SELECT chain, model::INT AS frame, count(*) AS n, round(max(abs(x)), 5) AS reach FROM pts GROUP BY ALL")
def trajectory_files(spark, d):
    from strandline import schemas

    path = fresh_folder(spark)
    p = points(spark, d).groupBy("chain", "model").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("x")).alias("reach"))
    frames = p.select(F.col("chain").cast("string").alias("domain"), F.col("n").cast("int").alias("temperature"), F.lit(0).alias("replica"), F.col("model").cast("int").alias("frame"), F.col("reach").alias("rmsd"), F.lit(0.0).alias("gyration_radius"))
    frames.write.parquet(path)
    got = tables.read_trajectories(spark, path, schemas.FRAMES)
    return got.select(F.col("domain").cast("int").alias("chain"), "frame", F.col("temperature").cast("long").alias("n"), F.round("rmsd", 5).alias("reach"))


@query("search_response", "SELECT p_name AS identifier, p_retailprice AS score FROM part")
def search_response(spark, d):
    found = F.collect_list(F.struct(F.col("p_name").alias("identifier"), F.col("p_retailprice").alias("score")))
    answers = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(found.alias("result_set"))).alias("body"))
    return tables.read_search_response(answers)


@query("alignment_texts", "SELECT n_name AS query, r_name AS target, n_name || chr(9) || r_name || chr(9) || '0.5000' || chr(9) || '0.2500' || chr(9) || '1.50' || chr(9) || '0.500' || chr(9) || '3' || chr(9) || '3' || chr(9) || '2' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def alignment_texts(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_name").alias("query"), F.col("r_name").alias("target"), F.lit(0.5).alias("tm1"), F.lit(0.25).alias("tm2"), F.lit(1.5).alias("rmsd"), F.lit(2).alias("n_ali"), F.lit("AC-D").alias("seq_x"), F.lit(": .").alias("marks"), F.lit("A-GE").alias("seq_y"))
    return tables.alignment_text(rows, "table")


@query("single_difference", f"WITH {_PTS}, f AS (SELECT * FROM pts p WHERE chain = 0 AND model IN (SELECT model FROM (SELECT DISTINCT model FROM pts WHERE chain = 0 ORDER BY model LIMIT 2))), m AS (SELECT min(model) AS a, max(model) AS b FROM f), e AS (SELECT p.model, p.seq AS i, q.seq AS j, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS d FROM f p JOIN f q ON p.model = q.model AND p.seq < q.seq) SELECT x.i, x.j, round(abs(x.d - y.d), 5) AS dd FROM e x JOIN e y ON x.i = y.i AND x.j = y.j JOIN m ON x.model = m.a AND y.model = m.b")
def single_difference(spark, d):
    chain = points(spark, d).filter("chain = 0")
    first, second = [r["model"] for r in chain.select("model").distinct().orderBy("model").limit(2).collect()]
    one, two = (chain.filter(F.col("model") == m).select("seq", "x", "y", "z") for m in (first, second))
    return ensemble.difference_of_chains(one, two).select("i", "j", F.round("dd", 5).alias("dd"))


@query("named_files", "SELECT upper('s' || s_suppkey) AS pid, s_name AS text FROM supplier WHERE s_suppkey % 2 = 0")
def named_files(spark, d):
    path = fresh_folder(spark)
    ending = F.when(F.col("s_suppkey") % 2 == 0, ".txt").otherwise(".dat")
    named.write_named(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), ending).alias("name"), F.col("s_name").cast("binary").alias("content")), path)
    return structures.read_files(spark, path, "*.txt").select(F.regexp_replace("pid", r"\.TXT$", "").alias("pid"), "text")


def _npz(key, pdf):
    import io

    import numpy as np
    import pandas as pd

    n = int(pdf["i"].max())
    m = np.zeros((n, n))
    m[pdf["i"] - 1, pdf["j"] - 1] = pdf["value"]
    out = io.BytesIO()
    np.savez(out, mat=m)
    return pd.DataFrame({"name": [f"C_{key[0]}.npz"], "content": [out.getvalue()]})


@query("npz_files", f"WITH {_PTS}, m AS (SELECT chain, seq, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY ALL) SELECT 'C_' || a.chain AS pidc, a.seq::INT AS i, b.seq::INT AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 5) AS value FROM m a JOIN m b ON a.chain = b.chain")
def npz_files(spark, d):
    path = fresh_folder(spark)
    m = points(spark, d).groupBy("chain", F.col("seq").cast("int").alias("i")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    other = m.select("chain", F.col("i").alias("j"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    pairs = m.join(other, "chain").select("chain", "i", "j", distance(*[F.col(c) for c in ("x", "y", "z", "ox", "oy", "oz")]).alias("value"))
    named.write_named(pairs.groupBy("chain").applyInPandas(_npz, "name string, content binary"), path)
    return tables.read_matrices(spark, f"{path}/*.npz").select("pidc", "i", "j", F.round("value", 5).alias("value"))


def _trajectory(key, pdf):
    import pandas as pd

    frames = pdf.sort_values(["model", "seq"])[["x", "y", "z"]].to_numpy().reshape(pdf["model"].nunique(), -1, 3)
    return pd.DataFrame({"name": [f"{key[0]}_{key[1]}.dcd"], "content": [named.frames_to_bytes(frames, cell=key[1] % 2 == 1)]})


@query("frame_files", f"WITH {_PTS}, f AS (SELECT *, (dense_rank() OVER (PARTITION BY chain, model // 64 ORDER BY model) - 1)::INT AS frame FROM pts) SELECT chain || '_' || (model // 64) || '.dcd' AS file, frame, (seq - 1)::INT AS atom, round(x, 5) AS x, round(z, 5) AS z FROM f")
def frame_files(spark, d):
    path = fresh_folder(spark)
    p = points(spark, d).withColumn("block", F.expr("model div 64"))
    named.write_named(p.groupBy("chain", "block").applyInPandas(_trajectory, "name string, content binary"), path)
    return named.read_frames(spark, path, ["file", "frame", "atom", "x", "z"], part=2000).select("file", "frame", "atom", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in "xz"])


@query(
    "html_table",
    """WITH r AS (SELECT p_partkey, p_partkey // 50 AS page_id, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS row, p_name, p_type, p_size,
  (p_partkey % 9 + 1) || upper(substr(md5(p_partkey::VARCHAR), 1, 3)) AS one, (p_partkey % 7 + 1) || substr(md5(p_brand), 1, 3) AS two FROM part)
SELECT page_id, row::INT AS "row", p_name AS "Protein name", CASE WHEN p_size % 5 = 0 THEN '' WHEN one = two THEN one ELSE one || ',' || two END AS "Conformers", CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS "Family" FROM r WHERE p_size % 11 <> 0""",
)
def html_table(spark, d):
    """Tables of fifty rows a page: identifiers in their first order, some missing, some rows without a name or a link."""
    p = table(spark, d, "part")
    digit = lambda n: (F.col("p_partkey") % n + 1).cast("string")
    one = F.concat(digit(9), F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 3)))
    two = F.concat(digit(7), F.substring(F.md5("p_brand"), 1, 3))
    ids = F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.concat(one, F.lit(", "), two, F.lit(" and "), one))
    link = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("<a href=#>"), "p_type", F.lit("</a>")))
    name = F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.col("p_name"))
    row = F.concat(F.lit("<tr class=r><td> "), name, F.lit("</td>\n<td>"), ids, F.lit("</td><td>"), link, F.lit("</td></tr>"))
    rows = p.select(F.expr("p_partkey div 50").alias("page_id"), "p_partkey", row.alias("row"))
    pages = _listed(rows, "page_id", ["p_partkey"], "row").select("page_id", F.concat(F.lit("<table>"), "lines", F.lit("</table>")).alias("html"))
    t = tables.scrape_rows(pages, keep=["page_id"])
    return t.select("page_id", "row", "Protein name", F.array_join("Conformers", ",").alias("Conformers"), "Family")


@query("search_homomeric", "SELECT p_partkey AS pid, p_retailprice AS score FROM part WHERE p_size % 3 = 1 AND p_size > 20 AND p_brand = 'Brand#1' ORDER BY score DESC, pid LIMIT 100")
def search_homomeric(spark, d):
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("method"), (F.col("p_size") % 3).alias("protein_entities"), F.when(F.col("p_size") > 20, 2).otherwise(1).alias("protein_instances"), F.col("p_retailprice").alias("score"))
    return relational.search_entries(meta, False, 100, "Brand#1").select("pid", "score")
