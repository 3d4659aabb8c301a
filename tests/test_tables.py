import numpy as np
from pyspark.sql import functions as F

from strandline import schemas
from strandline.sources import tables as T


def test_lists_and_fasta(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 keys\nB_A C_A\nA_A   B_A\n")
    assert [r["key"] for r in T.read_keys(spark, str(tmp_path / "a.txt"), skip=1).collect()] == ["A_A", "B_A", "C_A"]
    keys = spark.createDataFrame([(f"K{i:02d}",) for i in range(20)] + [("K00",)], "pidc string")
    T.write_keys(keys, str(tmp_path / "out"), per_line=16, heading="%d chains")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "20 chains" and [len(x.split()) for x in lines[1:]] == [16, 4]
    T.update_keys(spark, keys, str(tmp_path / "list"))
    T.update_keys(spark, spark.createDataFrame([("K99",), ("K01",)], "pidc string"), str(tmp_path / "list"))
    assert T.read_keys(spark, str(tmp_path / "list")).count() == 21
    seqs = spark.createDataFrame([("a", "ACD" * 60), ("b", "W")], "id string, seq string")
    T.write_fasta(seqs, str(tmp_path / "f"), legacy=True)
    assert {(r["id"], r["seq"]) for r in T.read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "ACD" * 60), ("b", "W")}


def test_delimited(spark, tmp_path):
    (tmp_path / "h.m8").write_text("a\tb\t1e-5\t50.0\t30\t0.9\t1.0\nb\ta\t1e-4\t50.0\t30\t0.9\t1.0\n")
    h = T.read_hits(spark, str(tmp_path / "h.m8")).orderBy("ordinal").collect()
    assert h[0]["query"] == "a" and h[0]["evalue"] == 1e-5 and h[0]["ordinal"] < h[1]["ordinal"]
    rows = [("1ABC", "A", "1ABC_A", m, s, "GLY", "CA", m * 10 + s, 1.0, 2.0, 3.0) for m in (1, 2) for s in (1, 2, 3)]
    atoms = spark.createDataFrame(rows, schemas.CA_ATOMS)
    T.write_ssv(atoms, str(tmp_path / "ssv"))
    back = spark.read.schema(schemas.SSV).option("sep", " ").option("header", True).csv(str(tmp_path / "ssv" / "pidc=1ABC_A"))
    assert back.count() == 6
    (tmp_path / "2XYZ_B.ssv").write_text(" ".join(schemas.SSV.names) + "\n1 1 ALA 5 0.5 1.5 2.5\n")
    r = T.read_ssv(spark, str(tmp_path / "2XYZ_B.ssv")).first()
    assert (r["pidc"], r["pid"], r["chain"], r["A_Cartn_z"]) == ("2XYZ_B", "2XYZ", "B", 2.5)
    T.write_chains(atoms, str(tmp_path / "chains"))
    assert spark.read.parquet(str(tmp_path / "chains")).count() == 6
    assert T.chain_sequences(atoms).first()["seq"] == "GGG"


def test_html_rows(spark):
    html = "<table><tr><td>No ids</td></tr><tr><td> </td><td>1abc</td></tr><tr><td><b>Kinase</b></td><td>1ABC, 2xyz and 1ABC again; 12345</td><td><a href='f'>Family X</a></td></tr><tr><td>Other</td><td>9q9q</td></tr></table>"
    got = T.scrape_rows(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r["Protein name"], r["Conformers"], r["Family"]) for r in got] == [("Kinase", ["1ABC", "2xyz"], "Family X"), ("Other", ["9q9q"], None)]


def test_matrices_and_reports(spark, tmp_path):
    m = np.arange(9.0).reshape(3, 3)
    np.savez(tmp_path / "1ABC_A.npz", mat=m)
    got = T.read_matrices(spark, str(tmp_path / "*.npz")).collect()
    assert len(got) == 9 and all(r["value"] == m[r["i"] - 1, r["j"] - 1] and r["pidc"] == "1ABC_A" for r in got)
    T.write_matrices(T.read_matrices(spark, str(tmp_path / "*.npz")), str(tmp_path / "m"))
    T.write_report(spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>"), str(tmp_path / "r"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r" / "csv")).count() == 1
    top = spark.createDataFrame([("A", 1, 2, 0.12345, 1), ("A", 1, 3, 0.1, 2)], "chain string, m1 int, m2 int, score double, rank int")
    T.write_top_pairs(top, str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["(1, 2) 0.123", "(1, 3) 0.100"]
    T.write_clusters(spark.createDataFrame([("A", {1: [1, 2]})], "chain string, clusters map<int,array<int>>"), str(tmp_path / "c"))
    assert "[1,2]" in spark.read.text(str(tmp_path / "c")).first()["value"]


def test_services_and_trajectories(spark, tmp_path):
    body = '{"result_set": [{"identifier": "1ABC", "score": 0.5}, {"identifier": "2ABC", "score": 1.0}]}'
    got = T.read_search_response(spark.createDataFrame([(body,)], "body string"))
    assert [r["identifier"] for r in got.collect()] == ["2ABC", "1ABC"]
    top, traj = (spark.createDataFrame(x, "pidc string, atoms int") for x in ([("a", 3), ("b", 4), ("c", 1)], [("a", 3), ("b", 5)]))
    assert {r["pidc"] for r in T.trajectory_problems(top, traj).collect()} == {"b", "c"}
    frames = spark.createDataFrame([("d", 320, 0, 1, 1.5, 2.5)], schemas.FRAMES)
    frames.write.parquet(str(tmp_path / "frames"))
    assert T.read_trajectories(spark, str(tmp_path / "frames"), schemas.FRAMES).agg(F.avg("rmsd")).first()[0] == 1.5


def test_a_list_survives_an_update_that_fails(spark, tmp_path):
    import pytest

    path = str(tmp_path / "list")
    T.update_keys(spark, spark.createDataFrame([("a",), ("b",)], "pidc string"), path)
    broken = spark.createDataFrame([("c",)], "pidc string").select(F.raise_error(F.lit("lost")).cast("string").alias("pidc"))
    with pytest.raises(Exception, match="lost"):
        T.update_keys(spark, broken, path)
    assert [r["key"] for r in T.read_keys(spark, path).collect()] == ["a", "b"]


def test_alignment_texts_and_states(spark):
    row = [("q", "t", 0.5, 0.25, 1.5, 2, "AC-D", ": .", "A-GE"), ("q", "u", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(row, "query string, target string, tm1 double, tm2 double, rmsd double, n_ali int, seq_x string, marks string, seq_y string")
    full, none = (r["text"] for r in T.alignment_text(df).orderBy("target").collect())
    assert full.splitlines()[0] == "Structures: q (3 residues), t (3 residues)" and full.splitlines()[-3:] == ["AC-D", ": .", "A-GE"] and none is None
    assert T.alignment_text(df, "fasta").filter("target = 't'").first()["text"] == ">q\nAC-D\n>t\nA-GE\n"
    both = T.attach_states(spark.createDataFrame([("a", "AC"), ("b", "AC"), ("c", "A")], "id string, seq string"), spark.createDataFrame([("a", "DV"), ("b", "DB"), ("d", "D")], "id string, states string"))
    assert {r["id"]: r["problem"] for r in both.collect()} == {"a": None, "b": "unknown state", "c": "no states", "d": "no sequence"}
