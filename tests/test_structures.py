import pytest
from pyspark.sql import functions as F

from strandline.operators import relational as R
from strandline.schemas import ATOM_SITE, POLY_SEQ
from strandline.sources import structures as S
from tests.fixtures import cif


def parsed(spark, texts):
    files = spark.createDataFrame(list(texts.items()), "pid string, text string")
    atoms, scheme, head = S.parse_mmcif(files)
    return atoms, scheme, head, R.parse_structures(atoms, scheme)


def test_words_and_values():
    text = "data_x\n_a.b 'it''s' _a.c\n\"q # q\" # no\n_a.d\n;line 1\nline 2\n;\nloop_ _l.x _l.y 1 'two words' 3 .\n#\n_a.e ?\n"
    got = S.parse_cif(text)
    assert got == {"_a.b": ["it''s"], "_a.c": ["q # q"], "_a.d": ["line 1\nline 2"], "_l.x": ["1", "3"], "_l.y": ["two words", "."], "_a.e": ["?"]}


def test_two_chains(spark):
    atoms, scheme, head, out = parsed(spark, {"1AAA": cif()})
    assert atoms.columns == ["pid", *ATOM_SITE.names] and scheme.columns == ["pid", *POLY_SEQ.names]
    assert out.count() == 2 * 3 * 6 and out.filter("A_label_atom_id <> 'CA'").count() == 0
    h = head.first()
    assert h["all_chains"] == ["A", "B"] and h["model_count"] == 3 and h["deposition"] == "1999-03-04"
    counts = {r["pidc"]: (r["model_count"], r["CA_count"], r["kind"]) for r in R.model_counts(out).collect()}
    assert counts == {"1AAA_A": (3, 6, "multi"), "1AAA_B": (3, 6, "multi")}
    m = R.mean_coordinates(out).filter("pidc = '1AAA_A' AND S_seq_id = 1").first()
    assert m["mean_x"] == pytest.approx(4.0) and m["std_x"] == pytest.approx(0.1) and m["A_id"] == 2
    assert R.inconsistent_sequences(out).count() == 0


def test_occupancy(spark):
    *_, out = parsed(spark, {"1OCC": cif(chains=("A",), models=1, occupancy={1: "0.5", 2: "0.51", 3: "?", 4: "0.30"})})
    assert sorted(r["S_seq_id"] for r in out.collect()) == [2, 3, 5, 6]
    atoms, scheme, _, _ = parsed(spark, {"1OCC": cif(chains=("A",), models=1, occupancy={1: "0.5"})})
    filled = R.parse_structures(atoms, scheme, fill=0.0).filter("S_seq_id = 1").first()
    assert (filled["A_Cartn_x"], filled["A_Cartn_y"], filled["A_Cartn_z"]) == (0, 0, 0)


def test_hetero_only_and_unmatched(spark):
    atoms, _, _, out = parsed(spark, {"1HET": cif(hetero_only=True), "1TWO": cif(scheme_chains=("B", "C"))})
    assert {r["pidc"] for r in out.select("pidc").distinct().collect()} == {"1TWO_B"}
    missing = R.missing_keys(atoms, out, ["pid"])
    assert [r["pid"] for r in missing.collect()] == ["1HET"]


def test_files_and_pdb(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text(cif())
    files = S.read_files(spark, str(tmp_path), "*.cif")
    assert files.first()["pid"] == "1ABC"
    lines = ["MODEL        1"]
    for m in (1, 2):
        if m == 2:
            lines += ["ENDMDL", "MODEL        2"]
        for r in range(1, 4):
            lines.append(f"ATOM  {r:5d}  CA  GLY A{r:4d}    {r * 1.5:8.3f}{m * 1.0:8.3f}{0:8.3f}  1.00  0.00")
        lines.append("TER")
        lines.append(f"HETATM{9:5d}  CA  GLY B{9:4d}    {0:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00")
        lines.append(f"ATOM  {8:5d}  CA  GLY B{8:4d}    {0:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00")
    (tmp_path / "2xyz.pdb").write_text("\n".join(lines))
    df = S.read_pdb(spark, str(tmp_path))
    assert df.count() == 8 and df.filter("model = 2 AND chain = 'A'").agg(F.sum("x")).first()[0] == 9.0
    assert S.read_pdb(spark, str(tmp_path), hetero=True).count() == 10
    assert S.read_pdb(spark, str(tmp_path), until_ter=True).count() == 6
    assert S.read_pdb(spark, str(tmp_path), split_models=False).select("model").distinct().count() == 1


def test_structure_source(spark, tmp_path):
    from strandline.sources.remote import StructureSource

    (tmp_path / "1ABC.cif").write_text("data_x")
    spark.dataSource.register(StructureSource)
    got = {r["pid"]: r["found"] for r in spark.read.format("structures").option("mirror", str(tmp_path)).option("ids", "1abc.cif, 9zzz").load().collect()}
    assert got == {"1ABC": True, "9ZZZ": False}


def test_stream_of_structures(spark, tmp_path):
    from strandline.streaming.ingest import ingest_structures

    src = tmp_path / "in"
    src.mkdir()
    (src / "1abc.cif").write_text(cif())
    for _ in range(2):
        ingest_structures(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        (src / "2abc.cif").write_text(cif(chains=("A",)))
    assert {r["pidc"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("pidc").count().collect()} == {"1ABC_A": 18, "1ABC_B": 18, "2ABC_A": 18}


def test_files_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([(f"{k}AAA", cif()) for k in range(5)], "pid string, text string")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    atoms, scheme, head = S.parse_mmcif(files.mapInArrow(count, files.schema))
    assert R.parse_structures(atoms, scheme).count() == 5 * 36 and head.count() == 5 and atoms.count() > 0
    assert seen.value == 5


def test_traces_of_any_format(spark):
    xyz = "3\nwater\nCA 1.0 2.0 3.0\nO 0 0 0\nCA -1 2e0 .5\n2\n\nCA 7 8 9\nN 1 1 1\n"
    pdb = "MODEL        2\nATOM      1  CA  GLY A   4       1.500   2.000   3.000  1.00  0.00\nENDMDL"
    files = spark.createDataFrame([("X", xyz), ("P", pdb), ("C", cif(("A",), 1, 2))], "pid string, text string")
    got = sorted((r["pid"], r["model"], r["seq_id"], r["x"], r["mon_id"]) for r in S.parse_traces(files).collect())
    assert got[0][:3] == ("C", 1, 1) and len([g for g in got if g[0] == "C"]) == 2
    assert [g for g in got if g[0] != "C"] == [("P", 2, 4, 1.5, "GLY"), ("X", 1, 1, 1.0, "UNK"), ("X", 1, 3, -1.0, "UNK"), ("X", 2, 1, 7.0, "UNK")]


def test_a_file_is_parsed_in_pieces(monkeypatch):
    """Its rows leave as they come: many rows cost no more memory than few, beside the text; odd files as before."""
    import tracemalloc

    head = "data_x _struct.title 'a b'\nloop_\n" + "\n".join(f"_atom_site.{f}" for f in S.ATOM_FIELDS.values()) + "\n"
    line = "ATOM %d CA ALA A %d 1.0 2.0 3.0 1.00 %d\n"
    peaks = []
    for n in (30_000, 120_000):
        text = memoryview((head + "".join(line % (k, k, k % 7) for k in range(n)) + "#\n").encode())
        tracemalloc.start()
        count = 0
        for atoms, _, h in S.file_rows(text):
            count += len(atoms[0])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == n and h == {"head": "a b", "deposition": None, "chains": ["A"], "model_count": 7}
    assert peaks[1] < 1.3 * peaks[0]

    def whole(text):
        atoms, scheme, h = zip(*S.file_rows(memoryview(text.encode())), strict=True)
        assert [x is None for x in h] == [True] * (len(h) - 1) + [False]
        return [[sum((p[k] for p in parts), []) for k in range(len(parts[0]))] for parts in (atoms, scheme)]

    scheme = "loop_ _pdbx_poly_seq_scheme.seq_id _pdbx_poly_seq_scheme.mon_id _pdbx_poly_seq_scheme.pdb_seq_num _pdbx_poly_seq_scheme.asym_id "
    text = head + line % (1, 1, 1) + line % (2, 2, 1) + scheme + "1 ALA 1 A 2 GLY 2 A "
    cases = {"plain": text, "again": text + "\n" + head[7:] + line % (9, 9, 9), "noted": text + " _note.x '_atom_site.id'", "single": "data_y " + " ".join(f"_pdbx_poly_seq_scheme.{f} 7" for f in S.SCHEME_FIELDS.values()), "field": text + "\n_a.b\n;x\n_atom_site.id\n;\n", "second": text + "\n" + text, "none": "", "empty": head}
    monkeypatch.setattr(S, "SLICE", 16)
    for rows in (1, 3, 1000):
        monkeypatch.setattr(S, "ROWS", rows)
        for name, case in cases.items():
            fields = S.parse_cif(case)
            assert whole(case) == [S._columns(fields, c, w) for c, w in S._TABLES], name
        with pytest.raises(ValueError, match="different length"):
            whole(head + line % (1, 1, 1) + "ATOM 2")
        with pytest.raises(KeyError, match="lacks"):
            whole("loop_ _atom_site.id _atom_site.group_PDB 1 ATOM")
