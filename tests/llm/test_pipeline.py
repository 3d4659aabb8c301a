import os
import shutil
import subprocess
import sys

import corpus_pipeline as C
from strandline.llm import queries as Q
from tests.llm.cases import frame, rows

D = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, counts, out = docs.columns, [docs.count()], {}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{k}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1")
    good = spark.read.parquet(f"{D}/documents.parquet").join(labels, "doc_id", "left_semi").select("doc_id").distinct()
    assert good.join(out["quality"], "doc_id", "left_anti").count() <= 0.03 * good.count()
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert out["near_duplicates"].select("doc_id").distinct().count() == counts[2]
    from strandline.llm import secrets as S

    assert all(not S.scan(r["text"])["base"] for r in out["secrets"].collect())
    assert out["encode"].filter("not round_trip").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, texts = frame(spark), [r[1] for r in rows()]
    got = {name: [r.asDict() for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in C.STAGES}
    ids = {name: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got[name]) for name in got}
    every = sorted((r[0] is None, r[0] or 0) for r in rows())
    # Equal texts, and texts without words, share their fate.
    kept = {r["doc_id"] for r in got["quality"]}
    assert len({1, 2} & kept) != 1 and len({4, 5, 6} & kept) in (0, 3) and {r[0] for r in rows()} >= kept
    assert ids["near_duplicates"] == [(False, i) for i in (1, 4, 5, 6, 7, 8, 9, 10)] + [(True, 0)]
    assert ids["secrets"] == every and sorted(str(r["text"]) for r in got["secrets"]) == sorted(map(str, texts))
    assert {r["doc_id"] for r in got["mix"]} <= {r[0] for r in rows() if r[1] and r[1].split()}
    assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in got["encode"]}) == sorted(set(every)) and all(r["round_trip"] for r in got["encode"])
    for name, stage in C.STAGES:
        assert stage(spark, frame(spark, True), str(tmp_path)).count() == 0


def test_run_is_its_stages_and_leaves_one_folder(spark, tmp_path):
    from strandline.llm.base import durable_dir

    place = durable_dir(spark).removeprefix("file:")
    before = set(os.listdir(place))
    D1 = "/root/testdata/sf0.001"
    got = C.run(spark, D1)
    docs = spark.read.parquet(f"{D1}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, docs, D1).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = C.STAGES[-1][1](spark, docs, D1)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    (folder,) = (n for n in set(os.listdir(place)) - before if n.startswith("pipeline-"))
    assert os.listdir(os.path.join(place, folder)) == [C.STAGES[-2][0]]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_the_rest_stands_without_this_package(tmp_path):
    for name in ("strandline", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
