import json
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandline.plans import queries as plans

D = "/root/testdata/sf0.001"
#: Queries whose SQL takes long even on the smallest tables are compared there only.
NAMES = sorted(plans.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got, want = comparable(plans.QUERIES[name](spark, D).toPandas()), comparable(duck.sql(plans.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist())


#: What the rows of a query without SQL must be like: name -> (rows as a frame -> whether they are).
LAWS = {
    "gnm_msf": lambda r: len(r) == 500 * 21 and (r["msf"] >= 0).all() and np.allclose(r["b_factor"], 8 * np.pi**2 / 3 * r["msf"]) and (r["n_modes"] <= 20).all(),
    "pca_modes": lambda r: (r["eigenvalue"] >= -1e-12).all() and all(np.all(np.diff(g.sort_values("mode")["eigenvalue"]) <= 1e-12) and np.all(np.diff(g.sort_values("mode")["cumulative"]) >= -1e-12) for _, g in r.groupby("chain")) and r["cumulative"].between(0, 1 + 1e-9).all(),
    "pca_scores": lambda r: len(r) == 500 and all(abs(g["pc1"].sum()) < 1e-6 and abs(g["pc2"].sum()) < 1e-6 and abs((g["pc1"] * g["pc2"]).sum()) < 1e-6 for _, g in r.groupby("chain")),
    "upgma_clusters": lambda r: len(r) == 500 and all(sorted(set(g["cluster"])) == list(range(1, g["cluster"].nunique() + 1)) for _, g in r.groupby("chain")),
    "cluster_maps": lambda r: all(sorted(i for v in json.loads(x).values() for i in v) == list(range(1, sum(map(len, json.loads(x).values())) + 1)) for x in r["clusters"]),
    "ward_tree": lambda r: all(np.all(np.diff(g.sort_values("step")["height"]) >= -1e-9) and g["size"].max() == len(g) + 1 for _, g in r.groupby("chain")),
    "domains": lambda r: len(r) == 210 and r["k"].between(1, 4).all() and (r["label"] < r["k"]).all() and r["silhouette"].between(-1, 1).all(),
    "hinges": lambda r: len(r) == 210 and (r["hinge"] >= 0).all() and (r[r["hinge"] > 0].groupby("chain")["label"].nunique() >= 1).all(),
    "tm_matrix": lambda r: r["tm"].between(0, 1 + 1e-9).all() and (r["n_ali"] == 21).all() and (r["m1"] < r["m2"]).all(),
    "tm_square": lambda r: (r[r["i"] == r["j"]]["value"] == 1).all() and len(r) == sum(n * n for n in r[r["i"] == r["j"]].groupby("chain").size()),
    "tm_summary": lambda r: len(r) == 10 and (r["minTMS"] <= r["meanTMS"]).all() and (r["meanTMS"] <= r["maxTMS"]).all(),
    "structure_search": lambda r: len(r) == 90 and r["tm1"].between(0, 1).all() and (r["seq_x"].str.len() == r["seq_y"].str.len()).all(),
    "network_by_solves": lambda r: len(r) == 500 * 21 and (r["msf"] >= 0).all() and np.allclose(r["b_factor"], 8 * np.pi**2 / 3 * r["msf"]) and r.set_index(["chain", "model", "seq"])["msf"].index.is_unique,
    "indexed_search": lambda r: r["tm1"].between(0, 1).all() and (r["query"] % 50 == 0).all() and len(r) < 0.2 * 10 * 500,
    "learned_states": lambda r: len(r) == 500 and (r["states"].str.len() == 21).all() and set("".join(r["states"])) <= set("ABCDEFGHIJKLMNOPQRST" + "X") and (r["states"].str[0] == "X").all(),
    "sensitive_search": lambda r: (r[r["query"] == r["target"]]["pident"] == 100).all() and len(r[r["query"] == r["target"]]) == 40 and (r["evalue"] <= 1e-3).all() and r["qcov"].between(0, 1).all(),
    "sequence_search": lambda r: (r[r["query"] == r["target"]]["pident"] == 100).all() and r["qcov"].between(0, 1).all() and len(r[r["query"] == r["target"]]) == 40,
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_rows_without_sql_keep_their_law(spark, name):
    assert LAWS[name](plans.QUERIES[name](spark, D).toPandas())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark):
    plan = plans.QUERIES["drop_missing"](spark, D)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "l_discount" in schema and "l_shipdate" not in schema
