"""Files by name and trajectories: commit, abort, rerun; frames by several tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import named, tables


def rows(spark, names, content=b"x"):
    return spark.createDataFrame([(n, bytearray(content + n.encode())) for n in names], "name string, content binary").repartition(3)


def held(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path)}


def test_a_rerun_replaces_and_append_keeps(spark, tmp_path):
    path = f"{tmp_path}/out"
    named.write_named(rows(spark, ["a.txt", "b.txt"]), path)
    assert held(path) == {"a.txt": b"xa.txt", "b.txt": b"xb.txt"}
    named.write_named(rows(spark, ["b.txt", "c.txt"], b"y"), path, overwrite=False)
    assert held(path) == {"a.txt": b"xa.txt", "b.txt": b"yb.txt", "c.txt": b"yc.txt"}
    named.write_named(rows(spark, ["c.txt"], b"z"), path)
    assert held(path) == {"c.txt": b"zc.txt"}


@pytest.mark.parametrize("bad", [["a/b"], [""], ["d", "d"], ["_hidden"]])
def test_what_fails_changes_nothing(spark, tmp_path, bad):
    path = f"{tmp_path}/out"
    named.write_named(rows(spark, ["a.txt"]), path)
    with pytest.raises(Exception, match="name"):
        named.write_named(rows(spark, ["new.txt", *bad], b"q"), path)
    assert held(path) == {"a.txt": b"xa.txt"}


def test_a_killed_task_leaves_nothing_under_a_name(spark, tmp_path):
    path = f"{tmp_path}/out"
    marker = f"{tmp_path}/tried"

    def once(frames):
        for pdf in frames:
            yield pdf.head(1)
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("lost")
            yield pdf.tail(len(pdf) - 1)

    df = rows(spark, [f"f{k}" for k in range(9)]).coalesce(1).mapInPandas(once, "name string, content binary")
    with pytest.raises(Exception, match="lost"):
        named.write_named(df, path)
    assert not os.path.exists(path) or held(path) == {}
    named.write_named(df, path)
    assert len(held(path)) == 9


def test_frames_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    sets = {"one.dcd": rng.normal(size=(37, 11, 3)), "two.dcd": rng.normal(size=(1, 4, 3)), "none.dcd": np.zeros((0, 5, 3))}
    for n, (name, x) in enumerate(sets.items()):
        with open(tmp_path / name, "wb") as f:
            f.write(named.frames_to_bytes(x, cell=n == 0, order=">" if n == 1 else "<"))
    # A frame that was not written to its end is not there.
    whole = named.frames_to_bytes(sets["one.dcd"])
    with open(tmp_path / "cut.dcd", "wb") as f:
        f.write(whole[:-30])
    df = named.read_frames(spark, str(tmp_path), part=1000)
    assert df.rdd.getNumPartitions() > 10 and df.filter("file = 'one.dcd'").select(F.spark_partition_id().alias("p")).distinct().count() > 5
    got = {(r["file"], r["frame"], r["atom"]): (r["x"], r["y"], r["z"]) for r in df.collect()}
    want = {(n, f, a): tuple(map(float, np.float32(x[f, a]))) for n, x in sets.items() for f in range(len(x)) for a in range(x.shape[1])}
    want |= {("cut.dcd", f, a): tuple(map(float, np.float32(sets["one.dcd"][f, a]))) for f in range(36) for a in range(11)}
    assert got == want
    some = named.read_frames(spark, f"{tmp_path}/one.dcd", ["frame", "z"])
    assert some.columns == ["frame", "z"] and some.filter("frame = 5").count() == 11
    atoms = named.atoms_of(df.filter("file in ('one.dcd', 'two.dcd')"))
    topology = spark.createDataFrame([("one", 11), ("two", 5)], "pidc string, atoms int")
    assert [r["pidc"] for r in tables.trajectory_problems(topology, atoms).collect()] == ["two"]


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.dcd").write_bytes(b"no trajectory at all" * 9)
    with pytest.raises(Exception, match="not a trajectory"):
        named.read_frames(spark, str(tmp_path)).count()


def test_a_list_is_never_without_its_file(spark, tmp_path):
    from strandline.sources.scratch import replace

    path, new = f"{tmp_path}/list", f"{tmp_path}/new"
    for text in ("one", "two"):
        spark.createDataFrame([(text,)], "value string").write.text(new)
        replace(spark, new, path)
        assert spark.read.text(path).first()[0] == text and not os.path.exists(f"{path}.old")
    with pytest.raises(OSError):
        replace(spark, f"{tmp_path}/missing", path)
    assert spark.read.text(path).first()[0] == "two"
    # A crash after the old list was moved aside: the next call finds it.
    os.rename(path, f"{path}.old")
    with pytest.raises(OSError):
        replace(spark, f"{tmp_path}/missing", path)
    assert spark.read.text(path).first()[0] == "two"


def test_small_parts_do_not_make_tasks_without_end(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(700, 3, 3))
    for k in range(3):
        (tmp_path / f"{k}.dcd").write_bytes(named.frames_to_bytes(x + k, cell=k == 1))
    ranges = named.frame_ranges(str(tmp_path), 100)
    tasks = named.dealt(ranges)
    assert len(ranges) > 2000 and named.TASKS <= len(tasks) <= 2 * named.TASKS
    assert sum(r.frames for t in tasks for r in t.ranges) == 2100
    df = named.read_frames(spark, str(tmp_path), part=100)
    assert df.rdd.getNumPartitions() == len(tasks)
    got = {(r["file"], r["frame"], r["atom"]): (r["x"], r["y"], r["z"]) for r in df.collect()}
    assert got == {(f"{k}.dcd", f, a): tuple(map(float, np.float32(x[f, a] + k))) for k in range(3) for f in range(700) for a in range(3)}
