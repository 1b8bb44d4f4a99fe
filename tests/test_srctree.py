"""The tree as a data source, and its changes as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from factgraph.operators import checks
from factgraph.sources import srctree, tree
from factgraph.streaming import changes as C


@pytest.fixture
def session(spark):
    srctree.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_reads_what_a_scan_reads(session, pier):
    (pier / "empty").mkdir()
    (pier / "notes.md").write_text("x")
    (pier / ".hidden").mkdir()
    (pier / ".hidden" / "a.py").write_text("x")
    rows = session.read.format("srctree").load(str(pier))
    files = tree.as_files(rows).where("language IS NOT NULL")
    assert checks.differing_rows(files.drop("error"), tree.scan_tree(session, str(pier)).drop("error")).isEmpty()
    assert sorted(r.filepath for r in rows.select("filepath", "size").collect() if r.filepath.endswith("md")) == ["notes.md", "tools/README.md"]
    bare = session.read.format("srctree").option("content", "false").load(str(pier))
    assert bare.where("content IS NOT NULL").count() == 0 and bare.count() == rows.count()
    assert session.read.format("srctree").load(str(pier / "empty")).count() == 0


def test_filters_reach_the_source(session, pier, monkeypatch):
    (pier / "deep" / "er").mkdir(parents=True)
    (pier / "deep" / "er" / "X.PY").write_text("x = 1\n")
    (pier / "deep" / "y.java").write_text("class Y {}\n")
    rows = session.read.format("srctree").load(str(pier))
    some = rows.where(F.col("ext").isin(".py", ".rb") & F.col("filepath").startswith("deep/") & (F.col("size") > 2))
    assert [r.filepath for r in some.collect()] == ["deep/er/X.PY"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter (" in line]
    # what was pushed is not filtered again; the size is
    assert len(left) == 1 and "size" in left[0] and " IN (" not in left[0] and "StartsWith" not in left[0], plan
    # and directories no wanted path lies in are not opened
    wanted, opened = srctree.Wanted(), []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, pier)) or scandir(p))
    reader = srctree.TreeReader({"path": str(pier)})
    assert list(reader.pushFilters([srctree.StringStartsWith(("filepath",), "deep/er/")])) == []
    parts = reader.partitions()
    assert [r["filepath"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == ["deep/er/X.PY"]
    assert sorted(set(opened)) == [".", "deep", "deep/er"]
    assert wanted.folder("a") and wanted.file("a")


def test_large_trees_are_left_to_the_tasks(session, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i:02d}" / "sub").mkdir(parents=True)
        (tmp_path / f"d{i:02d}" / "sub" / f"f{i}.py").write_text("x")
    monkeypatch.setattr(srctree, "PLAN_BUDGET", 10)
    reader = srctree.TreeReader({"path": str(tmp_path), "partitions": "4"})
    parts = reader.partitions()
    assert len(parts) == 4 and sum(len(p.folders) for p in parts) == 30 and not any(p.files for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 30
    assert session.read.format("srctree").option("partitions", "4").load(str(tmp_path)).count() == 30


def test_differences():
    before = {"a": [1, 1, 1], "b": [2, 2, 2], "c": [3, 3, 3], "d": [4, 4, 4]}
    after = {"a": [1, 1, 1], "b": [2, 9, 2], "c2": [3, 3, 3], "e": [5, 5, 5]}
    assert srctree.differences(before, after) == [("modified", "b", None), ("moved", "c", "c2"), ("deleted", "d", None), ("created", "e", None)]
    assert srctree.differences({}, {}) == [] and srctree.differences({}, {"a": [1, 1, 1]}) == [("created", "a", None)]


def test_stream_of_changes(session, tmp_path):
    root, state, out, check = (str(tmp_path / n) for n in ("root", "state", "out", "check"))
    os.makedirs(f"{root}/pkg")

    def write(name, text):
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(text)

    def run():
        stream = session.readStream.format("srctree_changes").option("path", root).option("state", state).load()
        query = stream.writeStream.format("json").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        query.awaitTermination()
        rows = session.read.schema(stream.schema).json(out).select("event_type", "src_path", "dest_path").collect()
        short = lambda p: p and p[len(root) + 1:]
        return sorted((e, short(s), short(d)) for e, s, d in rows) if rows else []

    write("a.py", "x"), write("pkg/b.py", "y"), write("c.py", "z")
    seen = run()
    assert seen == [("created", "a.py", None), ("created", "c.py", None), ("created", "pkg/b.py", None)]
    write("a.py", "longer"), os.remove(f"{root}/c.py"), os.rename(f"{root}/pkg/b.py", f"{root}/d.py"), write("e.java", "class E {}")
    os.makedirs(f"{root}/.git"), write(".git/x.py", "x")
    more = run()
    new = list(more)
    for row in seen:
        new.remove(row)
    assert new == [("created", "e.java", None), ("deleted", "c.py", None), ("modified", "a.py", None), ("moved", "pkg/b.py", "d.py")]
    # a restart without changes repeats nothing
    assert run() == more
    # a batch whose end was written, but never committed, is read again as it was
    write("late.py", "1")
    reader = srctree.TreeStreamReader({"path": root, "state": state})
    start = {"listing": reader._last()}
    end = reader.latestOffset()
    first = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    write("later.py", "2")
    assert [r for p in reader.partitions(start, end) for r in reader.read(p)] == first and len(first) == 1
    assert len(run()) == len(more) + 2
    kinds = C.file_changes(session.read.schema(reader_schema(session)).json(out))
    assert kinds.where("kind = 'deleted'").count() == 2 and kinds.where("path LIKE '%d.py'").count() == 1


def reader_schema(session):
    from factgraph import schema as S
    return S.CHANGE
