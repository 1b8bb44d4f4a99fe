"""Trees, increments, change streams and domains, end to end."""

import datetime as dt
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factgraph import schema as S
from factgraph.operators import checks, domains as D, incremental, live, louvain as L, lookups, store, subgraph
from factgraph.plans import build
from factgraph.sources import results as R, tree
from factgraph.sources.extract import extract_facts
from factgraph.streaming import changes as C, follow


def uids(df, col="uid"):
    return sorted(r[0] for r in df.select(col).collect())


def test_scan_tree(spark, pier):
    files = tree.scan_tree(spark, str(pier))
    assert uids(files, "filepath") == ["src/Probe.java", "src/TideDay.java", "src/Watch.java", "tools/_box.py"]
    row = files.where("filepath = 'tools/_box.py'").first()
    assert (row.name, row.ext, row.language) == ("_box.py", ".py", "python") and len(row.file_hash) == 64
    # a budget of one entry per round walks the tree in many rounds
    assert uids(tree.prune_paths(tree.list_tree(spark, str(pier), budget=1)), "filepath") == uids(
        tree.prune_paths(tree.list_tree(spark, str(pier))), "filepath")
    with pytest.raises(ValueError):
        tree.scan_tree(spark, str(pier / "none"))


def test_empty_tree(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    graph = build.build_graph(spark, str(tmp_path))
    assert graph.nodes.isEmpty() and graph.edges.isEmpty()


def test_build_ingest_and_ask(spark, pier, tmp_path):
    graph = build.build_graph(spark, str(pier))
    again = build.build_graph(spark, str(pier))
    assert checks.differing_rows(graph.nodes, again.nodes).isEmpty()
    assert checks.differing_rows(graph.edges, again.edges).isEmpty()
    assert checks.contains_violations(graph.nodes, graph.edges).isEmpty()
    folder = str(tmp_path / "graph")
    nodes, edges = build.ingest(spark, graph, folder)
    store.assert_unique(nodes)
    callers = lookups.get_callers(nodes, edges, "span").collect()
    assert {c.name for c in callers} == {"strength", "glance"}
    assert {c.name for c in lookups.get_callees(nodes, edges, "report").collect()} == {"gaps", "strength", "level", None}
    before = nodes.count()
    nodes, edges = build.ingest(spark, graph, folder)              # merging again changes nothing
    assert nodes.count() == before
    domains = build.cluster(spark, folder)
    assert domains.count() >= 1
    assert domains.first().summary.startswith("Mock summary for Domain_")
    saved, membership = D.read_domains(spark, folder)
    assert checks.differing_rows(saved, domains).isEmpty()
    assert membership.groupBy("uid").count().where("count > 1").isEmpty()


def test_cluster_of_nothing(spark, tmp_path):
    store.clear_graph(spark, str(tmp_path))
    assert build.cluster(spark, str(tmp_path)) is None


def test_results_as_json(spark, pier, tmp_path):
    results = extract_facts(tree.scan_tree(spark, str(pier)))
    R.write_json(results, str(tmp_path / "out"))
    back = R.read_result(spark, str(tmp_path / "out"))
    assert back.select(F.explode("nodes")).count() == results.select(F.explode("nodes")).count()
    assert R.combine(results, results).count() == 8
    placeholder = store.placeholders(back.select(F.inline("nodes")), back.select(F.inline("edges")))
    assert json.loads(R.drop_null_fields(placeholder).first().properties).keys() == {"uid", "node_type"}
    one = [r.asDict(recursive=True) for r in results.limit(1).collect()]
    (tmp_path / "one.json").write_text(json.dumps(one[0], indent=2))
    read = R.read_result(spark, str(tmp_path / "one.json"), multi_line=True).first()
    assert len(read.nodes) == len(one[0]["nodes"]) and read.filepath == one[0]["filepath"]


def test_results_as_json_are_packed(spark, tmp_path):
    text = "class A { void f() { " + "g(); " * 300 + "} }"
    results = extract_facts(files(spark, {f"src/A{i}.java": text for i in range(20)}))
    R.write_json(results, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*"))
    plain = sum(len(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())
    assert sum(p.stat().st_size for p in parts) < plain / 5
    back = R.read_result(spark, str(tmp_path / "out"))
    assert back.exceptAll(results).isEmpty() and results.exceptAll(back).isEmpty()


def files(spark, texts):
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()],
                               "filepath string, content binary")
    return tree.as_files(df)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "filepath string")


A, B = "def one():\n    two()\n", "def two():\n    pass\n"


def test_update_graph(spark):
    start = build.graph_of_files(files(spark, {"a.py": A, "b.py": B, "bad.py": "def ("}))
    assert ("a.py:a.py.one", "b.py:b.py.two") in {(e.source_uid, e.target_uid) for e in start.edges.collect()}
    assert start.errors.count() == 1
    now = files(spark, {"a.py": A, "b.py": B + "def three():\n    one()\n", "c.py": "def two(): pass\n"})
    new = incremental.update_graph(start, paths(spark, "b.py", "c.py", "vanished.py"), paths(spark, "bad.py"), now)
    full = build.graph_of_files(now)
    assert checks.differing_rows(new.nodes, full.nodes).isEmpty()
    assert checks.differing_rows(new.edges, full.edges).isEmpty()     # two is ambiguous now
    assert new.errors.isEmpty()
    sticky = incremental.update_graph(start, paths(spark, "c.py"), paths(spark), now, mode="sticky")
    assert ("a.py:a.py.one", "b.py:b.py.two") in {(e.source_uid, e.target_uid) for e in sticky.edges.collect()}
    gone = incremental.update_graph(start, paths(spark), paths(spark, "a.py", "b.py", "bad.py"), now)
    assert gone.nodes.isEmpty() and gone.edges.isEmpty() and gone.errors.isEmpty()


def test_diff_and_stale(spark):
    before, after = files(spark, {"a.py": A, "b.py": B, "c.py": B}), files(spark, {"a.py": A, "b.py": A, "d.py": B})
    diff = incremental.diff_files(before, after)
    assert {r.filepath: r.status for r in diff.collect()} == {
        "a.py": "same", "b.py": "changed", "c.py": "deleted", "d.py": "added"}
    nodes = build.graph_of_files(before).nodes
    stale = incremental.mark_stale(nodes, diff)
    assert {r.filepath for r in stale.where("stale").collect()} == {"b.py", "c.py"} and stale.count() == nodes.count()


def test_snapshot_diff(spark):
    java = "class A { int f(int a) { if (a > %s) return 1; return 0; } void %s() {} }"
    old = build.graph_of_files(files(spark, {"A.java": java % (1, "g")})).nodes
    new = build.graph_of_files(files(spark, {"A.java": java % (2, "h")})).nodes
    got = {(r.name, r.change) for r in incremental.snapshot_diff(old, new).collect()}
    assert got == {("if_statement@L1", "modified"), ("g", "removed"), ("h", "added")}


EVENTS = [
    (0, "modified", "/repo/.git/config.py", None, False), (0, "modified", "/repo/target/A.java", None, False),
    (0, "created", "/repo/src/Main.java", None, False), (1, "deleted", "/repo/src/Old.py", None, False),
    (1, "moved", "/repo/src/Bar.java", "/repo/src/NewBar.PY", False),
    (1, "moved", "/repo/build/x.py", "/repo/build/y.py", False), (2, "moved", "/repo/src/k.txt", "/repo/src/k.py", False),
    (2, "modified", "/repo/src/dir.py", None, True), (2, "closed", "/repo/src/Main.java", None, False),
    (3, "deleted", "/repo/src/Both.py", None, False), (4, "created", "/repo/src/Both.py", None, False),
    (90, "modified", "/repo/src/Main.java", None, False), (3, "modified", "/repo/src/.hidden.py", None, False),
]
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(spark, rows=EVENTS):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), *r) for s, *r in rows], S.CHANGE)


def test_change_rules(spark):
    got = Counter((r.kind, r.path) for r in C.file_changes(events(spark)).collect())
    assert got == Counter({
        ("changed", "/repo/src/Main.java"): 2, ("deleted", "/repo/src/Old.py"): 1, ("deleted", "/repo/src/Bar.java"): 1,
        ("changed", "/repo/src/NewBar.PY"): 1, ("changed", "/repo/src/k.py"): 1,
        ("deleted", "/repo/src/Both.py"): 1, ("changed", "/repo/src/Both.py"): 1})
    kinds = {r.path: r.kind for r in C.collapse(C.file_changes(events(spark))).collect()}
    assert kinds["/repo/src/Both.py"] == "deleted"
    last = {r.path: r.kind for r in C.collapse(C.file_changes(events(spark)), "last").collect()}
    assert last["/repo/src/Both.py"] == "changed"
    rel = incremental.relativise(C.file_changes(events(spark)).withColumnRenamed("path", "filepath"), "/repo/src/")
    assert "Main.java" in uids(rel, "filepath")


@pytest.mark.parametrize("options", [{"every": "10 seconds"}, {"gap": "30 seconds"}])
def test_stream_equals_batch(spark, tmp_path, options):
    source = tmp_path / "in"
    ends = EVENTS + [(10_000, "modified", "/repo/src/End.java", None, False)]
    events(spark, ends).repartition(3).write.json(str(source))
    stream = C.coalesce_changes(C.file_changes(C.read_changes(spark, str(source))), late="0 seconds", **options)
    query = stream.writeStream.format("memory").queryName("coalesced").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = C.coalesce_changes(C.file_changes(events(spark)), **options)
    got = spark.table("coalesced").where("path <> '/repo/src/End.java'")
    assert checks.differing_rows(got, want).isEmpty() and want.count() > 0


def test_follow(spark, tmp_path):
    root, folder, feed = tmp_path / "repo", str(tmp_path / "graph"), tmp_path / "feed"
    root.mkdir(), feed.mkdir()
    (root / "a.py").write_text(A)
    (root / "b.py").write_text(B)
    stream = C.read_changes(spark, str(feed))

    def emit(n, *rows):
        lines = [json.dumps({"ts": "2024-01-01T00:00:00Z", "event_type": k, "src_path": str(root / p),
                             "is_directory": False}) for k, p in rows]
        (feed / f"{n}.json").write_text("\n".join(lines))

    def run():
        query = follow.bootstrap_and_follow(spark, stream, folder, str(root), once=True)
        query.awaitTermination()
        return follow.latest_version(spark, folder)

    assert run() == 0
    (root / "b.py").write_text(B + "def three():\n    one()\n")
    (root / "a.py").unlink()
    emit(1, ("modified", "b.py"), ("deleted", "a.py"), ("modified", "a.py"), ("created", "vanished.py"))
    first = run()
    graph = follow.read_snapshot(spark, folder)
    full = build.build_graph(spark, str(root))
    assert first > 0 and checks.differing_rows(graph.nodes, full.nodes).isEmpty()
    assert checks.differing_rows(graph.edges, full.edges).isEmpty()
    emit(2, ("modified", "notes.txt"))
    assert run() == first                                    # nothing that matters
    # a batch that is run again finds its commit
    commits = spark.read.json(f"{folder}/commits")
    done = commits.where("version > 0").first()
    assert done.query and commits.count() == 2
    batch = spark.read.schema(stream.schema).json(str(feed))
    follow.apply_batch(batch, done.query, done.batch, folder, str(root))
    assert follow.latest_version(spark, folder) == first
    # a new checkpoint starts from batch 0 again, and none of its changes is lost
    (root / "b.py").write_text(B + "def four():\n    one()\n")
    emit(3, ("modified", "b.py"))
    follow.maintain(stream, folder, str(root), checkpoint=str(tmp_path / "other"), once=True).awaitTermination()
    assert follow.latest_version(spark, folder) > first
    graph, full = follow.read_snapshot(spark, folder), build.build_graph(spark, str(root))
    assert checks.differing_rows(graph.nodes, full.nodes).isEmpty() and checks.differing_rows(graph.edges, full.edges).isEmpty()


def test_many_warm_keys_are_spread(spark):
    # each key holds far less than the sketch's share of the rows
    from factgraph.functions import skew
    df = spark.range(60_000).selectExpr("cast(id % 600 as string) k")
    hot, nulls = skew.hot_keys(df, "k", hot_rows=100)
    assert len(hot) == 600 and nulls == 0 and all(n == 2 for _, n in hot)


def communities(spark, pairs, extra=(), **options):
    names = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(n,) for n in names], "uid string")
    edges = spark.createDataFrame(pairs, "source_uid string, target_uid string")
    return L.louvain(nodes, edges, **options), nodes, edges


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.community, set()).add(r.uid)
    return sorted(map(sorted, out.values()))


def test_louvain_keeps_cliques_whole(spark):
    cliques = [[f"c{k}n{i}" for i in range(5)] for k in range(3)]
    pairs = [(a, b) for c in cliques for a in c for b in c if a < b] + [("c0n0", "c0n0")]
    found, _, _ = communities(spark, pairs, ["alone"])
    assert groups(found) == sorted([["alone"]] + cliques)


def greedy_modularity(pairs):
    """Plain single-threaded Louvain for comparison."""
    def one_level(adj, loops):
        k = {u: sum(n.values()) + 2 * loops.get(u, 0) for u, n in adj.items()}
        m2, c, tot = sum(k.values()), {u: u for u in adj}, dict(k)
        moved = True
        while moved:
            moved = False
            for u in sorted(adj):
                w = Counter()
                for v, x in adj[u].items():
                    w[c[v]] += x
                tot[c[u]] -= k[u]
                best = max(sorted(set(w) | {c[u]}), key=lambda g: (w[g] - tot[g] * k[u] / m2, g == c[u]))
                moved |= best != c[u]
                c[u] = best
                tot[best] += k[u]
        return c

    adj, loops, member = {}, {}, {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            adj.setdefault(x, Counter())[y] = 1
            member[x] = x
    while True:
        c = one_level(adj, loops)
        if all(c[u] == u for u in c):
            return member
        nxt, nl = {}, Counter()
        for u, ns in adj.items():
            nxt.setdefault(c[u], Counter())
            nl[c[u]] += loops.get(u, 0)
            for v, x in ns.items():
                if c[u] == c[v]:
                    nl[c[u]] += x / 2
                else:
                    nxt[c[u]][c[v]] += x
        adj, loops, member = nxt, nl, {x: c[g] for x, g in member.items()}


def test_louvain_quality_and_stability(spark):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(60)]
    pairs = sorted({tuple(sorted((a, b))) for i, a in enumerate(names) for b in names[i + 1:]
                    if rng.random() < (0.5 if i // 15 == names.index(b) // 15 else 0.02)})
    found, _, edges = communities(spark, pairs)
    q = L.modularity(found, edges).first()[0]
    plain = spark.createDataFrame(list(greedy_modularity(pairs).items()), "uid string, community string")
    assert q >= 0.98 * L.modularity(plain, edges).first()[0]
    assert found.count() == found.select("uid").distinct().count() == len({x for p in pairs for x in p})
    salted, _, _ = communities(spark, pairs, hot_degree=4)
    assert groups(salted) == groups(found)


def test_louvain_asks_again_only_where_something_changed(spark, monkeypatch):
    rng = random.Random(3)
    # trees under a few roots, and some links across
    pairs = sorted({(f"n{rng.randrange(i) // 8:03d}", f"n{i:03d}") for i in range(1, 60)}
                   | {(f"n{rng.randrange(60):03d}", f"n{rng.randrange(60):03d}") for _ in range(4)})
    every, nodes, edges = communities(spark, pairs, ["alone"])
    asked = []
    keep = L.Scratch.keep
    monkeypatch.setattr(L, "FEW_SHARE", 1)
    monkeypatch.setattr(L, "FEW_ASKED", 1)
    monkeypatch.setattr(L.Scratch, "keep", lambda self, df, name="t": asked.append(name) or keep(self, df, name))
    few = L.louvain(nodes, edges, few_from=0)
    assert "again" in asked
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))


def test_domains(spark):
    members = [(f"u{i:03d}", 1 if i < 70 else 2 if i < 74 else 3) for i in range(76)]
    found = spark.createDataFrame(members, "uid string, community long")
    domains, membership = D.name_domains(found)
    assert [tuple(r) for r in domains.orderBy("uid").collect()] == [("Domain_0", "Domain 0", 70), ("Domain_1", "Domain 1", 4)]
    assert membership.count() == 74
    nodes = spark.createDataFrame(
        [(u, f"n{u}", "q", "Function", "f", 1, 1, None, "s()" if i % 2 else None, None) for i, (u, _) in enumerate(members)],
        S.NODE)
    full = D.summarise(domains, membership, nodes)
    got = {r.uid: r for r in full.collect()}
    lines = [f"- n{u}: s()" if i % 2 else f"- n{u}" for i, (u, _) in enumerate(members)]
    assert got["Domain_0"].summary.endswith("Contains:\n" + "\n".join(lines[:70])[:100] + "...")
    parts = D.domain_context(membership, nodes, part_lines=10).where("domain_uid = 'Domain_0'")
    assert parts.count() > 1
    assert sorted(x for r in parts.collect() for x in r.text.split("\n")) == sorted(lines[:70])
    own = D.summarise(domains, membership, nodes, lambda t: t.groupBy("domain_uid").agg(
        F.concat(F.lit("parts: "), F.count("*").cast("string")).alias("summary")))
    assert {r.summary for r in own.collect()} == {"parts: 1"}
    listing = D.get_domains(full, membership.where("domain_uid = 'Domain_1'")).collect()
    assert [(r.name, r.member_count) for r in listing] == [("Domain 1", 4), ("Domain 0", 0)]
    assert D.get_domain(full, membership, nodes, "Domain 1").count() == 4
    assert D.get_domain(full, membership, nodes, "Domain 9").isEmpty()
    assert D.domain_of(membership, full, nodes, "nu072").first().domain == "Domain 1"
    moved = membership.where("uid <> 'u000'")
    assert [tuple(r) for r in D.changed_domains(membership, moved).collect()] == [("Domain_0", "changed")]
    edges = spark.createDataFrame([("u070", "u071", "calls", "f", 1, ""), ("u070", "u001", "calls", "f", 1, "")], S.EDGE)
    assert D.domain_subgraph(membership, edges, "Domain_1").count() == 1


def test_louvain_ends_by_the_tolerance_alone(spark):
    import inspect
    assert not {"max_levels", "max_rounds"} & set(inspect.signature(L.louvain).parameters)
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i in range(4) for j in range(i)]
    ring = cliques + [(f"{a}0", f"{b}1") for a, b in zip("abcdef", "bcdefa")]
    found, _, _ = communities(spark, ring)
    assert groups(found) == [[f"{c}{i}" for i in range(4)] for c in "abcdef"]


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def assert_same_graph(got, want):
    for a, b in zip(got, want):
        assert checks.differing_rows(a, b).isEmpty()


def sources(spark, texts):
    from factgraph.sources.tree import as_files
    return as_files(spark.createDataFrame(list(texts.items()), "filepath string, content string"))


def test_live_graph_equals_a_full_index(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "live")
    texts = {f"m{i}.py": f"def f{i}():\n    f{(i + 1) % 9}()\n    shared()\n\nclass C{i}:\n    pass\n" for i in range(9)}
    texts["lib.py"] = "def shared():\n    pass\n"
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "filepath string")
    assert live.create(build.graph_of_files(sources(spark, texts)), folder) == 0
    steps = [
        ({"m1.py": "def f1():\n    f2()\n\ndef shared():\n    pass\n"}, []),              # a second callable of the name
        ({"m2.py": "def other():\n    shared()\n    f1()\n"}, ["m3.py"]),                 # names go away
        ({"m1.py": "def f1():\n    pass\n"}, ["lib.py"]),                                  # no callable of the name is left
        ({"m3.py": texts["m3.py"], "new.py": "def shared():\n    f3()\n"}, ["m2.py"]),    # and one comes back elsewhere
        ({"bad.py": "def f(:\n"}, []),
        ({}, ["bad.py", "never.py"])]
    states = [dict(texts)]
    for i, (changed, deleted) in enumerate(steps, 1):
        if i % 2 == 0:
            monkeypatch.setattr(live, "FEW", 0)         # through joins
        texts = {k: v for k, v in (texts | changed).items() if k not in deleted}
        states.append(dict(texts))
        # a changed path that is gone by now counts as deleted
        version = live.apply(spark, folder, paths(*changed, *(["gone.py"] if i == 3 else [])), paths(*deleted), sources(spark, texts))
        monkeypatch.undo()
        assert version == i
        assert_same_graph(live.read(spark, folder), build.graph_of_files(sources(spark, texts)))
    assert_same_graph(live.read(spark, folder, 2), build.graph_of_files(sources(spark, states[2])))
    before = live.read(spark, folder)
    assert live.compact(spark, folder) == 7 and live.compact(spark, folder) == 7
    assert_same_graph(live.read(spark, folder), before)
    assert live.state(spark, folder).changes == []
    live.apply(spark, folder, paths("m0.py"), paths(), sources(spark, texts | {"m0.py": "def g():\n    shared()\n"}))
    live.retain(spark, folder)
    assert_same_graph(live.read(spark, folder), build.graph_of_files(sources(spark, texts | {"m0.py": "def g():\n    shared()\n"})))
    with pytest.raises(ValueError):
        live.read(spark, folder, 99)


def test_one_change_writes_as_much_in_any_graph(spark, tmp_path):
    written = []
    for n in (20, 400):
        folder = str(tmp_path / str(n))
        texts = {f"p{i}.py": f"def f{i}():\n    g()\n    f{i + 1}()\n" for i in range(n)} | {"g.py": "def g():\n    pass\n"}
        live.create(build.graph_of_files(sources(spark, texts)), folder)
        before = bytes_below(folder)
        one = spark.createDataFrame([("p7.py",)], "filepath string")
        live.apply(spark, folder, one, one.limit(0), sources(spark, texts | {"p7.py": "def f7():\n    f9()\n"}))
        written.append(bytes_below(folder) - before)
    assert written[1] < 1.05 * written[0]


def test_two_writers_never_share_a_version(spark, tmp_path):
    folder = str(tmp_path / "live")
    texts = {"a.py": "def a():\n    pass\n"}
    live.create(build.graph_of_files(sources(spark, texts)), folder)
    row = {"version": 1, "base": 0, "folder": "change-x", "paths": 1, "names": 0}
    from factgraph.functions import storage
    assert storage.create_once(spark, f"{folder}/commits/{1:012d}.json", json.dumps(row))
    with pytest.raises(live.Conflict):
        live._commit(spark, folder, row | {"folder": "change-y"})
    # claims of the other store
    taken = []
    storage.create_once(spark, f"{tmp_path}/g/claims/{1:012d}")
    storage.publish(spark, f"{tmp_path}/g", taken.append)
    assert taken == [storage.version_path(f"{tmp_path}/g", 2)] and storage.published(spark, f"{tmp_path}/g") == 2


def test_many_changes_are_compacted(spark, tmp_path):
    root, folder = tmp_path / "repo", str(tmp_path / "graph")
    root.mkdir()
    (root / "a.py").write_text(A)
    live.create(build.build_graph(spark, str(root)), folder)
    for i in range(3):
        (root / f"x{i}.py").write_text(f"def x{i}():\n    one()\n")
        batch = spark.createDataFrame([("modified", str(root / f"x{i}.py"), None, False)],
                                      "event_type string, src_path string, dest_path string, is_directory boolean") \
            .withColumn("ts", F.current_timestamp())
        follow.apply_batch(batch, "q", i, folder, str(root), compact_after=2)
    assert len(live.state(spark, folder).changes) == 1 and live.latest_version(spark, folder) == 4
    assert_same_graph(follow.read_snapshot(spark, folder), build.build_graph(spark, str(root)))


def test_a_stored_graph_is_written_once(spark, monkeypatch):
    """Nodes no step changes and edges the ingest has written are not copied."""
    from factgraph.functions.storage import Scratch
    from factgraph.plans import queries as Q

    node = lambda uid, name: (uid, name, name, "Function", "f", 1, 1, None, None, None)
    nodes = spark.createDataFrame([node("a", "one"), node("b", "two")], S.NODE)
    edges = spark.createDataFrame([("a", t, "calls", "f", 1, t) for t in ("unresolved:two", "unresolved:lost")], S.EDGE)
    monkeypatch.setattr(Q, "graph", lambda spark, sf: (nodes, edges))
    monkeypatch.setattr(Q, "_kept", {})
    written, keep = [], Scratch.keep

    def counted(self, df, name="t"):
        written.append(name)
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", counted)
    for _ in range(2):
        assert Q.resolved(spark, "once")[0].inputFiles() == Q.facts(spark, "once")[0].inputFiles()
        found, links = Q.stored(spark, "once")
        assert sorted(r["uid"] for r in found.collect()) == ["a", "b", "unresolved:lost"]
        assert sorted(r["target_uid"] for r in links.collect()) == ["b", "unresolved:lost"]
    # facts: two tables; resolved edges; merged edges and all nodes
    assert len(written) == 5


def test_neighbourhoods_join_each_relation_once(spark, tmp_path):
    from factgraph.operators import adjacency
    node = "uid string, name string, node_type string, filepath string, signature string"
    nodes = spark.createDataFrame([("a", "f", "Function", "x", "f()"), ("a", "f", "Class", "x", None), ("b", "g", "Function", "y", "g()"),
                                   ("u", None, "Unresolved", None, None), ("b@1", "if@L1", "ConditionalBranch", "y", None)], node)
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "u", "calls"), ("b", "b@1", "has_branch"),
                                   ("a", "gone", "calls"), ("gone", "b", "calls"), ("a", "b", "contains"), ("b", "b", "calls")],
                                  "source_uid string, target_uid string, edge_type string")
    relations = adjacency._relations(nodes, edges)
    # a relation comes once for each pair of nodes at its ends, and not once more for each side
    assert relations.count() == 2 * 2 + 1 + 1 + 1
    rows = adjacency._around(relations)
    seen = sorted((r.role, r.symbol, r.center_type, r.other_uid, r.name or "") for r in rows.collect())
    assert seen == sorted(
        2 * [("caller", "g", "Function", "a", "f")] * 2 + 2 * [("callee", "f", "Function", "b", "g")] + 2 * [("callee", "f", "Class", "b", "g")]
        + [("callee", "g", "Function", "u", ""), ("caller", "g", "Function", "b", "g"), ("callee", "g", "Function", "b", "g"),
           ("branch", "g", "Function", "b@1", "if@L1")])


def test_packed_scratch(spark, tmp_path):
    from factgraph.functions.storage import Scratch
    rows = spark.range(20_000).selectExpr("'some/long/common/start/' || id AS uid")
    size = {}
    for packed in (False, True):
        scratch = Scratch(spark, "size", packed=packed)
        assert scratch.keep(rows).count() == 20_000
        files = spark.read.parquet(f"{scratch.folder}/0001-t").inputFiles()
        size[packed] = sum(os.path.getsize(f.removeprefix("file://")) for f in files)
        scratch.drop_all_but()
    assert size[True] < size[False]


def test_packed_tables_hold_differences(spark, tmp_path):
    import pyarrow.parquet as pq
    from factgraph.functions.storage import Scratch
    kept = Scratch(spark, "packed", packed=True)
    df = kept.keep(spark.range(2000).selectExpr("concat('src/main/java/shop/Order', id, '.price') AS uid", "id"))
    file = next(f for f in df.inputFiles() if f.endswith(".parquet"))
    column = pq.ParquetFile(file.removeprefix("file://")).metadata.row_group(0).column(0)
    assert "DELTA_BYTE_ARRAY" in column.encodings and column.compression == "ZSTD"
    assert df.count() == 2000 and df.where("uid = 'src/main/java/shop/Order7.price'").count() == 1
