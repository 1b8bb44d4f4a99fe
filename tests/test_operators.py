from collections import Counter

import pytest
from pyspark.sql import functions as F

from factgraph import schema as S
from factgraph.functions import skew
from factgraph.functions.skew import hot_keys, salted_join
from factgraph.operators import checks, lookups, resolve, search, store, subgraph, summary


def nodes_df(spark, rows):
    """rows: (uid, name, node_type[, filepath[, signature[, docstring]]])"""
    out = []
    for r in rows:
        uid, name, kind, path, sig, doc = (list(r) + [None] * 6)[:6]
        out.append((uid, name, name, kind, path or "f", 1, 1, doc, sig, None))
    return spark.createDataFrame(out, S.NODE)


def edges_df(spark, rows):
    """rows: (source, target, type[, filepath[, line]])"""
    out = []
    for r in rows:
        s, t, kind, path, line = (list(r) + [None] * 5)[:5]
        out.append((s, t, kind, path, line, t))
    return spark.createDataFrame(out, S.EDGE)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture
def small(spark):
    nodes = nodes_df(spark, [
        ("f:A", "A", "Class"), ("f:A.go", "go", "Function", "f", "go()"), ("f:A.A", "A", "Constructor"),
        ("f:B.run", "run", "Function"), ("g:C.run", "run", "Function", "g"), ("f:A.go:branch@L1", "if@L1", "ConditionalBranch")])
    edges = edges_df(spark, [
        ("f", "f:A", "contains"), ("f:A.go", "unresolved:x.A.<init>", "calls", "f", 3),
        ("f:B.run", "unresolved:a.go", "calls", "f", 1), ("g:C.run", "unresolved:go", "calls", "g", 2),
        ("f:A.go", "unresolved:b.run", "calls", "f", 4), ("f:A.go", "unresolved:none", "calls", "f", 5),
        ("f:A", "unresolved:go", "extends", "f", 1), ("f:A.go", "f:A.go:branch@L1", "has_branch", "f", 1),
        ("g:C.run", "unresolved:<init>", "calls", "g", 9)])
    return nodes, edges


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_resolve(spark, small, hot_rows):
    nodes, edges = small
    done = resolve.resolve_calls(nodes, edges, hot_rows=hot_rows)
    got = {(r.source_uid, r.raw_target): r.target_uid for r in done.collect()}
    assert got[("f:A.go", "unresolved:x.A.<init>")] == "f:A.A"
    assert got[("f:B.run", "unresolved:a.go")] == "f:A.go"
    assert got[("f:A", "unresolved:go")] == "f:A.go"                  # extends is tried too
    assert got[("f:A.go", "unresolved:b.run")] == "unresolved:b.run"  # two candidates
    assert got[("f:A.go", "unresolved:none")] == "unresolved:none"
    assert got[("g:C.run", "unresolved:<init>")] == "unresolved:<init>"
    assert len(got) == 9
    only = resolve.resolve_calls(nodes, edges, ["calls"])
    assert ("f:A", "unresolved:go") in rows(only, "source_uid", "target_uid")
    report = resolve.resolution_report(nodes, edges).first()
    assert tuple(report) == (4, 1, 2, 9)


def test_resolution_follows_new_ambiguity(spark, small):
    nodes, edges = small
    done = resolve.resolve_calls(nodes, edges)
    more = nodes.unionByName(nodes_df(spark, [("h:go", "go", "Function", "h")]))
    fresh = resolve.resolve_calls(more, done)
    sticky = resolve.resolve_calls(more, done, mode="sticky")
    assert ("f:B.run", "unresolved:a.go") in rows(fresh, "source_uid", "target_uid")
    assert ("f:B.run", "f:A.go") in rows(sticky, "source_uid", "target_uid")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(
            F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), (F.col("id") % 5).alias("v"))
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3), ("other", 4)], "r string, x int")
    got = salted_join(left, right, "k", "r", how, hot_rows=50)
    want = left.join(right, left.k == right.r, how).drop("r")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert hot_keys(left, "k", 50) == ([("hot", 40)], 1000)
    # rows that are exact copies of one another are spread as well
    copies = left.where("k = 'hot'").select("k").repartition(8)
    assert copies.count() == salted_join(copies, right, "k", "r", hot_rows=50).count()


def stored(spark, small):
    nodes, edges = small
    return store.ingest(*store.empty_graph(spark), nodes, resolve.resolve_calls(nodes, edges))


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_lookups(spark, small, hot_rows):
    nodes, edges = stored(spark, small)
    assert rows(lookups.get_callers(nodes, edges, "go", hot_rows)) == [
        ("go", "Function", "run", "f"), ("go", "Function", "run", "g")]
    callees = lookups.get_callees(nodes, edges, "go", hot_rows).collect()
    assert Counter((c.type, c.name) for c in callees) == {("Constructor", "A"): 1, ("Unresolved", None): 2}
    context = lookups.get_code_context(nodes, edges, "go", hot_rows=hot_rows)
    assert rows(context, "role", "name") == [
        ("branch", "if@L1"), ("callee", "A"), ("caller", "run"), ("center", "go")]
    assert tuple(lookups.context_counts(context).first()) == ("go", "Function", "f", "go()", 1, 1, 1)
    first = lookups.get_code_context(nodes, edges, "run", first_only=True)
    assert {r.filepath for r in first.collect()} == {"f"}
    assert lookups.get_code_context(nodes, edges, "nothing").isEmpty()
    assert lookups.get_callers(nodes, edges, "nothing").isEmpty()


def test_named_lookups_from_a_store(spark, small, tmp_path, monkeypatch):
    nodes, edges = stored(spark, small)
    folder = str(tmp_path / "g")
    store.write_graph(nodes, edges, folder)
    kept = store.read_graph(spark, folder)
    for few in (1000, 0):           # from the few rows of a name, and by joins alone
        monkeypatch.setattr(skew, "FEW", few)
        monkeypatch.setattr(lookups, "FEW", few)
        for ask in (lookups.get_callers, lookups.get_callees, lookups.get_code_context):
            for name in ("go", "run", "nothing"):
                assert rows(ask(*kept, name)) == rows(ask(nodes, edges).where(F.col("symbol") == name))
    store.write_graph(nodes.limit(0), edges.limit(0), folder)
    assert not kept[0].isEmpty() and store.read_graph(spark, folder)[0].isEmpty()
    store.write_graph(nodes, edges, folder)
    store.retain(spark, folder, 1)
    assert sorted(p.name for p in (tmp_path / "g" / "graph").glob("0*")) == ["000000000003"]
    assert rows(store.read_graph(spark, folder)[1]) == rows(edges)


def test_present_and_pages(spark):
    df = nodes_df(spark, [("u1", "a", "Function", "f", None, "x" * 101), ("u2", "b", "Class", "f", "s", "y" * 100)])
    got = {r.uid: r for r in lookups.present(df).collect()}
    assert got["u1"].signature == "N/A" and got["u1"].docstring == "x" * 100 + "..."
    assert got["u2"].docstring == "y" * 100
    assert [r.uid for r in lookups.page(df.select("uid"), ["uid"], 1, 5).collect()] == ["u2"]


def test_upserts(spark):
    a = nodes_df(spark, [("u", "old", "Function", "f", "sig"), ("v", "v", "Class")])
    b = nodes_df(spark, [("u", "new", "Function", "f", None), ("u", "label", "Class")])
    merged = store.upsert_nodes(a, b)
    assert rows(merged, "uid", "node_type", "name") == [
        ("u", "Class", "label"), ("u", "Function", "new"), ("v", "Class", "v")]
    assert merged.where("name = 'new'").first().signature is None      # null clears
    ordered = b.unionByName(nodes_df(spark, [("u", "newest", "Function")])).withColumn(
        "seq", F.when(F.col("name") == "new", 9).otherwise(1))
    assert rows(store.upsert_nodes(a, ordered).where("node_type = 'Function'"), "name") == [("new",)]
    e = store.upsert_edges(edges_df(spark, [("a", "b", "calls", "f", 1)]),
                           edges_df(spark, [("a", "b", "calls", "f", 7), ("a", "b", "calls", "f", 3), ("a", "b", "returns")]))
    assert rows(e.where("edge_type = 'calls'"), "line") == [(7,)] and e.count() == 2


def test_placeholders_and_orphans(spark):
    nodes = nodes_df(spark, [("a", "a", "Function")])
    edges = edges_df(spark, [("a", "unresolved:x", "calls"), ("ghost", "a", "calls")])
    full = store.materialise_placeholders(nodes, edges)
    assert rows(full, "uid", "node_type") == [("a", "Function"), ("ghost", "Unlabelled"), ("unresolved:x", "Unresolved")]
    later = edges.where("source_uid <> 'a'")
    assert rows(store.orphans(full, later), "uid") == [("unresolved:x",)]
    assert rows(store.drop_orphans(full, later), "uid") == [("a",), ("ghost",)]
    again_nodes, _ = store.ingest(full, edges, nodes_df(spark, [("unresolved:x", "x", "Function")]), edges.limit(0))
    assert rows(again_nodes.where("uid = 'unresolved:x'"), "node_type") == [("Function",)]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_purge_and_delete(spark, hot_rows):
    nodes = nodes_df(spark, [("a", "a", "Class", "keep"), ("b", "b", "Class", "gone")])
    edges = edges_df(spark, [("a", "b", "calls", "keep"), ("a", "a", "calls", None), ("b", "a", "calls", "gone")])
    paths = spark.createDataFrame([("gone",), ("gone",), ("unknown",)], "filepath string")
    assert rows(store.purge_files(edges, paths, hot_rows), "source_uid", "target_uid") == [("a", "a"), ("a", "b")]
    n, e = store.delete_file_subgraph(nodes, edges, paths, hot_rows)
    assert rows(n, "uid") == [("a",)] and rows(e, "source_uid", "target_uid") == [("a", "a")]


def test_delete_shuffles_only_edges_that_may_go(spark, tmp_path, monkeypatch):
    from factgraph.functions import skew
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    nodes = nodes_df(spark, [(f"n{i}", "n", "Class", "gone" if i % 50 == 0 else None if i % 50 == 1 else "keep") for i in range(2_000)])
    pairs = [(f"n{i}", f"n{i * 7 % 2_100}", "calls") for i in range(2_100)] + [(None, "n1", "calls"), ("n0", None, "calls"), ("n1", None, "calls")]
    pairs += pairs[:100]
    spark.createDataFrame(pairs, "source_uid string, target_uid string, edge_type string").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    paths = spark.createDataFrame([("gone",), (None,)], "filepath string")
    left = store.delete_file_subgraph(nodes, edges, paths)[1]
    gone = {f"n{i}" for i in range(0, 2_000, 50)}
    want = [p[:2] for p in pairs if not gone & set(p[:2])]
    assert sorted(str(tuple(r)[:2]) for r in left.collect()) == sorted(map(str, want))
    marked = skew.KeyFilter(spark.createDataFrame([(g,) for g in gone], "g string"), "g", len(gone)).mark(edges, "source_uid", "may")
    assert {r.source_uid for r in marked.where("may").collect()} >= gone
    assert marked.where("may").count() < 0.2 * len(pairs) and marked.count() == len(pairs)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_graph_round_trip(spark, small, tmp_path):
    nodes, edges = stored(spark, small)
    store.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = store.read_graph(spark, str(tmp_path / "g"))
    assert checks.differing_rows(n, nodes).isEmpty() and checks.differing_rows(e, edges).isEmpty()
    plan = n.where("node_type = 'Class'").select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node_type" in plan
    store.clear_graph(spark, str(tmp_path / "g"))
    assert store.read_graph(spark, str(tmp_path / "g"))[0].isEmpty()


def test_checks(spark):
    nodes = nodes_df(spark, [("a", "a", "Class"), ("a", "a", "Class"), ("b", "b", "Function"), ("c", "c", "File")])
    edges = edges_df(spark, [("c", "a", "contains"), ("c", "b", "contains"), ("a", "b", "contains")])
    assert rows(checks.duplicate_uids(nodes)) == [("a", 2)]
    assert rows(checks.contains_violations(nodes, edges)) == [("b", 2)]
    with pytest.raises(ValueError, match="'a' occurs 2 times"):
        store.assert_unique(nodes)
    store.assert_unique(nodes.distinct())


def test_summaries(spark, small):
    nodes, edges = small
    assert rows(summary.node_summary(nodes)) == [("Class", 1), ("ConditionalBranch", 1), ("Constructor", 1), ("Function", 3)]
    assert tuple(summary.unresolved_count(edges).first()) == (7, 9)
    assert tuple(summary.graph_stats(nodes).first()) == (0, 1, 3, 1, 1)
    assert rows(summary.first_classes(nodes)) == [("A", "f:1")]
    warnings = spark.createDataFrame([("f", f"w{i:02d}") for i in range(13)], "filepath string, message string")
    assert rows(summary.first_warnings(warnings))[:2] == [("... and 3 more",), ("w00",)]
    assert summary.first_warnings(warnings.limit(3)).count() == 3


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_subgraphs(spark, hot_rows):
    edges = edges_df(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("b", "a", "calls"), ("x", "x", "calls")])
    nodes = nodes_df(spark, [(u, u, "Function") for u in "abcx"])
    inner = subgraph.induced_subgraph(nodes, edges, hot_rows)
    assert rows(inner, "source_uid", "target_uid") == [("a", "b"), ("b", "a"), ("b", "c"), ("x", "x")]
    assert rows(subgraph.to_undirected(inner)) == [("a", "b"), ("b", "c"), ("x", "x")]
    seeds = spark.createDataFrame([("a",)], "uid string")
    assert rows(subgraph.khop(edges, seeds, 2, hot_rows=hot_rows)) == [("a", 0), ("b", 1), ("c", 2)]


def test_search(spark, tmp_path):
    nodes = nodes_df(spark, [
        ("1", "CheckoutService", "Class", "shop/Checkout.java", None, "Pays the basket. Pays it once."),
        ("2", "pay", "Function", "shop/Checkout.java", "void pay(Basket basket)", None),
        ("3", "Basket", "Class", "shop/Basket.java", None, None),
        ("4", "basket", "ConditionalBranch", "shop/Basket.java", None, None)])
    found = search.search_nodes(nodes, "basket").collect()
    assert [r.uid for r in found][0] == "3" and {r.uid for r in found} == {"1", "2", "3"}
    assert search.search_nodes(nodes, "absent").isEmpty()
    assert search.search_nodes(nodes, "  ").isEmpty()
    assert {r.uid for r in search.search_nodes(nodes, "check*").collect()} == {"1", "2"}
    assert {r.uid for r in search.search_nodes(nodes, "p?ys").collect()} == {"1"}
    index = search.build_search_index(nodes)
    assert rows(index.postings.where("field = 'docstring'"), "term", "tf", "dl") == [
        ("basket", 1, 6), ("it", 1, 6), ("once", 1, 6), ("pays", 2, 6), ("the", 1, 6)]
    search.write_index(index, str(tmp_path / "i"))
    again = search.search_index(search.read_index(spark, str(tmp_path / "i")), "basket pay*")
    assert rows(again) == rows(search.search_index(index, "basket pay*"))
    assert len(search.search_index(index, "shop", 2).collect()) == 2


def _written(monkeypatch):
    """Names of the tables that are written from now on."""
    from factgraph.functions.storage import Scratch
    names, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": names.append(name) or keep(self, df, name))
    return names


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_many_edges_are_resolved_without_a_shuffle_of_all(spark, small, monkeypatch, few):
    nodes, edges = small
    want = rows(resolve.resolve_calls(nodes, edges))
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(resolve, "FEW_ANSWERS", few)
    written = _written(monkeypatch)
    done = resolve.resolve_calls(nodes, edges)
    assert rows(done) == want and written == ["answers"]
    if few:     # answers are sent to the edges
        assert "SortMergeJoin" not in done._jdf.queryExecution().executedPlan().toString()


def test_only_keys_that_may_come_again_are_merged(spark, monkeypatch):
    old = edges_df(spark, [("a", "b", "calls", "f", 9), ("a", "c", "calls", "f", 1)])
    new = edges_df(spark, [("a", "b", "calls", "g", 3), ("a", "b", "calls", "g", 5)] + [(f"x{i}", "b", "calls", "g", i) for i in range(50)]
                   + [("x7", "b", "calls", "h", 7)])
    nodes = nodes_df(spark, [("u", None, "Class"), ("u", "n", "Class"), ("v", "v", "Class")])
    merge = lambda: (rows(store.upsert_edges(old, new)), sorted(map(repr, store.upsert_nodes(nodes.limit(0), nodes).collect())))
    want = merge()
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    written = _written(monkeypatch)
    assert merge() == want and len(want[0]) == 52 and written == ["again", "again"]
    assert store.upsert_edges(old, new).schema.fieldNames() == S.EDGE_COLS


def test_edges_of_strangers_stay_out_of_joins(spark, small, monkeypatch):
    nodes, edges = stored(spark, small)
    ask = lambda: [rows(df) for df in (
        subgraph.induced_subgraph(lookups.nodes_of(nodes, S.CLASS, S.FUNCTION), edges), subgraph.domain_projection(nodes, edges)[1],
        lookups.get_callers(nodes, edges), lookups.get_code_context(nodes, edges))]
    want = ask()
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    assert ask() == want
    many = spark.createDataFrame([("k1" if i == 5 else f"s{i}" if i % 9 else None,) for i in range(3000)], "k string")
    left = skew.without_strangers(many, spark.createDataFrame([("k1",), ("k2",), (None,)], "uid string"), "uid", "k")
    kept = [r.k for r in left.collect()]
    assert "k1" in kept and len(kept) < 100 and None not in kept
    monkeypatch.setattr(skew, "FILTER_KEYS", 0)
    assert skew.without_strangers(many, many.withColumnRenamed("k", "uid"), "uid", "k") is many
