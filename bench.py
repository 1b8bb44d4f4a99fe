"""Times the headline work and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check_oracle import session
from factgraph import schema as S
from factgraph.functions.storage import Scratch
from factgraph.operators import adjacency, incremental, live, lookups, louvain, resolve, search, store, subgraph
from factgraph.plans import build, queries as Q
from factgraph.sources import extract, generated, tables
from factgraph.streaming import changes


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    scratch = Scratch(spark, "bench")
    seconds, rates = {}, {}

    def timed(name, fn, rows=None, unit="rows/s"):
        t = time.time()
        out = fn()
        seconds[name] = round(time.time() - t, 3)
        if rows is not None:
            n = rows(out) if callable(rows) else rows
            rates[name] = {"value": round(n / seconds[name]), "unit": unit}
        return out

    def run(df):
        df.write.mode("overwrite").format("noop").save()

    def keep(*dfs):
        return [scratch.keep(df) for df in dfs]

    run(tables.table(spark, sf, "nation"))          # start the engine

    # the graph of the tables: build, resolve, merge
    nodes, edges = timed("derive_graph", lambda: keep(*Q.graph(spark, sf)), lambda o: sum(d.count() for d in o))
    n_edges = edges.count()
    linked, = timed("resolve_calls", lambda: keep(resolve.resolve_calls(nodes, edges)), n_edges)

    def ingest():
        store.write_graph(*store.ingest(*store.empty_graph(spark), nodes, linked), f"{scratch.folder}/graph")
        return store.read_graph(spark, f"{scratch.folder}/graph")

    nodes, edges = timed("ingest", ingest, nodes.count() + n_edges)

    # questions, for one symbol and for all, by the stored neighbourhoods
    symbol = "Supplier#000000001"
    timed("write_view", lambda: adjacency.write_view(nodes, edges, f"{scratch.folder}/graph"), n_edges)
    view = adjacency.read_view(spark, f"{scratch.folder}/graph")
    timed("callers_one", lambda: adjacency.get_callers(view, symbol).collect())
    timed("callees_one", lambda: adjacency.get_callees(view, "order_1").collect())
    timed("context_one", lambda: adjacency.get_code_context(view, symbol).collect())
    timed("callers_all", lambda: run(adjacency.get_callers(view)), n_edges)
    timed("callees_all", lambda: run(adjacency.get_callees(view)), n_edges)
    timed("context_all", lambda: run(adjacency.get_code_context(view)), n_edges)
    # the same by joins of the graph itself
    timed("callers_one_joined", lambda: lookups.get_callers(nodes, edges, symbol).collect())
    timed("context_all_joined", lambda: run(lookups.get_code_context(nodes, edges)), n_edges)
    timed("khop_two", lambda: run(Q._khop(nodes, edges)))

    # search over whole documents
    docs = Q.document_nodes(spark, sf)
    timed("search_cold", lambda: search.search_nodes(docs, "the merge und").collect())
    timed("build_search_index", lambda: search.write_index(search.build_search_index(docs), f"{scratch.folder}/index"), docs.count())
    index = search.read_index(spark, f"{scratch.folder}/index")
    timed("search_indexed", lambda: search.search_index(index, "the merge und").collect())
    timed("search_suffix", lambda: search.search_index(index, "*mentent").collect())

    # source files: full index, then one changed file
    files, = keep(generated.java_files(spark, sf))
    n_lines = files.agg({"n_lines": "sum"}).first()[0]

    def full(f):
        g = build.graph_of_files(f)
        return incremental.Graph(*keep(g.nodes, g.edges), g.errors)

    graph = timed("full_index", lambda: full(files), n_lines, "lines/s")
    one = files.limit(1).select("filepath")
    one, = keep(one)

    live.create(graph, f"{scratch.folder}/live")
    timed("update_one_file", lambda: live.apply(spark, f"{scratch.folder}/live", one, one.limit(0), files))
    timed("read_updated", lambda: [run(df) for df in live.read(spark, f"{scratch.folder}/live")])
    python = generated.python_files(spark, sf)
    timed("extract_python", lambda: run(extract.extract_facts(python)), lambda o: python.count() * 21, "lines/s")

    # change events
    ev = Q.event_changes(spark, sf)
    timed("coalesce_changes", lambda: run(changes.coalesce_changes(changes.file_changes(ev), "1 hour")), ev.count(), "events/s")

    # domains
    inner = keep(*subgraph.domain_projection(nodes, edges))
    found = timed("louvain", lambda: louvain.louvain(*inner), inner[1].count())
    quality = louvain.modularity(found, inner[1]).first()[0]

    print(json.dumps({
        "metric": "total seconds of the headline work", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf), "rates": rates, "cpus": cpus,
        "full_over_update": round(seconds["full_index"] / seconds["update_one_file"], 2),
        "modularity": round(quality, 6)}))


if __name__ == "__main__":
    main()
