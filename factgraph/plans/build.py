"""From a source tree, or a table of files, to a stored graph with domains."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.functions.storage import Scratch
from factgraph.operators import store
from factgraph.operators.domains import name_domains, save_domains, summarise
from factgraph.operators.incremental import Graph
from factgraph.operators.louvain import louvain
from factgraph.operators.resolve import resolve_calls
from factgraph.operators.subgraph import domain_projection
from factgraph.sources.extract import explode_result, read_facts
from factgraph.sources.tree import scan_tree


def graph_of_files(files: DataFrame, strict: bool = False) -> Graph:
    """Facts of a files table with resolved names; every file is read once."""
    results = Scratch(files.sparkSession, "facts").keep(read_facts(files, strict), "results")
    nodes, edges, errors = explode_result(results)
    return Graph(nodes, resolve_calls(nodes, edges), errors)


def build_graph(spark: SparkSession, root: str, strict: bool = False) -> Graph:
    return graph_of_files(scan_tree(spark, root), strict)


def ingest(spark: SparkSession, graph: Graph, folder: str, mode: str = "merge") -> tuple[DataFrame, DataFrame]:
    """Merge a graph into the stored one (``merge``) or replace it
    (``overwrite``).  An empty graph changes nothing when merged."""
    if mode == "merge" and store.graph_exists(spark, folder):
        current = store.read_graph(spark, folder)
    else:
        current = store.empty_graph(spark)
    scratch = Scratch(spark, "ingest")
    store.write_graph(*store.ingest(*current, graph.nodes, graph.edges, scratch), folder)
    scratch.drop_all_but()
    return store.read_graph(spark, folder)


def cluster(spark: SparkSession, folder: str,
            summariser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Find, name, summarise and store the domains of a stored graph; None
    when there is nothing to group."""
    nodes, edges = store.read_graph(spark, folder)
    inner_nodes, inner_edges = domain_projection(nodes, edges)
    if inner_nodes.isEmpty():
        return None
    domains, membership = name_domains(louvain(inner_nodes, inner_edges))
    domains = summarise(domains, membership, nodes, summariser)
    save_domains(domains, membership, folder)
    return domains
