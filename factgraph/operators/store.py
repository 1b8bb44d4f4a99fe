"""Keeping the stored graph: upserts, placeholders, purges, snapshots."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from factgraph import schema as S
from factgraph.functions.skew import FILTER_KEYS, KeyFilter, is_large, is_small, salted_join
from factgraph.functions.storage import PACKED, Scratch, publish, published, remove, version_path

UNLABELLED = "Unlabelled"


def _last_wins(current: DataFrame, incoming: DataFrame, key, cols, seq: str) -> DataFrame:
    """Last row per key: incoming over current, then highest ``seq``, then the
    greatest payload.  An aggregate with a map-side step, so many copies of
    one key never meet in one task.

    Of many rows most have a key of their own.  Hashes of keys, which take a
    fraction of the rows, tell which may come again; only these are shuffled.
    """
    def versioned(df, version):
        order = F.col("seq") if "seq" in df.columns else F.col(seq)
        return df.select(F.lit(version).alias("__v"), F.coalesce(order.cast("long"), F.lit(0)).alias("__s"),
                         *[F.col(c) for c in cols])

    payload = [c for c in cols if c not in key]
    rows, once = versioned(current, 0).unionByName(versioned(incoming, 1)), None
    if is_large(rows):
        # a null is left out of the hash, which keys that are equal share all the same
        hashed = F.xxhash64(*key)
        again = rows.select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        again, n = Scratch(rows.sparkSession, "again", packed=True).keep_counting(again, "again", n=F.count(F.lit(1)))
        if n["n"] <= FILTER_KEYS:
            marked = KeyFilter(again, "h", n["n"]).mark(rows.withColumn("__h", hashed), "__h", "__again")
            rows, once = marked.where("__again"), marked.where("NOT __again").select(*cols)
    best = rows.groupBy(*key).agg(F.max(F.struct("__v", "__s", *payload)).alias("b"))
    best = best.select(*[F.col(c) if c in key else F.col(f"b.{c}") for c in cols])
    return best if once is None else once.unionByName(best)


def upsert_nodes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (node_type, uid); the incoming row replaces all properties,
    nulls included.  A column ``seq`` orders incoming rows of one key, else
    their start line does."""
    return _last_wins(current, incoming, S.NODE_KEY, S.NODE_COLS, "start_line")


def upsert_edges(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (source, type, target); last file and line win."""
    return _last_wins(current, incoming, S.EDGE_KEY, S.EDGE_COLS, "line")


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows for edge ends that no node defines: Unresolved for a target,
    Unlabelled for an end that is only ever a source."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("source_uid").alias("uid"), F.lit(0).alias("is_target")),
        F.struct(F.col("target_uid").alias("uid"), F.lit(1).alias("is_target")))))
    ends = ends.groupBy("uid").agg(F.max("is_target").alias("is_target"))
    missing = ends.join(nodes.select("uid"), "uid", "left_anti")
    label = F.when(F.col("is_target") == 1, S.UNRESOLVED).otherwise(UNLABELLED)
    values = {"uid": F.col("uid"), "node_type": label}
    return missing.select(*[
        values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.NODE.fields])


def materialise_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(*S.NODE_COLS).unionByName(placeholders(nodes, edges))


def _ends(edges):
    s, t = F.col("source_uid"), F.col("target_uid")
    return edges.select(F.explode(F.array(s, t)).alias("uid")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved nodes that no edge touches."""
    return nodes.where(F.col("node_type") == S.UNRESOLVED).join(_ends(edges), "uid", "left_anti") \
        .select(*nodes.columns)


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kept = nodes.where(F.col("node_type") == S.UNRESOLVED).join(_ends(edges), "uid", "left_semi")
    return nodes.where(F.col("node_type") != S.UNRESOLVED).unionByName(kept.select(*nodes.columns))


def ingest(current_nodes: DataFrame, current_edges: DataFrame, nodes: DataFrame, edges: DataFrame,
           scratch: Scratch | None = None):
    """The stored graph after a result has been merged into it.

    Placeholders are worked out anew from the merged edges: one goes away as
    soon as its uid is defined, or once nothing points to it.  Merged edges
    are kept, since they are both a result and the source of placeholders.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "ingest", packed=True)
    merged_edges = scratch.keep(upsert_edges(current_edges, edges), "edges")
    defined = current_nodes.where(~F.col("node_type").isin(S.UNRESOLVED, UNLABELLED))
    merged_nodes = upsert_nodes(defined, nodes)
    return materialise_placeholders(merged_nodes, merged_edges), merged_edges


def purge_files(df: DataFrame, paths: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Rows that do not belong to any of ``paths`` (column ``filepath``); rows
    without a file stay."""
    gone = paths.select(F.col("filepath").alias("p")).distinct()
    return salted_join(df, gone, "filepath", "p", "left_anti", hot_rows)


def delete_file_subgraph(nodes: DataFrame, edges: DataFrame, paths: DataFrame,
                         hot_rows: int | None = None):
    """Drop the nodes of some files and every edge that touches one of them."""
    gone_paths = paths.select(F.col("filepath").alias("p")).distinct()
    gone = salted_join(nodes, gone_paths, "filepath", "p", "left_semi", hot_rows)
    gone = gone.select(F.col("uid").alias("g")).distinct()
    asked, rest = edges, None
    if not edges.isStreaming and not is_small(edges):
        # most edges touch nothing that goes and need no shuffle to show it
        gone, n = Scratch(edges.sparkSession, "gone", packed=True).keep_counting(gone, "gone", n=F.count("g"))
        if n["n"] <= FILTER_KEYS:
            going = KeyFilter(gone, "g", n["n"])
            marked = going.mark(going.mark(edges, "source_uid", "__s"), "target_uid", "__t")
            asked = marked.where("__s OR __t").select(*edges.columns)
            rest = marked.where("NOT (__s OR __t)").select(*edges.columns)
    left = salted_join(asked, gone, "source_uid", "g", "left_anti", hot_rows, edges)
    left = salted_join(left, gone, "target_uid", "g", "left_anti", hot_rows, edges)
    return purge_files(nodes, paths, hot_rows), left if rest is None else rest.unionByName(left)


def key_violations(nodes: DataFrame) -> DataFrame:
    """(node_type, uid, n) of keys that are not unique; empty when all is well."""
    return nodes.groupBy(*S.NODE_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(nodes: DataFrame) -> None:
    bad = key_violations(nodes).head(1)
    if bad:
        raise ValueError(f"uid {bad[0]['uid']!r} occurs {bad[0]['n']} times as {bad[0]['node_type']}")


def empty_graph(spark: SparkSession):
    return spark.createDataFrame([], S.NODE), spark.createDataFrame([], S.EDGE)


def lay_out(df: DataFrame, kind: str, key: str, then: str, asked: tuple[str, ...], path: str) -> None:
    """Write rows by ``kind``, sorted by ``key`` and ``then``, with Bloom filters for the columns ``asked``."""
    df = df.repartitionByRange(kind, key, then).sortWithinPartitions(kind, key, then)
    writer = df.write.mode("overwrite").partitionBy(kind).option("compression", PACKED).option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in asked:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write a new version of the stored graph.

    Nodes lie by kind and name, edges by kind and target, so that scans for a
    kind, a name or the callers of a few uids read only their part; Bloom
    filters do so for nodes by uid and edges by source.
    """
    def write(path):
        # ranges are found by a pass of their own, so nodes are worked out once, before
        scratch = Scratch(nodes.sparkSession, "layout", packed=True)
        lay_out(scratch.keep(nodes.select(*S.NODE_COLS), "nodes"), "node_type", "name", "uid", ("uid",), f"{path}/nodes")
        scratch.drop_all_but()
        lay_out(edges.select(*S.EDGE_COLS), "edge_type", "target_uid", "source_uid", ("source_uid",), f"{path}/edges")

    publish(nodes.sparkSession, f"{folder}/graph", write)


def graph_exists(spark: SparkSession, folder: str) -> bool:
    return published(spark, f"{folder}/graph") is not None


def read_graph(spark: SparkSession, folder: str):
    """(nodes, edges) of the last version."""
    version = published(spark, f"{folder}/graph")
    if version is None:
        raise ValueError(f"no graph in {folder}")
    path = version_path(f"{folder}/graph", version)
    nodes = spark.read.schema(S.NODE).parquet(f"{path}/nodes").select(*S.NODE_COLS)
    edges = spark.read.schema(S.EDGE).parquet(f"{path}/edges").select(*S.EDGE_COLS)
    return nodes, edges


def retain(spark: SparkSession, folder: str, versions: int = 2) -> None:
    """Remove the stored versions before the last ``versions``."""
    for old in range(1, (published(spark, f"{folder}/graph") or 0) - versions + 1):
        remove(spark, version_path(f"{folder}/graph", old))


def clear_graph(spark: SparkSession, folder: str) -> None:
    write_graph(*empty_graph(spark), folder)
