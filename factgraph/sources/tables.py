"""A property graph from relational tables (customers, orders, lines, parts).

Nations are files, customers classes, orders functions, suppliers
constructors, regions interfaces; every order line is a call by name.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from factgraph import schema as S
from factgraph.functions.skew import salted_join


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _customers(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey",
        "concat('f/n', c_nationkey) AS file_uid",
        "concat('f/n', c_nationkey, ':c', c_custkey) AS class_uid")


def _orders(spark, folder):
    """Orders with the uid of their function."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return salted_join(orders, _customers(spark, folder), "o_custkey", "c_custkey").withColumn(
        "order_uid", F.concat("class_uid", F.lit(".o"), F.col("o_orderkey").cast("string")))


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")


def _of_orders(spark, folder, lines, hot_from=None):
    """Order lines with the uid of their order's function, the lines of an order side by side."""
    orders = _orders(spark, folder).select("o_orderkey", "order_uid", "file_uid")
    return salted_join(lines, orders, "l_orderkey", "o_orderkey", hot_from=hot_from)


def _nodes(df, uid, name, qualified, node_type, filepath, start="1", end="1",
           doc="NULL", sig="NULL", fhash="NULL"):
    return df.selectExpr(
        f"{uid} AS uid", f"{name} AS name", f"{qualified} AS qualified_name",
        f"'{node_type}' AS node_type", f"{filepath} AS filepath",
        f"CAST({start} AS INT) AS start_line", f"CAST({end} AS INT) AS end_line",
        f"CAST({doc} AS STRING) AS docstring", f"CAST({sig} AS STRING) AS signature",
        f"CAST({fhash} AS STRING) AS file_hash")


def table_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    supplier, part = table(spark, folder, "supplier"), table(spark, folder, "part")
    customers, orders = _customers(spark, folder), _orders(spark, folder)
    returned = _of_orders(spark, folder, _lines(spark, folder).where("l_returnflag = 'R'"))
    return _union([
        _nodes(nation, "concat('f/n', n_nationkey)", "n_name", "n_name", S.FILE,
               "concat('f/n', n_nationkey)", "1", "100", fhash="sha2(n_name, 256)"),
        _nodes(customers, "class_uid", "c_name", "concat('c', c_custkey)", S.CLASS, "file_uid",
               "c_custkey + 1", "c_custkey + 1", doc="c_mktsegment"),
        _nodes(supplier, "concat('f/n', s_nationkey, ':s', s_suppkey)", "s_name",
               "concat('s', s_suppkey)", S.CONSTRUCTOR, "concat('f/n', s_nationkey)",
               sig="concat(s_name, '()')"),
        _nodes(part, "concat('lib/p', p_partkey)", "p_name", "p_name", S.FUNCTION, "'lib'",
               "p_size", "p_size", doc="concat(p_brand, ' ', p_type)",
               sig="concat(p_name, '(int size)')"),
        _nodes(orders, "order_uid", "concat('order_', o_orderkey)",
               "concat('c', o_custkey, '.o', o_orderkey)", S.FUNCTION, "file_uid",
               doc="o_orderpriority", sig="concat('order(', o_orderstatus, ')')"),
        _nodes(region, "concat('lib/r', r_regionkey)", "r_name", "r_name", S.INTERFACE, "'lib'"),
        _nodes(returned, "concat(order_uid, ':branch@L', l_linenumber)",
               "concat('if_statement@L', l_linenumber)",
               "concat(regexp_replace(order_uid, '^[^:]*:', ''), ':branch@L', l_linenumber)",
               S.BRANCH, "file_uid", "l_linenumber", "l_linenumber",
               doc="concat('Condition: (qty > ', CAST(l_quantity AS INT), ')')"),
        _nodes(orders.where("o_orderstatus = 'F'"), "concat(order_uid, ':return@L1')", "'return'",
               "concat(regexp_replace(order_uid, '^[^:]*:', ''), ':return@L1')",
               S.RETURN, "file_uid"),
    ])


def _edge(source, target, edge_type, filepath, line="NULL", when="true"):
    """An edge of a row as a struct, null unless ``when``."""
    return (f"CASE WHEN {when} THEN named_struct('source_uid', {source}, 'target_uid', {target}, 'edge_type', '{edge_type}', "
            f"'filepath', {filepath}, 'line', CAST({line} AS INT), 'raw_target', {target}) END")


def _edges(df, *edges):
    """Several edges of each row in one pass."""
    return df.select(F.inline(F.filter(F.expr(f"array({', '.join(edges)})"), lambda e: e.isNotNull())))


def table_edges(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    supplier, part = table(spark, folder, "supplier"), table(spark, folder, "part")
    customers, orders = _customers(spark, folder), _orders(spark, folder)
    raw = _lines(spark, folder)
    # a line calls its supplier and its part, and may hold a branch; what makes rows longer comes late
    lines = salted_join(raw, part.selectExpr("p_partkey", "p_name", "true AS made"), "l_partkey", "p_partkey", "left", hot_from=raw)
    lines = _of_orders(spark, folder, lines, raw)
    lines = salted_join(lines, supplier.selectExpr("s_suppkey", "s_name", "true AS sold"), "l_suppkey", "s_suppkey", "left", hot_from=raw)
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    at_home = salted_join(customers, nation.select("n_nationkey", "n_regionkey"), "c_nationkey", "n_nationkey")
    return _union([
        _edges(customers,
               _edge("file_uid", "class_uid", S.CONTAINS, "file_uid"),
               _edge("class_uid", "concat('unresolved:', c_mktsegment)", S.EXTENDS, "file_uid", "1")),
        _edges(supplier, _edge("concat('f/n', s_nationkey)", "concat('f/n', s_nationkey, ':s', s_suppkey)",
                               S.CONTAINS, "concat('f/n', s_nationkey)")),
        _edges(orders,
               _edge("class_uid", "order_uid", S.CONTAINS, "file_uid"),
               _edge("order_uid", "concat('unresolved:', c_name, '.<init>')", S.CALLS, "file_uid", "0", "o_orderpriority = '1-URGENT'"),
               _edge("order_uid", "concat(order_uid, ':return@L1')", S.RETURNS, "file_uid", "1", "o_orderstatus = 'F'")),
        _edges(lines,
               _edge("order_uid", "concat('unresolved:supply.', s_name)", S.CALLS, "file_uid", "l_linenumber", "sold"),
               _edge("order_uid", "concat('unresolved:catalog.', p_name)", S.CALLS, "file_uid", "l_linenumber", "made"),
               _edge("order_uid", "concat(order_uid, ':branch@L', l_linenumber)", S.HAS_BRANCH, "file_uid", "l_linenumber",
                     "l_returnflag = 'R'")),
        _edges(at_home, _edge("class_uid", "concat('lib/r', n_regionkey)", S.IMPLEMENTS, "file_uid", "1")),
        _edges(nations, _edge("concat('f/n', n_nationkey)", "concat('import:', r_name)", S.IMPORTS,
                              "concat('f/n', n_nationkey)", "1")),
    ])
