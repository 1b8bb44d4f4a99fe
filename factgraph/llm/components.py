"""Connected components of an edge table, by rounds of joins."""

from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) and the least node it is connected to.

    Each round links the roots of both ends of an edge, lets every root take
    the least root linked to it, and shortens the paths; edges within a
    component are dropped, so the tables shrink and rounds grow with the
    logarithm of the nodes.  Rounds end in written tables.
    """
    open_edges = scratch.keep(edges.where("a != b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    labels = scratch.keep(open_edges.selectExpr("inline(array(struct(a node), struct(b node)))").distinct()
                          .withColumn("root", F.col("node")), "labels")
    while not open_edges.isEmpty():
        # hook: each larger root takes the least smaller one that it is linked to
        hooks = scratch.keep(open_edges.groupBy("b").agg(F.min("a").alias("a")), "hooks")
        # follow the hooks to their ends; parents are smaller, so there are no rings
        while True:
            up = hooks.select(F.col("b").alias("mid"), F.col("a").alias("top"))
            longer = hooks.join(up, F.col("a") == F.col("mid"), "left")
            longer, seen = scratch.keep_counting(
                longer.select("b", F.coalesce("top", "a").alias("a"), F.col("top").isNotNull().alias("moved")), "hooks",
                moved=F.count_if("moved"))
            hooks = longer.drop("moved")
            if not seen["moved"]:
                break
        labels = scratch.keep(labels.join(hooks, F.col("root") == F.col("b"), "left").select(
            "node", F.coalesce("a", "root").alias("root")), "labels")
        left = hooks.select(F.col("b").alias("from_a"), F.col("a").alias("to_a"))
        right = hooks.select(F.col("b").alias("from_b"), F.col("a").alias("to_b"))
        moved = open_edges.join(left, F.col("a") == F.col("from_a"), "left").join(right, F.col("b") == F.col("from_b"), "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a != b")
        open_edges = scratch.keep(moved.selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    return labels
