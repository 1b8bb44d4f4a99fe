"""Linking call texts to the entities they name."""

from pyspark.sql import DataFrame, functions as F

from factgraph import schema as S
from factgraph.functions.names import is_unresolved, lookup_name
from factgraph.functions.skew import FILTER_KEYS, KeyFilter, is_large, salted_join
from factgraph.functions.storage import Scratch

CALLABLE = (S.FUNCTION, S.CONSTRUCTOR)
# So many answers may be sent to every task, which spares the shuffle of the edges.
FEW_ANSWERS = 1_000_000


def name_index(nodes: DataFrame) -> DataFrame:
    """(name, n, uid): how many callables carry a name, and one of them.

    Rows are counted, not distinct uids: two overloads that share a uid make
    the name ambiguous.
    """
    return (
        nodes.where(F.col("node_type").isin(*CALLABLE))
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
    )


def _raw(edges: DataFrame, mode: str):
    if mode == "sticky" or "raw_target" not in edges.columns:
        return F.col("target_uid")
    return F.coalesce("raw_target", "target_uid")


def _looked_up(todo: DataFrame, unique: DataFrame, hot_rows: int | None) -> DataFrame:
    """``todo`` with ``__uid``, the callable its ``__name`` stands for, or null."""
    if hot_rows is not None or not is_large(todo):
        return salted_join(todo, unique, "__name", "name", "left", hot_rows)
    asked = todo.select(F.col("__name").alias("name")).distinct()
    answers, n = Scratch(todo.sparkSession, "answers", packed=True).keep_counting(
        unique.join(asked, "name", "left_semi"), "answers", n=F.count(F.lit(1)))
    if n["n"] <= FEW_ANSWERS:
        return todo.join(F.broadcast(answers.withColumnRenamed("name", "__asked")), F.col("__name") == F.col("__asked"), "left").drop("__asked")
    if n["n"] > FILTER_KEYS:
        return salted_join(todo, answers, "__name", "name", "left")
    marked = KeyFilter(answers, "name", n["n"]).mark(todo, "__name", "__known")
    linked = salted_join(marked.where("__known").drop("__known"), answers, "__name", "name", "left", hot_from=todo)
    return linked.unionByName(marked.where("NOT __known").drop("__known").withColumn("__uid", F.lit(None).cast("string")))


def resolve_calls(nodes: DataFrame, edges: DataFrame, edge_types=None, mode: str = "fresh",
                  hot_rows: int | None = None) -> DataFrame:
    """Edges with every uniquely named target replaced by its uid.

    A target is linked when exactly one callable has its simple name; an
    ambiguous or unknown name stays as it is.  ``fresh`` starts from the text
    first seen, so a link goes away when its name has become ambiguous;
    ``sticky`` only looks at targets that are unresolved now.  By default all
    kinds of edges are tried; ``edge_types`` narrows that.

    Edges without a name to look up are never shuffled.  Of many edges, those
    whose name has no answer aren't either, and none where answers are few.
    """
    raw = _raw(edges, mode)
    wanted = is_unresolved(raw)
    if edge_types:
        wanted = wanted & F.col("edge_type").isin(*edge_types)
    others = [c for c in S.EDGE_COLS if c != "target_uid" and c in edges.columns]

    todo = edges.where(wanted).select(*others, raw.alias("__raw"), lookup_name(raw).alias("__name"))
    unique = name_index(nodes).where("n = 1").select("name", F.col("uid").alias("__uid"))
    linked = _looked_up(todo, unique, hot_rows)
    linked = linked.withColumn("target_uid", F.coalesce("__uid", "__raw"))
    rest = edges.where(~wanted)
    cols = edges.columns
    return linked.select(*cols).unionByName(rest.select(*cols))


def unresolved_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_unresolved("target_uid"))


def resolution_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: resolved, ambiguous, missing, total.

    Edges are counted per name before the join, so a frequent name costs one
    row.
    """
    per_name = edges.groupBy(lookup_name(_raw(edges, "fresh")).alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    joined = per_name.join(name_index(nodes).select("name", "n"), "name", "left")
    asked = F.col("name").isNotNull()

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("uses"))), F.lit(0)).cast("long")

    return joined.agg(
        total(asked & (F.col("n") == 1)).alias("resolved"),
        total(asked & (F.col("n") > 1)).alias("ambiguous"),
        total(asked & F.col("n").isNull()).alias("missing"),
        total(F.lit(True)).alias("total"),
    )
