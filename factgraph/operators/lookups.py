"""Questions about symbols: who calls it, what does it call, what is around it.

Each operator answers for one name, or for all symbols at once when no name is
given.  Answers are rows, never arrays, so a symbol with a billion callers is
no heavier for one task than any other.  For one name, its uids are looked up
first and sent into the scan of the edges, and so are the uids around it, as
long as they are few.
"""

from pyspark.sql import DataFrame, functions as F

from factgraph import schema as S
from factgraph.functions.names import shorten
from factgraph.functions.skew import FEW, few_join, salted_join, without_strangers


def nodes_of(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def find_symbol(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Defined entities with exactly this name."""
    found = nodes.where((F.col("node_type") != S.UNRESOLVED) & F.col("name").isNotNull())
    return found.where(F.col("name") == name) if name is not None else found


def present(nodes: DataFrame) -> DataFrame:
    """Display form: missing signature as N/A, docstring cut for the screen."""
    return nodes.select(
        "uid", F.col("node_type").alias("type"), "name", "filepath",
        F.coalesce("signature", F.lit("N/A")).alias("signature"),
        shorten("docstring").alias("docstring"))


def page(df: DataFrame, order_by: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a list, under a total order given by the caller."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def page_after(df: DataFrame, order_by: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The page behind the row with the values ``after``, from the start if None.

    ``order_by`` names columns without nulls.  The place is a filter, so a page
    far behind costs no more than the first.
    """
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for column, value in zip(order_by, after):
            behind = behind | same & (F.col(column) > F.lit(value))
            same = same & (F.col(column) == F.lit(value))
        df = df.where(behind)
    return df.orderBy(*order_by).limit(limit)


def _calls(edges):
    return edges.where(F.col("edge_type") == S.CALLS).select("source_uid", "target_uid")


def _around(many, few, many_key, few_key, name, hot_rows, hot_from=None, few_left=False, strangers=False):
    """Join that starts from the few rows of a name where there is one;
    ``few_left`` tells that ``few`` is the side that may be skewed, and
    ``strangers`` that many rows of ``many`` may have no match."""
    found = few_join(many, few, many_key, few_key) if name is not None and hot_rows is None else None
    if found is not None:
        return found
    if few_left:
        return salted_join(few, many, few_key, many_key, "inner", hot_rows, hot_from)
    if strangers and hot_rows is None:
        many, hot_from = without_strangers(many, few, few_key, many_key), many if hot_from is None else hot_from
    return salted_join(many, few, many_key, few_key, "inner", hot_rows, hot_from)


def get_callers(nodes: DataFrame, edges: DataFrame, name: str | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """(symbol, type, name, filepath): one row per call relation into it."""
    targets = nodes.where(F.col("name").isNotNull() if name is None else F.col("name") == name)
    targets = targets.select(F.col("uid").alias("t_uid"), F.col("name").alias("symbol"))
    callers = nodes.select(F.col("uid").alias("c_uid"), F.col("node_type").alias("type"), "name", "filepath")
    calls = _calls(edges)
    hits = _around(calls, targets, "target_uid", "t_uid", name, hot_rows, strangers=True)
    rows = _around(callers, hits, "c_uid", "source_uid", name, hot_rows, calls, few_left=True)
    return rows.select("symbol", "type", "name", "filepath")


def get_callees(nodes: DataFrame, edges: DataFrame, name: str | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """(symbol, type, name): one row per call relation out of it.  Placeholders
    are part of the answer, with a null name."""
    sources = find_symbol(nodes, name).select(F.col("uid").alias("s_uid"), F.col("name").alias("symbol"))
    callees = nodes.select(F.col("uid").alias("c_uid"), F.col("node_type").alias("type"), "name")
    calls = _calls(edges)
    hits = _around(calls, sources, "source_uid", "s_uid", name, hot_rows)
    rows = _around(callees, hits, "c_uid", "target_uid", name, hot_rows, calls, few_left=True)
    return rows.select("symbol", "type", "name")


def get_code_context(nodes: DataFrame, edges: DataFrame, name: str | None = None,
                     first_only: bool = False, hot_rows: int | None = None) -> DataFrame:
    """(symbol, type, filepath, signature, role, name), distinct.

    ``role`` is center, caller, callee or branch.  Every center has its own
    row, so a symbol without neighbours is still found.  Entities that agree
    in name, type, file and signature form one context.  ``first_only`` keeps
    the first context by (filepath, uid).
    """
    centers = find_symbol(nodes, name).select(
        F.col("uid").alias("k_uid"), F.col("name").alias("symbol"), F.col("node_type").alias("type"),
        "filepath", "signature")
    if first_only:
        best = centers.agg(F.min(F.struct("filepath", "k_uid", "type", "signature")).alias("b")).select("b.*")
        centers = centers.join(
            F.broadcast(best.select(*[F.col(c).alias("b_" + c) for c in ("filepath", "type", "signature")])),
            F.col("filepath").eqNullSafe(F.col("b_filepath")) & (F.col("type") == F.col("b_type"))
            & F.col("signature").eqNullSafe(F.col("b_signature")), "left_semi")

    s, t = F.col("source_uid"), F.col("target_uid")
    is_call = F.col("edge_type") == S.CALLS

    def link(center, other, role):
        return F.struct(center.alias("center"), other.alias("other"), F.lit(role).alias("role"))

    if name is not None and hot_rows is None:
        # both ends at once: an edge may be around one center and lead to another
        uids = centers.select("k_uid").limit(FEW + 1).toArrow()["k_uid"].to_pylist()
        if len(uids) <= FEW:
            edges = edges.where(s.isin(uids) | t.isin(uids))
    links = (
        edges.where(F.col("edge_type").isin(S.CALLS, S.HAS_BRANCH))
        .select(F.inline(F.when(is_call, F.array(link(t, s, "caller"), link(s, t, "callee")))
                         .otherwise(F.array(link(s, t, "branch")))))
    )
    names = nodes.where(F.col("name") != "").select(F.col("uid").alias("o_uid"), "name")
    around = _around(links, centers, "center", "k_uid", name, hot_rows, strangers=True)
    around = _around(names, around, "o_uid", "other", name, hot_rows, links, few_left=True)
    cols = ["symbol", "type", "filepath", "signature", "role", "name"]
    itself = centers.select("symbol", "type", "filepath", "signature",
                            F.lit("center").alias("role"), F.col("symbol").alias("name"))
    return around.select(*cols).unionByName(itself).distinct()


def context_counts(context: DataFrame) -> DataFrame:
    """Neighbour counts per context."""
    def n(role):
        return F.count_if(F.col("role") == role)

    return context.groupBy("symbol", "type", "filepath", "signature").agg(
        n("caller").alias("callers"), n("callee").alias("callees"), n("branch").alias("branches"))
