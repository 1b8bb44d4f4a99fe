"""File changes as a stream, and the same rules as batch operators."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from factgraph import schema as S
from factgraph.functions import names as N

CHANGED, DELETED = "changed", "deleted"


def read_changes(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """A stream of change records that arrive as files in ``path``."""
    return spark.readStream.format(fmt).schema(S.CHANGE).options(**options).load(path)


def expand_moves(changes: DataFrame) -> DataFrame:
    """(ts, kind, path, is_directory): created and modified are changes,
    deleted is a deletion, a move is a deletion of the old path and a change
    of the new one.  Other events are dropped."""
    def one(kind, path):
        return F.struct(F.lit(kind).alias("kind"), F.col(path).alias("path"))

    event = F.col("event_type")
    rows = (
        F.when(event.isin("created", "modified"), F.array(one(CHANGED, "src_path")))
        .when(event == "deleted", F.array(one(DELETED, "src_path")))
        .when(event == "moved", F.array(one(DELETED, "src_path"), one(CHANGED, "dest_path")))
    )
    return changes.select("ts", "is_directory", F.inline(rows))


def relevant_changes(rows: DataFrame) -> DataFrame:
    """Source files outside skipped and hidden parts; no directories."""
    return rows.where(~F.col("is_directory") & N.language_of("path").isNotNull() & ~N.has_skipped_part("path"))


def file_changes(changes: DataFrame) -> DataFrame:
    """(ts, kind, path) of the changes that matter; each side of a move is
    judged on its own."""
    return relevant_changes(expand_moves(changes)).select("ts", "kind", "path")


def _latest_or_deleted(policy: str):
    if policy == "deleted":
        # a path both changed and deleted in one batch counts as deleted
        return F.when(F.bool_or(F.col("kind") == DELETED), DELETED).otherwise(CHANGED)
    return F.max_by("kind", F.struct("ts", "kind"))


def collapse(rows: DataFrame, policy: str = "deleted") -> DataFrame:
    """(path, kind), each path once.  ``policy="last"`` keeps the latest kind."""
    return rows.groupBy("path").agg(_latest_or_deleted(policy).alias("kind"))


def coalesce_changes(rows: DataFrame, every: str = "500 milliseconds", gap: str | None = None,
                     policy: str = "deleted", late: str | None = None) -> DataFrame:
    """(batch_start, path, kind): each path once per time window, or once per
    burst of its changes when ``gap`` is given.

    Works on a batch and on a stream; ``late`` sets the watermark a stream
    needs to forget old windows.  In append mode a stream emits a window when
    the watermark has passed it, so the last windows wait for later events.
    """
    if late is not None:
        rows = rows.withWatermark("ts", late)
    window = F.session_window("ts", gap) if gap else F.window("ts", every)
    out = rows.groupBy(window.alias("w"), "path").agg(_latest_or_deleted(policy).alias("kind"))
    return out.select(F.col("w.start").alias("batch_start"), "path", "kind")
