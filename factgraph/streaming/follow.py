"""Keeping a stored graph current from a stream of file changes.

The graph is the one of ``operators.live``: a base and the changes since.  The
commit of a change names the streaming query (which lives as long as its
checkpoint) and its batch: a micro-batch that is run again after a failure
either finds its commit and does nothing, or applies its change anew.  A query
with a new checkpoint counts its batches from 0 again, and all of them are
applied.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.functions.storage import Scratch
from factgraph.operators import live
from factgraph.operators.incremental import relativise
from factgraph.operators.live import latest_version, read as read_snapshot, retain  # noqa: F401
from factgraph.sources.tree import as_files, read_contents
from factgraph.streaming.changes import CHANGED, DELETED, collapse, file_changes

# A base is written anew once so many changes lie on it.
COMPACT_AFTER = 100


def tree_reader(root: str) -> Callable[[DataFrame], DataFrame]:
    return lambda paths: as_files(read_contents(paths, root))


def apply_batch(batch: DataFrame, query: str, batch_id: int, folder: str, root: str, read_files=None,
                policy: str = "deleted", compact_after: int = COMPACT_AFTER) -> None:
    """Apply one batch of change events to the latest version, once.

    ``read_files`` turns a table of paths into a files table, leaving out paths
    that are gone.
    """
    spark = batch.sparkSession
    if live.is_applied(spark, folder, query, batch_id):
        return
    rows = collapse(file_changes(batch), policy).withColumnRenamed("path", "filepath")
    scratch = Scratch(spark, "batch")
    # every pass below must see one and the same batch
    rows = scratch.keep(relativise(rows, root), "changes")
    if not rows.isEmpty():
        changed = rows.where(F.col("kind") == CHANGED).select("filepath")
        deleted = rows.where(F.col("kind") == DELETED).select("filepath")
        files = (read_files or tree_reader(root))(changed)
        live.apply(spark, folder, changed, deleted, files, query=query, batch=batch_id)
        if len(live.state(spark, folder).changes) >= compact_after:
            live.compact(spark, folder)
    scratch.drop_all_but()


def maintain(stream: DataFrame, folder: str, root: str, read_files=None, every: str = "500 milliseconds",
             policy: str = "deleted", checkpoint: str | None = None, once: bool = False,
             compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Start the query that applies every micro-batch to the latest version.

    The trigger interval is the time changes are gathered; an interval without
    changes does nothing.  ``once`` handles what is there and stops.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        apply_batch(batch, query, batch_id, folder, root, read_files, policy, compact_after)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def bootstrap_and_follow(spark: SparkSession, stream: DataFrame, folder: str, root: str, **options) -> StreamingQuery:
    """Build the graph of the whole tree once, unless a version is there
    already, then follow the changes."""
    from factgraph.plans.build import build_graph
    if latest_version(spark, folder) is None:
        live.create(build_graph(spark, root), folder)
    return maintain(stream, folder, root, **options)
