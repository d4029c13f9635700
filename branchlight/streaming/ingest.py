"""Streams of content into a tree, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.tree import Tree


def stream_into(tree: Tree, rows: DataFrame, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """rows(ordinal, content_id, text, metadata, embedding), a streaming DataFrame: each micro-batch is one ingest, written once.

    The batch's number is saved in the same commit as the tree it went into, so a batch that is run again, also after a restart with
    the tree's state, is known and left out.
    """

    def take(batch: DataFrame, number: int) -> None:
        tree.ingest(batch, batch=(checkpoint, number))

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
