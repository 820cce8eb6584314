"""Segment ingest from a stream: a segment per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarrydex import sources
from quarrydex.operators.index import DocumentIndex


def segment_writer(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch of documents as the segment of its batch id.

    ``options`` are those of DocumentIndex. A batch that is played again overwrites its own segment, so ingest is exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by several jobs; a lost block is read from the source again
        try:
            DocumentIndex(batch, segment=batch_id, **options).write(path, "overwrite")
        finally:
            batch.unpersist()

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, index: dict | None = None, **trigger):
    """Starts the ingest of a stream of documents; the running query. ``index``: options of DocumentIndex."""
    return stream.writeStream.foreachBatch(segment_writer(path, **(index or {}))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["ingest", "segment_writer", "sources"]
