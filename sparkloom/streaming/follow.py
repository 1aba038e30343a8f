"""Streams that keep the store's tables in step: changed files, and the states of task chains.

Every batch is one commit of the store, which carries the batch's number under
the stream's own id (from its checkpoint). A batch that was committed before the
stream broke off is recognised by that and left out, so each counts once; a
stream with a new checkpoint starts from the tables as they are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schemas
from ..api import Engine
from ..sources.store import Store


def _once(store: Store, checkpoint: str, apply: Callable[[DataFrame, dict[str, int]], None]) -> Callable[[DataFrame, int], None]:
    """Hands on the batches that no commit holds yet, with the mark that their commit is to carry."""

    def run(batch: DataFrame, number: int) -> None:
        mark = "stream:" + json.loads(store._text(f"{checkpoint.rstrip('/')}/metadata"))["id"]
        held = store.mark(mark)
        if held is None or held < number:
            apply(batch, {mark: number})

    return run


def _started(events: DataFrame, run, checkpoint: str, wait: bool) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if wait else writer).start()
    if wait:
        query.awaitTermination()
    return query


def follow_changes(engine: Engine, root: str, feed: str, checkpoint: str, files: int = 100, wait: bool = True) -> StreamingQuery:
    """Refreshes the index of the tree at ``root`` from ``feed``, a folder of JSON lines with a ``path`` each, relative to the tree.

    A path means that its file was made, changed or removed. ``files`` of the
    feed make a batch. With ``wait`` the stream ends when the feed is read.
    """
    paths = engine.spark.readStream.schema("path string").option("maxFilesPerTrigger", files).json(feed)
    return _started(paths, _once(engine.store, checkpoint, lambda batch, mark: engine.refresh(root, batch, mark)), checkpoint, wait)


def follow_chains(engine: Engine, events: str, checkpoint: str, protocol: str = "develop", files: int = 100, wait: bool = True) -> StreamingQuery:
    """Writes the state of task chains through to ``task_chains`` from ``events``, a folder of Parquet files of events.

    The table is the stream's state: a batch reads the buckets of its tasks,
    folds its events over what they hold and writes them back. Events go by id;
    those at or below a task's last one are known.
    """
    rows = engine.spark.readStream.schema(schemas.CHAIN_EVENTS).option("maxFilesPerTrigger", files).parquet(events)
    return _started(rows, _once(engine.store, checkpoint, lambda batch, mark: engine.advance_chains(batch, protocol, mark)), checkpoint, wait)


class Reporter(StreamingQueryListener):
    """Keeps the last progress of a session's streams in a small file of the store."""

    def __init__(self, store: Store, name: str = "_streams.json"):
        self.store, self.name, self.rows = store, name, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.store.put_text(self.name, json.dumps({"timestamp": int(time.time()), "processed": self.rows, "batch": p.batchId, "stream": str(p.id)}))

    def onQueryTerminated(self, event) -> None:
        pass
