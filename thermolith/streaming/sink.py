"""Streams into the store: each micro-batch once, and the life of a run by that of its stream.

A stream belongs to a run. Its batches go through ``foreachBatch`` into :meth:`RunStore.store_batch`, which keeps a ledger of batch
numbers, so a batch that Spark delivers again after a failure is stored once. When the stream ends by itself, its run is completed
with the metrics of what it stored; when it dies, its run is failed with the message. Both are rows of
the store's run table, so any process sees them. A driver that dies takes the stream with it and leaves the run running: started
again with the same checkpoint, the stream goes on where it was.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..errors import RunStateError
from ..operators.store import RunStore

#: (metric, value) of a run from its stored rows.
Metrics = Callable[[DataFrame], DataFrame]


def no_metrics(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "metric string, value double")


class Lifecycle(StreamingQueryListener):
    """Marks the runs of streams as completed or failed."""

    def __init__(self, store: RunStore, metrics: Metrics = no_metrics):
        self.store, self.metrics = store, metrics
        self._runs: dict[str, int] = {}
        self._by_name: dict[str, int] = {}
        self._ended: dict[int, threading.Event] = {}
        self.errors: dict[int, Exception] = {}

    def expect(self, name: str, run_id: int) -> None:
        """The stream of this name, about to be started, is that of a run."""
        self._by_name[name] = run_id
        self._ended[run_id] = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name in self._by_name:
            self._runs[str(event.id)] = self._by_name[event.name]

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run_id = self._runs.pop(str(event.id), None)
        if run_id is None:
            return
        try:
            if event.exception is None:
                rows = self.store.streamed(run_id) if self.store.exists("stream_steps") else None
                self.store.finish_run(run_id, self.metrics(rows) if rows is not None else self.store.metrics().where("false").select("metric", "value"))
            else:
                self.store.fail_run(run_id, str(event.exception))
        except RunStateError:  # somebody else has ended the run
            pass
        except Exception as error:  # a listener's errors are only logged by Spark
            self.errors[run_id] = error
        finally:
            self._ended[run_id].set()

    def wait(self, run_id: int, seconds: float = 300) -> None:
        """Until the run's end is in the store."""
        if not self._ended[run_id].wait(seconds):
            raise TimeoutError(f"the stream of run {run_id} has not ended")
        if run_id in self.errors:
            raise self.errors[run_id]


def start(stream: DataFrame, store: RunStore, run_id: int, checkpoint: str, life: Lifecycle | None = None, **options) -> StreamingQuery:
    """Starts storing a stream for a run that is running. ``options``: those of the writer's trigger (``availableNow=True``)."""
    name = f"run-{run_id}"
    if life is not None:
        life.expect(name, run_id)
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: store.store_batch(run_id, number, batch) and None)
    return (writer.trigger(**options) if options else writer).start()
