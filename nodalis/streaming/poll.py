"""Polling of many sources, each a streaming query of its own.

Every source has its own checkpoint and trigger, so one that fails leaves the others alone. A listener
hears of batches and of queries that end; its calls only go to a queue, and the loop in ``run`` restarts
what failed after a pause that doubles with every failure in a row and starts anew after a batch that
went through. A restarted query goes on from its checkpoint; merges repeat without effect.
"""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from nodalis.streaming import ingest


@dataclass(frozen=True)
class Source:
    """A stream that is merged into the keyed table of ``folder``. ``open`` makes the stream anew for every start."""

    name: str
    open: Callable[[SparkSession], DataFrame]
    folder: str
    schema: str
    merge: ingest.Merge
    keys: tuple[str, ...]
    every: str | None = "15 minutes"  # None: what is there, then end

    def start(self, spark: SparkSession) -> StreamingQuery:
        trigger = {"processingTime": self.every} if self.every else {"availableNow": True}
        merged = ingest.merge_into(self.folder, self.schema, self.merge, list(self.keys))
        writer = self.open(spark).writeStream.queryName(self.name).foreachBatch(merged)
        return writer.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()


class _Listener(StreamingQueryListener):
    def __init__(self, heard: queue.Queue):
        self.heard = heard

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.heard.put(("batch", str(event.progress.runId), None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.heard.put(("end", str(event.runId), event.exception))


@dataclass
class Poller:
    """Runs sources until they end by themselves, or ``stop`` is called, or ``seconds`` are over.

    ``failures``: (source, failures in a row, message) of every failure so far."""

    spark: SparkSession
    sources: Iterable[Source]
    pause: float = 5.0
    longest_pause: float = 900.0
    failures: list[tuple[str, int, str]] = field(default_factory=list)
    stopped: bool = False

    def stop(self) -> None:
        self.stopped = True

    def run(self, seconds: float = float("inf")) -> None:
        heard: queue.Queue = queue.Queue()
        listener, until = _Listener(heard), time.monotonic() + seconds
        sources = {s.name: s for s in self.sources}
        due, row = dict.fromkeys(sources, 0.0), dict.fromkeys(sources, 0)
        running: dict[str, tuple[str, StreamingQuery]] = {}

        def failed(name: str, message: str) -> None:
            row[name] += 1
            self.failures.append((name, row[name], message))
            due[name] = time.monotonic() + min(self.longest_pause, self.pause * 2 ** (row[name] - 1))

        self.spark.streams.addListener(listener)
        try:
            while (due or running) and not self.stopped and time.monotonic() < until:
                for name in [n for n, at in due.items() if at <= time.monotonic()]:
                    del due[name]
                    try:
                        started = sources[name].start(self.spark)
                        running[str(started.runId)] = name, started
                    except Exception as e:  # a source that cannot be opened is as good as one that failed
                        failed(name, str(e))
                try:
                    what, run, message = heard.get(timeout=min([0.2, *(max(0.0, at - time.monotonic()) for at in due.values())]))
                except queue.Empty:
                    continue
                if run not in running:
                    continue
                if what == "batch":
                    row[running[run][0]] = 0
                else:
                    name, _ = running.pop(run)
                    if message:
                        failed(name, message)
        finally:
            self.spark.streams.removeListener(listener)
            for _, started in running.values():
                started.stop()
