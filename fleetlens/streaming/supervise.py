"""Supervision of streams: what failed is counted and started again with growing pauses, each stream by itself.

A StreamingQueryListener hears of ends and of batches. Spark calls it on a thread of its own, where no query may be
started, so it notes down what happened, and `tick` (or `run`, which ticks) starts what is due.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds before the first new start, doubled with each failure in a row up to the most.
FIRST_PAUSE, LONGEST_PAUSE = 1.0, 300.0


@dataclass
class Watched:
    """One stream: how it is started, and how it has fared."""

    name: str
    start: Callable[[], StreamingQuery]
    query: StreamingQuery | None = None
    run_id: str | None = None
    consecutive_failures: int = 0
    failures: int = 0
    starts: int = 0
    batches: int = 0
    last_error: str | None = None
    due: float | None = None
    done: bool = False


@dataclass
class Chore:
    """Work that is done again and again beside the streams, such as retention and compaction."""

    work: Callable[[], object]
    every: float
    due: float
    runs: int = 0
    failures: int = 0
    last_error: str | None = None


class Supervisor(StreamingQueryListener):
    """Keeps streams running. `clock` tells seconds; tests have one of their own."""

    def __init__(self, spark: SparkSession, first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE, clock: Callable[[], float] = time.monotonic) -> None:
        super().__init__()
        self.spark, self.first, self.longest, self.clock = spark, first, longest, clock
        self.lock, self.streams, self.chores = threading.RLock(), {}, {}
        spark.streams.addListener(self)

    def add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        """A stream and how it is started; a first start that fails counts like any other failure."""
        with self.lock:
            self.streams[name] = Watched(name, start, due=self.clock())
        self.tick()

    def add_all(self, starts: dict[str, Callable[[], StreamingQuery]]) -> None:
        for name, start in starts.items():
            self.add(name, start)

    def schedule(self, name: str, every: float, work: Callable[[], object]) -> None:
        """Work to be done every so many seconds, first after that time; one that fails is tried again at the next time."""
        self.chores[name] = Chore(work, every, self.clock() + every)

    def _work(self) -> None:
        for c in list(self.chores.values()):
            if self.clock() >= c.due:
                c.due, c.runs = self.clock() + c.every, c.runs + 1
                try:
                    c.work()
                except Exception as e:  # streams go on whatever becomes of it
                    c.failures, c.last_error = c.failures + 1, str(e)

    def _failed(self, w: Watched, error: str) -> None:
        w.failures += 1
        w.consecutive_failures += 1
        w.last_error, w.query = error, None
        w.due = self.clock() + min(self.first * 2 ** (w.consecutive_failures - 1), self.longest)

    def tick(self) -> None:
        """Starts every stream whose time has come, notes those that ended before the listener could tell, and does chores."""
        self._work()
        with self.lock:
            for w in self.streams.values():
                if w.query is not None and not w.query.isActive and not w.done:
                    self._ended(w, str(w.query.exception()) if w.query.exception() else None)
                if w.done or w.due is None or self.clock() < w.due:
                    continue
                w.due = None
                w.starts += 1
                try:
                    w.query = w.start()
                    w.run_id = str(w.query.runId)
                except Exception as e:  # whatever keeps a stream from starting is tried again
                    self._failed(w, str(e))

    def _ended(self, w: Watched, error: str | None) -> None:
        if error is None:
            w.done, w.query = True, None
        else:
            self._failed(w, error)

    def run(self, seconds: float, every: float = 0.2) -> None:
        """Ticks until the time is over or every stream has ended without failure."""
        end = time.monotonic() + seconds
        while time.monotonic() < end and not all(w.done for w in self.streams.values()):
            self.tick()
            time.sleep(every)

    def stop(self) -> None:
        """Stops the streams, and with them the supervision."""
        self.spark.streams.removeListener(self)
        with self.lock:
            for w in self.streams.values():
                w.done = True
                if w.query is not None:
                    w.query.stop()

    def consecutive_insert_failures(self) -> int:
        """Of the stream that fares worst."""
        with self.lock:
            return max((w.consecutive_failures for w in self.streams.values()), default=0)

    def figures(self) -> DataFrame:
        """One row for each stream: stream, starts, batches, failures, consecutive_failures, last_error and due_in seconds."""
        with self.lock:
            rows = [(w.name, w.starts, w.batches, w.failures, w.consecutive_failures, w.last_error, None if w.due is None else max(0.0, w.due - self.clock())) for w in self.streams.values()]
        return self.spark.createDataFrame(rows, "stream string, starts int, batches long, failures int, consecutive_failures int, last_error string, due_in double")

    def in_agent_block(self, agent: DataFrame) -> DataFrame:
        """The agent's block of a payload with the failures in a row as they are now."""
        return agent.withColumn("consecutive_insert_failures", F.lit(self.consecutive_insert_failures()))

    # What Spark tells

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            for w in self.streams.values():
                if w.run_id == str(event.progress.runId):
                    w.batches += 1
                    w.consecutive_failures = 0  # a batch was written

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            for w in self.streams.values():
                if w.run_id == str(event.runId) and w.query is not None and not w.done:
                    self._ended(w, event.exception)
