"""Heartbeats of a stream from its own writes: metrics observed in the plan, no job of their own."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..registry import EntitySpec
from .landing import BEATS, broken

METRICS = "landed"


def observed(stream: DataFrame, routes: dict[str, EntitySpec]) -> DataFrame:
    """The stream, observing per topic how many of its records keep the contract and the latest time of these.

    Exact where each record is written once, straight from the source (``archive``):
    the metrics are then collected by the tasks that write, and Spark counts each of these
    once, however often it is tried.  Below a shuffle, or under a ``foreachBatch`` that
    reads its batch more than once, records of repeated tasks would count again.
    """
    metrics: list[Column] = []
    for i, (topic, spec) in enumerate(routes.items()):
        good = F.when((F.col("topic") == topic) & F.col("value").isNotNull(), F.size(broken(spec)) == 0)
        metrics += [F.count(F.when(good, 1)).alias(f"n_{i}"), F.max(F.when(good, F.col("ts"))).alias(f"at_{i}")]
    return stream.observe(METRICS, *metrics)


class Heartbeats(StreamingQueryListener):
    """Collects the metrics of ``observed`` streams: a sum and a time per topic, whatever the number of batches.

    A batch counts once per query, also when its progress is told again after a restart.
    ``take`` hands the sums out and starts anew, so they can be appended now and then;
    ``wait`` returns when a finished query's last progress has come in.
    """

    def __init__(self, routes: dict[str, EntitySpec]):
        self.routes, self._lock = routes, threading.Condition()
        self._beats: dict[str, tuple[int, object]] = {}
        self._last: dict[str, int] = {}  # query id -> last batch counted
        self._over: set[str] = set()  # run ids

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.count(str(p.id), p.batchId, p.observedMetrics.get(METRICS))

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._over.add(str(event.runId))
            self._lock.notify_all()

    def count(self, query: str, batch: int, metrics) -> None:
        with self._lock:
            if metrics is None or batch <= self._last.get(query, -1):
                return
            self._last[query] = batch
            for i, topic in enumerate(self.routes):
                if n := metrics[f"n_{i}"]:
                    held, at = self._beats.get(topic, (0, None))
                    self._beats[topic] = (held + n, max((x for x in (at, metrics[f"at_{i}"]) if x is not None), default=None))

    def wait(self, query, seconds: float = 60) -> None:
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.runId) in self._over, seconds):
                raise TimeoutError(f"no end of query {query.runId} was reported")
            self._over.discard(str(query.runId))

    def take(self, spark: SparkSession) -> DataFrame:
        """topic, collection, n, at since the last call: a row per topic."""
        with self._lock:
            rows, self._beats = [(t, self.routes[t].name, n, at) for t, (n, at) in self._beats.items()], {}
        return spark.createDataFrame(rows, BEATS)


def archive(stream: DataFrame, routes: dict[str, EntitySpec], path: str, checkpoint: str):
    """Drain a stream into Parquet partitioned by topic, as it came, for replays; returns the finished query.

    A batch is one job, which writes its records and observes its heartbeats; the file
    sink's log makes a retried batch count once.  Add a ``Heartbeats`` to
    ``spark.streams`` before.
    """
    q = observed(stream, routes).writeStream.format("parquet").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
