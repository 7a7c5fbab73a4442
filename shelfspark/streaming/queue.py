"""The index queue as keyed state of a stream: one waiting job a path.

``transformWithState`` keeps the waiting job of each path in the state store.
An upsert replaces the job of its path and adds its thumbnail wish to that of
the upsert it replaces; a removal replaces it; ``done`` (of this seq or a later
one) takes it out, and the store forgets the path.  A batch reads and writes
the states of its own paths only, whatever waits besides.  A query that is
started again with its checkpoint goes on where it stopped.

Events of a path may come in any order within a batch, and in order of seq
over batches: what is older than the waiting job is left out.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from shelfspark.sources.work import ship

STATE = "kind string, thumb boolean, seq long"
EMITTED = "path string, kind string, thumb boolean, seq long, state string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(job: tuple | None, event: tuple) -> tuple | None:
    """The waiting job (kind, thumb, seq) after an event (kind, thumb, seq); None: nothing waits."""
    kind, thumb, seq = event
    if job is not None and seq < job[2]:
        return job
    if kind == "done":
        return None
    if kind == "upsert":
        return kind, bool(thumb) or (job is not None and job[0] == "upsert" and job[1]), seq
    return kind, False, seq


class _Jobs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = job = tuple(self.job.get()) if self.job.exists() else None
        last = None
        for event in sorted(((r.kind, r.thumb, r.seq) for r in rows), key=lambda e: (e[2], e[0] == "done")):
            was, job = job, after(job, event)
            if was is not None and job is None:
                last = was
        if job is not None:
            if job != had:
                self.job.update(job)
                yield Row(path=key[0], kind=job[0], thumb=job[1], seq=job[2], state="waiting")
        elif last is not None:
            self.job.clear()
            yield Row(path=key[0], kind=last[0], thumb=last[1], seq=last[2], state="done")

    def close(self) -> None:
        pass


def job_changes(stream: DataFrame) -> DataFrame:
    """(path, kind, thumb, seq, state): jobs of a stream(path, kind, thumb, seq) that are now waiting or done."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    out = stream.where("path is not null and seq is not null").groupBy("path").transformWithState(_Jobs(), EMITTED, "update", "none")
    done = F.col("state") == "done"
    return out.observe("queue", F.count_if(done).alias("done"), F.max_by("path", F.when(done, F.col("seq"))).alias("last_path"))


def keyed_queue(stream: DataFrame, sink: str, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Write the changes of each micro-batch to sink/batch=n; a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    writer = job_changes(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(**(trigger or {"availableNow": True})).start()


def waiting_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, kind, thumb, seq) of the jobs that wait, from the state of the last finished batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    return rows.select("key.path", "value.kind", "value.thumb", "value.seq")


class QueueProgress(StreamingQueryListener):
    """pending, processed, running and last_path of a named queue, from what its batches report as they run.

    pending is the number of paths in the state store, so that it is right
    after a restart; processed counts jobs done since the listener was added.
    """

    def __init__(self, name: str):
        self.name, self._lock = name, threading.Lock()
        self.pending, self.processed, self.running, self.last_path, self._run, self._seen = 0, 0, False, None, None, -1

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            with self._lock:
                self._run, self._seen, self.running = event.runId, -1, True

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        with self._lock:
            if p.stateOperators:
                self.pending = p.stateOperators[0].numRowsTotal
            told = p.observedMetrics.get("queue")
            if told is not None and p.batchId > self._seen:
                self._seen = p.batchId
                self.processed += told["done"]
                self.last_path = told["last_path"] or self.last_path

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            if event.runId == self._run:
                self.running = False

    def snapshot(self) -> dict:
        with self._lock:
            return {"pending": self.pending, "processed": self.processed, "running": self.running, "last_path": self.last_path}


def stamp_scan(spark: SparkSession, folder: str, at: int) -> None:
    """Note that a library was scanned at a time (seconds); stamps are added, never rewritten."""
    spark.createDataFrame([(int(at),)], "at long").coalesce(1).write.mode("append").parquet(folder)


def last_scan(spark: SparkSession, folder: str) -> int:
    """The latest stamp, 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema("at long").parquet(folder).agg(F.max("at")).first()[0] or 0
