"""What a running stream reports after each micro-batch, kept as a table: counters, offsets and what is left.

Counters are observed while the records pass, so they cost no job; Spark hands them to a
listener with the offsets that the batch reached.  The listener writes one row per batch to the
shared folder, so the table outlives the stream and goes on when the stream is started again.
A batch that is repeated replaces its row.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.sources.split_source import BACKLOG_UNKNOWN, SplitSource

ROW = "n_records bigint, counters map<string, bigint>, offsets array<string>, backlog_bytes bigint"
PATIENCE = 120.0


class BatchLog(StreamingQueryListener):
    """Log the batches of one stream while it runs::

        with BatchLog(spark, folder, {"n_terminal": F.count_if("terminal")}) as log:
            log.observed(stream).writeStream.queryName(log.name)...start().awaitTermination()

    ``counters`` are aggregates over the records of a batch.  With the ``source`` that is read, the bytes
    it has left at the offsets reached are logged too: NULL without one, -1 if a split doesn't know.
    Leaving the block waits until the stream's last report has come in, and raises what went wrong in writing one.
    """

    def __init__(self, spark: SparkSession, folder: str, counters: dict[str, Column], source: SplitSource | None = None):
        self.spark, self.folder, self.counters, self.source = spark, folder, counters, source
        self.name = f"logged-{uuid.uuid4().hex}"
        self._run_id, self._ended, self._error = None, threading.Event(), None

    def observed(self, stream: DataFrame) -> DataFrame:
        if not self.counters:
            return stream
        return stream.observe(self.name, *[c.cast("long").alias(name) for name, c in self.counters.items()])

    def __enter__(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            late = self._run_id is not None and error is None and not self._ended.wait(PATIENCE)
        finally:
            self.spark.streams.removeListener(self)
        if error is None and self._error is not None:
            raise self._error
        if late:
            raise TimeoutError("the stream's last report is missing; it must have ended inside the block")

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._run_id = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.runId != self._run_id:
            return
        try:
            self._write(event.progress)
        except Exception as error:  # raised when the block is left; a listener's own errors are only logged
            self._error = self._error or error

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run_id:
            self._ended.set()

    def _write(self, progress) -> None:
        seen = progress.observedMetrics.get(self.name)
        counters = {name: seen[name] for name in self.counters} if seen is not None else {}
        offsets = [source.endOffset for source in progress.sources]
        row = (progress.numInputRows, counters, offsets, self._backlog(offsets))
        frame = self.spark.createDataFrame([row], ROW).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.folder}/batch={progress.batchId}")

    def _backlog(self, offsets: list[str]) -> int | None:
        if self.source is None:
            return None
        reached = json.loads(offsets[0])
        left = [self.source.backlog_bytes(split, offset) for split, offset in reached.items()]
        return BACKLOG_UNKNOWN if BACKLOG_UNKNOWN in left else sum(left)


def batches(spark: SparkSession, folder: str, counters: list[str], total: dict[str, int] | None = None) -> DataFrame:
    """One row per logged batch: ``batch``, ``n_records``, the counters, ``offsets`` and ``backlog_bytes``.

    For each counter in ``total`` there is also ``left_<counter>``: the total without what all batches so far
    have counted.  That needs every batch, so one that is missing (the driver was lost before
    its report was written) is an error and not a wrong sum.
    """
    log = spark.read.schema(f"{ROW}, batch bigint").parquet(folder)
    rows = log.select("batch", "n_records", *[F.col("counters")[c].alias(c) for c in counters], "offsets", "backlog_bytes")
    if not total:
        return rows
    # One row per micro-batch, so one task orders them.
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.raise_error(F.concat(F.lit("the log holds no report of a batch before "), F.col("batch"))).cast("long")
    known = F.when(F.count("*").over(so_far) == F.col("batch") + 1, F.lit(0)).otherwise(lost)
    left = [(F.lit(n) - F.sum(c).over(so_far) + known).cast("long").alias(f"left_{c}") for c, n in total.items()]
    return rows.select("*", *left)
