"""A live watch: one poll of all active seeds per tick, kept in tables.

Under ``root``, one folder per poll number:

* ``raw``     what the poll answered, written before anything is derived from it
* ``asked``   the seeds that were due, if seeds have their own pace
* ``ledger``  one row once ``raw`` is complete
* ``fresh``   the outputs that were new: the watch result
* ``memory``  with a bounded memory: the keys remembered after the poll; with an unbounded one they
  are the state of a deduplication under ``seen``, so a tick reads none of what earlier ones found
* ``status``  one row per seed after the poll: clocks, watermark, done
* ``done``    one row once the tick is complete

A tick reads folders of earlier polls only and overwrites its own, so repeating one
changes nothing, and a poll that was written once is replayed instead of asked again.
Outputs are joined by seed and key, so a seed with most of them is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from threading import Lock
from time import monotonic

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.keys import key_digest, with_one_zero
from tidewatch.functions.termination import StatefulTermination, advance
from tidewatch.functions.times import discovery_time, interval
from tidewatch.operators.bounded import admit, forget
from tidewatch.operators.first_seen import first_in_poll
from tidewatch.operators.polls import end_marks
from tidewatch.plans.spec import WatchSpec
from tidewatch.streaming.seen import SeenKeys
from tidewatch.workspace import new_folder

STATUS = (
    "seed string, seed_ts timestamp_ntz, start_ts timestamp_ntz, poll_no int, poll_ts timestamp_ntz, "
    "n_new bigint, last_new_ts timestamp_ntz, watermark timestamp_ntz, done boolean, "
    "stop_states map<string, string>, stop_flags map<string, boolean>"
)
MEMORY = "seed string, key_hash string, idx bigint"


def utc_now(poll_no: int) -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Ticks:
    """The tables of one live watch and the tick that extends them.

    ``seeds`` returns the table ``(seed, added_at, event_ts)``; it is read at every tick,
    so seeds may be added while the watch runs.  With a column ``poll_every``, a day-time interval, a seed is
    asked by the tick that is nearest to that long after its last poll, a new one at once, one with
    NULL at every tick.  A tick leaves seeds that are not due as they are: their polls, idle times and iterations are
    their own.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: WatchSpec,
        seeds: Callable[[SparkSession], DataFrame],
        root: str,
        clock: Callable[[int], datetime] = utc_now,
    ):
        if spec.poll_fn is None:
            raise ValueError("a live watch needs a poll_fn")
        self.spark, self.spec, self.seeds, self.root, self.clock = spark, spec, seeds, root, clock
        self._seen = SeenKeys(spark, f"{root}/seen")

    def close(self) -> None:
        """Stop what runs between ticks; another tick starts it again."""
        self._seen.close()

    def emitted(self) -> DataFrame:
        """Every new output of the ticks that are complete."""
        every = self.spark.read.parquet(f"{self.root}/fresh")
        return every.filter(F.col("poll_no") <= self._last_mark("done"))

    def status(self, poll_no: int) -> DataFrame:
        if poll_no < 1:
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(self._folder("status", poll_no))

    def active(self, poll_no: int) -> bool:
        """Is any seed still watched after this poll?"""
        return not self.status(poll_no).filter("not done").isEmpty()

    def tick(self, poll_no: int) -> None:
        """Poll the active seeds as poll number ``poll_no``, from 1 and without gaps."""
        before = self.status(poll_no - 1)
        done = before.filter("done").select("seed")
        watched = self.seeds(self.spark).join(done, ["seed"], "left_anti")
        kept, poll_ts = before.filter("done"), None
        if "poll_every" in watched.columns:
            every, (watched, poll_ts) = watched, self._due(watched, before, poll_no)
            waiting = every.select("seed").join(watched.select("seed"), ["seed"], "left_anti")
            kept = kept.unionByName(before.filter("not done").join(waiting, ["seed"], "left_semi"))
        raw = self._poll_once(watched, poll_no, poll_ts)
        poll_ts = poll_ts or raw.agg(F.max("poll_ts")).first()[0] or self.clock(poll_no)
        fresh = self._write(self._new_outputs(raw, poll_no), "fresh", poll_no)
        if self._remembers:
            self._write(forget(self._memory(poll_no - 1), fresh, self.spec.max_completed_size), "memory", poll_no)
        self._write(self._status_after(watched, raw, fresh, before, poll_ts).unionByName(kept), "status", poll_no)
        self._mark("done", poll_no)

    def next_poll(self) -> int:
        """The poll that comes after the last complete tick."""
        return self._last_mark("done") + 1

    @property
    def _remembers(self) -> bool:
        return bool(self.spec.max_completed_size)

    def _folder(self, table: str, poll_no: int) -> str:
        return f"{self.root}/{table}/poll_no={poll_no}"

    def _write(self, df: DataFrame, table: str, poll_no: int) -> DataFrame:
        folder = self._folder(table, poll_no)
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _due(self, watched: DataFrame, before: DataFrame, poll_no: int) -> tuple[DataFrame, datetime]:
        """The seeds that this tick asks, and its clock reading; a poll that was written keeps both."""
        if poll_no > self._last_mark("ledger"):
            now = self.clock(poll_no).isoformat(" ")
            last = before.select("seed", F.col("poll_ts").alias("_last"))
            nearest = F.lit(now).cast("timestamp_ntz") + interval(self.spec.poll_interval / 2)
            due = F.coalesce(F.col("_last") + F.col("poll_every") < nearest, F.lit(True))
            asked = watched.join(last, ["seed"], "left").select(
                *watched.columns, F.lit(now).cast("timestamp_ntz").alias("_now"), due.alias("_due")
            )
            # One row more than there are seeds, so that the reading is kept if none is due.
            reading = self.spark.range(1).select(F.lit(now).cast("timestamp_ntz").alias("_now"), F.lit(False).alias("_due"))
            self._write(asked.filter("_due").unionByName(reading, allowMissingColumns=True), "asked", poll_no)
        every = self.spark.read.parquet(self._folder("asked", poll_no))
        return every.filter("_due").select(*watched.columns), every.agg(F.max("_now")).first()[0]

    def _poll_once(self, watched: DataFrame, poll_no: int, poll_ts: datetime | None = None) -> DataFrame:
        folder = self._folder("raw", poll_no)
        if poll_no > self._last_mark("ledger"):
            poll_ts = poll_ts or self.clock(poll_no)
            rows = self.spec.poll_fn(watched, poll_no, poll_ts)
            stamped = rows.withColumn("poll_ts", F.lit(poll_ts.isoformat(" ")).cast("timestamp_ntz"))
            stamped.write.mode("overwrite").parquet(folder)
            self._mark("ledger", poll_no)
            return self.spark.read.schema(stamped.schema).parquet(folder)
        return self.spark.read.parquet(folder)

    def _mark(self, table: str, poll_no: int) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._folder(table, poll_no))

    def _last_mark(self, table: str) -> int:
        """The latest marked poll of a table, or 0."""
        try:
            marked = self.spark.read.schema("id bigint, poll_no int").parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise
        return marked.agg(F.max("poll_no")).first()[0] or 0

    def _memory(self, poll_no: int) -> DataFrame:
        if poll_no < 1:
            return self.spark.createDataFrame([], MEMORY)
        return self.spark.read.schema(MEMORY).parquet(self._folder("memory", poll_no))

    def _new_outputs(self, raw: DataFrame, poll_no: int) -> DataFrame:
        typed, key = self.spec.keyed(raw.filter(F.col("pos").isNotNull()))
        typed = with_one_zero(typed, key)
        hashed = typed.select(
            "seed", "pos", "value", key_digest(*key).alias("key_hash"),
            discovery_time(F.col("event_ts"), F.col("poll_ts")).alias("discovered_ts"),
            F.lit(poll_no).alias("poll_no"),
        )
        listed = first_in_poll(hashed, ["key_hash"]).drop("poll_no")
        if self._remembers:
            return admit(listed, self._memory(poll_no - 1))
        if self.spec.max_completed_size == 0:
            return listed
        return self._seen.admit(listed, poll_no)

    def _status_after(
        self, watched: DataFrame, raw: DataFrame, fresh: DataFrame, before: DataFrame, poll_ts: datetime
    ) -> DataFrame:
        """One row per seed that was asked.  A seed that the poll did not mention had an empty poll."""
        heads = end_marks(raw.filter(F.col("pos").isNull())).select("seed", "poll_ts", "watermark", "done")
        counts = fresh.groupBy("seed").agg(F.count("*").alias("n_new"), F.min("discovered_ts").alias("_earliest"))
        past = before.select(
            "seed",
            F.col("start_ts").alias("_start"),
            F.col("poll_no").alias("_polls"),
            F.col("last_new_ts").alias("_last_new"),
            F.col("watermark").alias("_wm"),
            F.col("stop_states").alias("_states"),
        )
        joined = (
            watched.select("seed", "added_at", F.col("event_ts").alias("seed_ts"))
            .join(heads, ["seed"], "left")
            .withColumn("poll_ts", F.coalesce("poll_ts", F.lit(poll_ts.isoformat(" ")).cast("timestamp_ntz")))
            .withColumn("done", F.coalesce("done", F.lit(False)))
            .join(counts, ["seed"], "left")
            .join(past, ["seed"], "left")
        )
        now = joined.select(
            "seed",
            "seed_ts",
            F.coalesce("_start", "added_at", "poll_ts").alias("start_ts"),
            (F.coalesce("_polls", F.lit(0)) + 1).cast("int").alias("poll_no"),
            "poll_ts",
            F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"),
            F.when(F.col("n_new") > 0, F.col("poll_ts")).otherwise(F.col("_last_new")).alias("last_new_ts"),
            F.coalesce("watermark", "_earliest").alias("_candidate"),
            "_wm",
            "done",
            F.col("_states").alias("stop_states"),
            F.lit(None).cast("map<string, boolean>").alias("stop_flags"),
        )
        conditions = list(self.spec.termination.stateful())
        if conditions:
            now = now.mapInArrow(_advance(conditions), now.schema)
        # The stopping poll reports no watermark of its own.
        ended = now.withColumn("done", F.col("done") | self.spec.termination.stop())
        reported = F.greatest("seed_ts", "_wm", F.when(~F.col("done"), F.col("_candidate")))
        after = ended.withColumn("watermark", reported).drop("_candidate", "_wm")
        return after


def _advance(conditions: list[StatefulTermination]) -> Callable[[Iterator], Iterator]:
    """Move the states of stateful conditions by one poll; one row per seed."""

    def step(row: dict) -> dict:
        known = dict(row["stop_states"] or ())
        states, flags = advance(conditions, known, row["seed"], row["start_ts"], row["poll_ts"], row["n_new"])
        return {**row, "stop_states": list(states.items()), "stop_flags": list(flags.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([step(row) for row in batch.to_pylist()], schema=batch.schema)

    return run


class Runner:
    """Runs ticks at the poll interval.

    A stream that always has data serves as the clock.  How far the watch got is in the
    tables alone, so a new runner on the same root goes on where the last one stopped.
    """

    def __init__(self, ticks: Ticks):
        self.ticks = ticks
        self.poll_no = ticks.next_poll()
        self.finished = self.poll_no > 1 and not ticks.active(self.poll_no - 1)
        self._closing = False
        self._running = Lock()
        self._query: StreamingQuery | None = None

    def start(self) -> StreamingQuery:
        ticks = self.ticks
        clock = ticks.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        self._query = (
            clock.writeStream.foreachBatch(lambda _, batch_id: self._on_tick())
            .option("checkpointLocation", new_folder(ticks.spark, "clock"))
            .trigger(processingTime=f"{round(ticks.spec.poll_interval * 1000)} milliseconds")
            .start()
        )
        return self._query

    def _on_tick(self) -> None:
        with self._running:
            if not (self._closing or self.finished):
                self.ticks.tick(self.poll_no)
                self.finished = not self.ticks.active(self.poll_no)
                self.poll_no += 1

    def stop(self) -> None:
        """Stop after the tick that is under way."""
        self._closing = True
        with self._running:
            pass  # a tick that starts from here on sees _closing and does nothing
        self._query.stop()


def run(ticks: Ticks, timeout: float | None = None) -> bool:
    """Run until every seed is done, or ``timeout`` seconds passed; were all seeds done?"""
    runner = Runner(ticks)
    if runner.finished:
        return True
    end = None if timeout is None else monotonic() + timeout
    query = runner.start()
    try:
        while not runner.finished and (end is None or monotonic() < end):
            query.awaitTermination(min(ticks.spec.poll_interval, 1.0))
    finally:
        runner.stop()
        ticks.close()
    return runner.finished
