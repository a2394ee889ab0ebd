"""Poll log and source records derived from the ``events`` table, whatever its size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import days, ntz
from tidewatch.workspace import written

# The first day if no event has a time.
T0 = "2024-01-01"
LISTED_DAYS = 3
SPLITS = 4
# Second deliveries come after all first ones: an id at or above this is an error.
REDELIVERED_SHIFT = 1 << 62


# Declared, so that reading starts no job to find the types out.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def over_events(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query from a function of the events table, which it opens once."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(events(spark, sf_dir))

    return run


def over_log(query: Callable[["PollLog"], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query from a function of the poll log."""
    return over_events(lambda opened: query(PollLog(opened)))


@dataclass(frozen=True)
class Days:
    """The days that events fall on, numbered from 1 on the day of the earliest one.

    An event without a time falls on day 1.  ``last`` is the last day of an event, 0 without events.
    """

    first: date
    last: int

    def number(self, ts: Column | str) -> Column:
        since = F.datediff(F.to_date(ts), F.lit(self.first.isoformat()).cast("date"))
        return F.coalesce(since + 1, F.lit(1))

    def midnight(self) -> Column:
        return ntz(f"{self.first.isoformat()} 00:00:00")

    def after(self, n: Column | str) -> Column:
        """Midnight ``n`` days after that of the first day."""
        return self.midnight() + F.make_dt_interval(F.col(n) if isinstance(n, str) else n)


def days_of(events: DataFrame) -> Days:
    """One pass over one column."""
    found = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts")), F.count("*")).first()
    first, last, count = found
    if first is None:
        return Days(date.fromisoformat(T0), 1 if count else 0)
    return Days(first, (last - first).days + 1)


class PollLog:
    """The poll log of a watch that polls once a day; each poll lists the events of the last ``LISTED_DAYS`` days.

    It starts on the day of the earliest event and ends when a poll has listed the latest one.
    """

    def __init__(self, events: DataFrame):
        self.events = events

    @cached_property
    def days(self) -> Days:
        return days_of(self.events)

    @property
    def last_poll(self) -> int:
        """The last poll that lists an event; 0 without events."""
        return self.days.last + LISTED_DAYS - 1 if self.days.last else 0

    def seeds(self) -> DataFrame:
        names = self.events.select(F.col("event_type").alias("seed")).distinct()
        start = self.days.midnight()
        return names.select(
            "seed", start.alias("added_at"), F.when(F.col("seed") == "click", start + days(2)).alias("event_ts"),
        )

    def polls(self) -> DataFrame:
        """One poll per seed and day; some report a watermark, one that falls, one completes."""
        numbers = F.filter(F.sequence(F.lit(0), F.lit(self.last_poll)), lambda n: n > 0)
        numbered = self.seeds().select("seed", F.explode(numbers).alias("poll_no"))
        no, after = F.col("poll_no"), self.days.after
        return numbered.select(
            "seed",
            "poll_no",
            after(no).alias("poll_ts"),
            F.when(no % 7 == 0, after(no - 5)).when(no % 5 == 0, after(no - 1)).alias("watermark"),
            ((F.col("seed") == "error") & (no == 25)).alias("complete"),
        )

    def _listed(self, events: DataFrame) -> DataFrame:
        """Each poll lists the users of the last three days, so keys repeat in and across polls."""
        listed = events.select("*", F.explode(F.array(*[F.lit(i) for i in range(LISTED_DAYS)])).alias("_lag"))
        rows = listed.select(
            F.col("event_type").alias("seed"),
            (self.days.number("ts") + F.col("_lag")).cast("int").alias("poll_no"),
            F.col("event_id").alias("pos"),
            F.col("user_id").alias("value"),
            F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("event_ts"),
            "props",
        )
        return rows.filter(~((F.col("seed") == "signup") & (F.col("poll_no") % 6 == 0)))

    def outputs(self, events: DataFrame | None = None) -> DataFrame:
        """What the polls listed, of ``events`` if given, which may be a stream over the same table."""
        return self._listed(self.events if events is None else events).drop("props")

    def outputs_with_props(self) -> DataFrame:
        """The same log with a JSON document as value."""
        return self._listed(self.events).drop("value").withColumnRenamed("props", "value")


def polls(events: DataFrame) -> DataFrame:
    return PollLog(events).polls()


def poll_outputs(events: DataFrame) -> DataFrame:
    return PollLog(events).outputs()


def records_of(events: DataFrame) -> DataFrame:
    """Four splits per source; every tenth record is delivered a second time, later."""
    known = F.when(F.col("event_id").between(0, REDELIVERED_SHIFT - 1), F.col("event_id"))
    known = F.coalesce(known, F.raise_error(F.lit("event_id out of range")).cast("long"))
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delivered = events.select("*", F.explode(copies).alias("_copy"))
    late = F.make_dt_interval(secs=((F.col("event_id") * 7919) % 3600).cast("decimal(18,6)"))
    return delivered.select(
        F.col("event_type").alias("source_id"),
        (F.col("user_id") % SPLITS).cast("int").alias("split_id"),
        (known + F.col("_copy") * F.lit(REDELIVERED_SHIFT)).alias("arrival_no"),
        F.col("event_id").alias("off"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"),
        "value",
        F.col("ts").alias("event_ts"),
        (F.col("ts") - late).alias("source_wm"),
        ((F.col("_copy") == 0) & (F.col("event_type") == "purchase") & (F.col("value") > 200)).alias("terminal"),
    )


def checkpoints(records: DataFrame) -> DataFrame:
    """Where each split stopped last time: at two fifths of its offsets, with what it had reported."""
    split = ["source_id", "split_id"]
    reach = F.floor(F.max("off") * F.lit(0.4).cast("decimal(2,1)")).cast("long").alias("_reach")
    stopped = written(records.groupBy(*split).agg(reach), "checkpoints")
    reported = F.max(F.when(F.col("off") <= F.col("_reach"), F.col("source_wm"))).alias("watermark")
    return records.join(stopped, split).groupBy(*split).agg(F.first("_reach").alias("off"), reported)
