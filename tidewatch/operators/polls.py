"""From a poll log to the watch result: normalisation, summaries, watermarks and stops.

Tables (all times TIMESTAMP_NTZ):

* ``seeds(seed, added_at, event_ts)``
* ``polls(seed, poll_no, poll_ts, watermark, complete)``  one row per poll, also when empty
* ``outputs(seed, poll_no, pos, value, event_ts)``        one row per listed output
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType, StructField, StructType

from tidewatch.functions.termination import StatefulTermination, Termination, advance
from tidewatch.functions.times import END_OF_TIME, discovery_time, ntz
from tidewatch.operators.running import position_in_group, running_max
from tidewatch.workspace import written

# Polls of one seed are carried in blocks of 2 ** 12 = 4,096; one level of blocks is enough,
# as a poll a second for ten years makes 77,000 of them.
POLL_BLOCK_BITS = 12


def end_marks(polls: DataFrame) -> DataFrame:
    """Add ``done``: the poll is complete, or its watermark is the end of time.

    The watermark of such a poll says nothing more than ``done`` and becomes NULL.
    """
    done = F.coalesce(F.col("complete"), F.lit(False)) | F.coalesce(
        F.col("watermark") >= ntz(END_OF_TIME), F.lit(False)
    )
    return polls.withColumn("done", done).withColumn("watermark", F.when(~F.col("done"), F.col("watermark")))


def explode_results(results: DataFrame) -> DataFrame:
    """Nested poll results ``(seed, poll_no, poll_ts, outputs ARRAY, watermark, complete)`` as rows.

    One row per output with its position; an empty poll keeps one row with NULL output.
    """
    marked = end_marks(results)
    flat = marked.select("*", F.posexplode_outer("outputs").alias("pos", "_item"))
    return flat.select(
        "seed", "poll_no", "pos", F.col("_item.value").alias("value"),
        F.col("_item.event_ts").alias("event_ts"), "watermark", "done",
    )


def _no_poll() -> Column:
    return F.raise_error(F.lit("an output has no row in polls"))


def normalize(polls: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per output with its poll's watermark and end mark; empty polls keep one row.

    The empty polls are added apart, so the large side stays the preserved side of its
    join and Spark may split a poll that holds much of the log.
    """
    marked = written(end_marks(polls).select("seed", "poll_no", "watermark", "done"), "polls")
    listed = outputs.select("seed", "poll_no").distinct()
    empty = marked.join(listed, ["seed", "poll_no"], "left_anti")
    full = outputs.select("seed", "poll_no", "pos", "value", "event_ts").join(marked, ["seed", "poll_no"], "left")
    # Filtered on, so that the check holds whatever columns are read.
    full = full.filter(F.coalesce("done", _no_poll()).isNotNull())
    return full.unionByName(empty, allowMissingColumns=True)


def with_discovery_time(outputs: DataFrame, polls: DataFrame) -> DataFrame:
    """Replace ``event_ts`` by ``discovered_ts``; an output without its poll is an error.

    The polls are written first, so that their size is known when the join is planned.
    """
    times = written(polls.select("seed", "poll_no", "poll_ts"), "polls")
    dated = outputs.join(times, ["seed", "poll_no"], "left")
    polled = dated.filter(F.coalesce(F.col("poll_ts"), _no_poll().cast("timestamp_ntz")).isNotNull())
    found = discovery_time(F.col("event_ts"), F.col("poll_ts")).alias("discovered_ts")
    return polled.select(*[c for c in outputs.columns if c != "event_ts"], found)


def with_emit_order(fresh: DataFrame) -> DataFrame:
    """Number the new outputs of each poll by discovery time, ties by position."""
    return position_in_group(fresh, ["seed", "poll_no"], ["discovered_ts", "pos"], "emit_no")


def poll_summary(seeds: DataFrame, polls: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per poll: how many outputs were new, and the watermark it proposes.

    ``fresh`` are the new outputs with their own ``event_ts``.  A poll without a
    watermark proposes its earliest discovery time, an empty one proposes nothing.  The
    earliest discovery time follows from the earliest own time and the poll's time, so
    no output row has to be joined with its poll.
    """
    counts = fresh.groupBy("seed", "poll_no").agg(
        F.count("*").alias("n_new"),
        F.min("event_ts").alias("_first_ts"),
        F.count_if(F.col("event_ts").isNull()).alias("_n_undated"),
    )
    arrivals = seeds.select("seed", "added_at", F.col("event_ts").alias("seed_ts"))
    earliest = F.least("_first_ts", F.when(F.col("_n_undated") > 0, F.col("poll_ts")))
    return (
        end_marks(polls)
        .join(counts, ["seed", "poll_no"], "left")
        .join(arrivals, ["seed"], "left")
        .select(
            "seed", "poll_no", "poll_ts", "done", "added_at", "seed_ts",
            F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"),
            F.when(~F.col("done"), F.coalesce("watermark", earliest)).alias("candidate"),
        )
    )


def with_running_state(summary: DataFrame) -> DataFrame:
    """Add per poll: running watermark, the one before this poll, idle clock, total clock.

    The summary is small but costs a pass over all outputs, and the running maxima read
    it more than once; so it is written first.
    """
    summary = written(summary, "summary")
    state = running_max(
        summary,
        ["seed"],
        "poll_no",
        up_to={
            "wm": F.col("candidate"),
            "last_new_ts": F.when(F.col("n_new") > 0, F.col("poll_ts")),
        },
        before={"wm_before": F.col("candidate")},
        block_bits=POLL_BLOCK_BITS,
        levels=1,
    )
    first_poll = summary.groupBy("seed").agg(F.min("poll_ts").alias("_first_poll_ts"))
    return (
        state.join(first_poll, ["seed"], "left")
        .withColumn("start_ts", F.coalesce("added_at", "_first_poll_ts"))
        .drop("_first_poll_ts")
    )


def with_stop_flags(state: DataFrame, conditions: Sequence[StatefulTermination]) -> DataFrame:
    """Add ``stop_flags``: which conditions with a state of their own would end the seed at each poll.

    The polls of a seed are folded in order, as they come sorted out of the shuffle: a task holds the states of one seed and
    one batch of polls, so neither the polls of a seed nor the seeds of a task have to fit into its memory.
    """
    if not conditions:
        return state
    ordered = state.repartition("seed").sortWithinPartitions("seed", "poll_no")
    schema = StructType([*state.schema.fields, StructField("stop_flags", MapType(StringType(), BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = object(), {}
        for batch in batches:
            found = []
            for seed, *poll in zip(*(batch.column(c).to_pylist() for c in ("seed", "start_ts", "poll_ts", "n_new"))):
                states, flags = advance(conditions, states if seed == current else {}, seed, *poll)
                current = seed
                found.append(list(flags.items()))
            flagged = pa.array(found, pa.map_(pa.string(), pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flagged], [*batch.schema.names, "stop_flags"])

    return ordered.mapInArrow(run, schema)


def initial_watermark(wm: Column | str) -> Column:
    """A watermark that starts at the seed's own time, if it has one."""
    return F.greatest(wm, "seed_ts")


def stops(state: DataFrame, condition: Termination) -> DataFrame:
    """``stop_at`` per seed: the first poll that is done or meets the condition; NULL if none."""
    ends = F.col("done") | condition.stop()
    return state.groupBy("seed").agg(F.min(F.when(ends, F.col("poll_no"))).alias("stop_at"))


def until_stop(rows: DataFrame, stop_at: DataFrame) -> DataFrame:
    """Rows of the polls up to and including the stopping one; adds ``stop_at``."""
    cut = rows.join(stop_at, ["seed"], "left")
    return cut.filter(F.col("stop_at").isNull() | (F.col("poll_no") <= F.col("stop_at")))


def reported_watermarks(state: DataFrame, stop_at: DataFrame) -> DataFrame:
    """What the watch reports after each poll: a watermark that never falls, or the end.

    The stopping poll reports no watermark of its own, only ``done``.
    """
    last = F.coalesce(F.col("poll_no") == F.col("stop_at"), F.lit(False))
    reported = initial_watermark(F.when(last, F.col("wm_before")).otherwise(F.col("wm")))
    return until_stop(state, stop_at).select(
        "seed", "poll_no", "n_new", reported.alias("watermark"), last.alias("done")
    )
