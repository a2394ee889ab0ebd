"""The watch over a poll log as one declarative plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import key_digest, with_one_zero
from tidewatch.functions.termination import Termination
from tidewatch.functions.times import discovery_time
from tidewatch.operators.bounded import bounded_first_seen
from tidewatch.operators.first_seen import first_seen
from tidewatch.operators.polls import poll_summary, reported_watermarks, stops, with_running_state, with_stop_flags
from tidewatch.workspace import written


@dataclass(frozen=True)
class WatchResult:
    """``outputs``: the emitted (seed, value) rows.  ``progress``: one row per poll taken."""

    outputs: DataFrame
    progress: DataFrame


def watch_log(
    seeds: DataFrame,
    polls: DataFrame,
    outputs: DataFrame,
    condition: Termination,
    key: Sequence[str] = ("value",),
    cap: int | None = None,
) -> WatchResult:
    """Watch a recorded poll log.

    Whether a key is new at poll k depends on polls up to k only, so the new outputs are
    found first, over the whole log, and the polls after a seed's stop are cut off
    afterwards.  They are written once and read twice, for the per-poll summary and for
    the result, so the log itself is read and shuffled once.  The cut and the discovery time share one join with the per-poll table.
    """
    if cap is None:
        fresh = first_seen(outputs, key)
    else:
        fresh = bounded_first_seen(outputs, polls, cap, key).withColumnRenamed("discovered_ts", "event_ts")
    fresh = with_one_zero(written(fresh, "fresh"), key)
    state = with_running_state(poll_summary(seeds, polls, fresh))
    own = list(condition.stateful())
    if own:  # folded once, read for the stops and for what was reported
        state = written(with_stop_flags(state, own), "flags")
    stop_at = stops(state, condition)
    last = stop_at.withColumnRenamed("stop_at", "_stop_at")
    taken = (
        polls.select("seed", "poll_no", "poll_ts")
        .join(last, ["seed"], "left")
        .filter(F.col("_stop_at").isNull() | (F.col("poll_no") <= F.col("_stop_at")))
        .select("seed", "poll_no", "poll_ts")
    )
    emitted = fresh.join(taken, ["seed", "poll_no"]).select(
        *[c for c in fresh.columns if c != "event_ts"],
        key_digest(*key).alias("key_hash"),
        discovery_time(F.col("event_ts"), F.col("poll_ts")).alias("discovered_ts"),
    )
    return WatchResult(emitted, reported_watermarks(state, stop_at))
