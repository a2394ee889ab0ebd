"""Keep the first output of each key: within a poll, over a whole log, or against history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def first_by(df: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of the row with the smallest ``order`` per ``keys``.

    One shuffle with map-side combine, so a key that holds a third of the rows sends one
    row per map task.  With fixed-width ``order`` and ``keep`` columns both sides run as
    hash aggregation; a struct or string column makes them sort first.
    """
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in keep])


def log_order(poll_no: Column, pos: Column) -> Column:
    """Order of an output in the poll log: by poll, then by position in the poll.

    One DECIMAL(38, 0), which holds every BIGINT position and poll numbers up to 5 * 10**18, and
    keeps :func:`first_by` a hash aggregation, as a struct would not.
    """
    step = F.lit(str(2**64)).cast("decimal(20,0)")
    return (poll_no.cast("decimal(19,0)") * step).cast("decimal(38,0)") + pos.cast("decimal(19,0)")


def first_in_poll(outputs: DataFrame, key: Sequence[str] = ("value",)) -> DataFrame:
    """One row per seed, poll and key: the first by position."""
    group = ["seed", "poll_no", *key]
    keep = [c for c in outputs.columns if c not in group]
    return first_by(outputs, group, F.col("pos"), keep).select(*outputs.columns)


def first_seen(outputs: DataFrame, key: Sequence[str] = ("value",)) -> DataFrame:
    """One row per seed and key: its first output in the log.

    This is at once the filter within a poll and against all earlier polls, since the
    first row of a key in the log is also the first one of its poll.
    """
    group = ["seed", *key]
    keep = [c for c in outputs.columns if c not in group]
    return first_by(outputs, group, log_order(F.col("poll_no"), F.col("pos")), keep).select(*outputs.columns)


def not_seen_before(outputs: DataFrame, seen: DataFrame, key: Sequence[str] = ("value",)) -> DataFrame:
    """Drop outputs whose key is in ``seen`` for the same seed; NULL keys count as equal.

    ``outputs`` should hold one row per seed and key already.  The history is first cut
    down to the keys at hand, in a semi join that streams over ``seen``; if the new keys
    are few, Spark broadcasts them by their measured size and ``seen`` is not shuffled.
    """
    group = ["seed", *key]
    wanted = outputs.select(*[F.col(c).alias(f"_w_{c}") for c in group])
    known = seen.select(*group).join(
        wanted, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in group], "left_semi"
    )
    known = known.select(*[F.col(c).alias(f"_k_{c}") for c in group])
    return outputs.join(known, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in group], "left_anti")
