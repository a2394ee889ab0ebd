"""The immutable description of a watch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidewatch.functions.checks import checked_int, checked_seconds
from tidewatch.functions.termination import Termination, never
from tidewatch.plans.growth import WatchResult, watch_log

# Keys remembered per seed, and seconds between polls, unless set otherwise.
DEFAULT_MAX_COMPLETED_SIZE = 100_000
DEFAULT_POLL_INTERVAL = 1.0


@dataclass(frozen=True)
class WatchSpec:
    """How to watch; every ``with_*`` returns a changed copy and leaves this one as it is.

    ``poll_fn`` is either a poll of all seeds in one job, ``(seeds, poll_no, poll_ts) ->
    DataFrame`` of poll rows, or such a function made from a per-seed Python function by
    :func:`tidewatch.plans.poll.per_seed`.  It is not needed for a recorded poll log.
    """

    poll_fn: Callable[..., DataFrame] | None = None
    poll_interval: float = DEFAULT_POLL_INTERVAL
    termination: Termination = never()
    output_key: Callable[[Column], Column] | None = None
    value_type: str | None = None
    key_type: str | None = None
    max_completed_size: int | None = DEFAULT_MAX_COMPLETED_SIZE

    def with_poll_interval(self, duration: float | timedelta) -> "WatchSpec":
        return replace(self, poll_interval=checked_seconds("poll interval", duration, above=0.0, finite=True))

    def with_termination_per_input(self, condition: Termination) -> "WatchSpec":
        if not isinstance(condition, Termination):
            raise TypeError("condition must be a termination condition")
        return replace(self, termination=condition)

    def with_output_key(self, key: Callable[[Column], Column]) -> "WatchSpec":
        """``key`` maps the value Column to the Column that decides what is new."""
        if not callable(key):
            raise TypeError("key must be callable")
        return replace(self, output_key=key)

    def with_value_type(self, ddl: str) -> "WatchSpec":
        return replace(self, value_type=_checked_type(ddl))

    def with_key_type(self, ddl: str) -> "WatchSpec":
        return replace(self, key_type=_checked_type(ddl))

    def with_max_completed_size(self, n: int | None) -> "WatchSpec":
        """Keys remembered per seed; ``None`` remembers all, 0 none."""
        return replace(self, max_completed_size=checked_int("remembered keys", n, least=0, optional=True))

    def keyed(self, outputs: DataFrame) -> tuple[DataFrame, list[str]]:
        """Outputs with declared types, and the columns that make up the key."""
        value = F.col("value") if self.value_type is None else F.col("value").cast(self.value_type)
        typed = outputs.withColumn("value", value)
        if self.output_key is None and self.key_type is None:
            return typed, ["value"]
        key = self.output_key(F.col("value")) if self.output_key else F.col("value")
        return typed.withColumn("key", key if self.key_type is None else key.cast(self.key_type)), ["key"]

    def over_log(self, seeds: DataFrame, polls: DataFrame, outputs: DataFrame) -> WatchResult:
        """Apply the watch to a recorded poll log."""
        if seeds is None or polls is None or outputs is None:
            raise ValueError("a poll log is made of seeds, polls and outputs")
        typed, key = self.keyed(outputs)
        return watch_log(seeds, polls, typed, self.termination, key, self.max_completed_size)


class Watch:
    """Entry point: ``Watch.growth_of(poll_fn).with_poll_interval(...)``."""

    @staticmethod
    def growth_of(
        poll_fn: Callable[..., DataFrame] | None = None, output_key: Callable[[Column], Column] | None = None
    ) -> WatchSpec:
        if poll_fn is not None and not callable(poll_fn):
            raise TypeError("poll_fn must be callable")
        spec = WatchSpec(poll_fn=poll_fn)
        return spec if output_key is None else spec.with_output_key(output_key)


def _checked_type(ddl: str) -> str:
    if not isinstance(ddl, str):
        raise TypeError("a type is given as a DDL string")
    DataType.fromDDL(ddl)
    return ddl
