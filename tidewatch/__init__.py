"""Watching things that grow, and reading sources that never end, on Spark."""

from tidewatch.functions.termination import (
    StatefulTermination,
    Termination,
    after_iterations,
    after_time_since_new_output,
    after_total_of,
    all_of,
    custom,
    either_of,
    never,
)
from tidewatch.plans.growth import WatchResult
from tidewatch.plans.poll import PollResult, Timed, per_seed
from tidewatch.plans.spec import DEFAULT_MAX_COMPLETED_SIZE, Watch, WatchSpec

__all__ = [
    "DEFAULT_MAX_COMPLETED_SIZE",
    "PollResult",
    "StatefulTermination",
    "Termination",
    "Timed",
    "Watch",
    "WatchResult",
    "WatchSpec",
    "after_iterations",
    "after_time_since_new_output",
    "after_total_of",
    "all_of",
    "custom",
    "either_of",
    "never",
    "per_seed",
]
