"""What a user's poll function answers, and how it is called on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.functions.checks import checked_int, checked_seconds
from tidewatch.plans.side_by_side import side_by_side

ROWS_PER_BATCH = 10_000


@dataclass(frozen=True)
class Timed:
    """An output with its own event time (naive, UTC)."""

    value: Any
    event_ts: datetime


@dataclass(frozen=True)
class PollResult:
    """The answer of one poll.  ``outputs`` may be a generator; it is read once, in batches."""

    outputs: Iterable[Any] = ()
    watermark: datetime | None = None
    complete: bool = False

    @classmethod
    def of(cls, outputs: Iterable[Any], watermark: datetime | None = None, complete: bool = False) -> "PollResult":
        return cls(outputs, watermark, complete)

    @classmethod
    def empty(cls, watermark: datetime | None = None, complete: bool = False) -> "PollResult":
        return cls((), watermark, complete)


def poll_rows_schema(value_type: str) -> str:
    """Rows of one poll: a header with NULL ``pos`` per seed, then one row per output."""
    return (
        f"seed string, pos bigint, value {value_type}, event_ts timestamp_ntz, "
        "watermark timestamp_ntz, complete boolean"
    )


def per_seed(
    poll_fn: Callable[[str], PollResult | Iterable[Any]],
    value_type: str,
    at_once: int = 1,
    deadline: float | timedelta | None = None,
) -> Callable[..., DataFrame]:
    """A poll of all seeds in one job, calling ``poll_fn(seed)`` once per seed on the executors.

    Outputs are Python values, :class:`Timed` ones, or Arrow arrays and record batches with the columns
    ``value`` and, if they have their own times, ``event_ts``.

    A task asks ``at_once`` seeds side by side.  A seed that is not through ``deadline`` seconds after it was asked does
    not hold up the others: what it has listed by then counts, its watermark and completion don't, and it is
    asked again by the next poll, though not by a worker in which the late call still runs.
    """
    if not callable(poll_fn):
        raise TypeError("poll_fn must be callable")
    at_once = checked_int("polls at once", at_once, least=1)
    seconds = None if deadline is None else checked_seconds("deadline", deadline, above=0.0)
    fields = poll_rows_schema(value_type)
    own_name = uuid4().hex

    def poll(seeds: DataFrame, poll_no: int, poll_ts: datetime) -> DataFrame:
        spark = seeds.sparkSession
        schema = StructType.fromDDL(fields)
        arrow = to_arrow_schema(schema)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = (seed for batch in batches for seed in batch.column("seed").to_pylist())

            def answer(seed: str) -> Iterator[pa.RecordBatch]:
                return answer_batches(seed, poll_fn(seed), arrow)

            if at_once == 1 and seconds is None:
                return (rows for seed in names for rows in answer(seed))
            return side_by_side(own_name, names, answer, at_once, seconds)

        spread = seeds.select("seed").repartition(spark.sparkContext.defaultParallelism, "seed")
        return spread.mapInArrow(ask, schema)

    return poll


def answer_batches(seed: str, answer: PollResult | Iterable[Any], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one answer; the header comes last, when the outputs have been listed to their end."""
    result = answer if isinstance(answer, PollResult) else PollResult.of(answer)
    listed = result.outputs
    listed = [listed] if isinstance(listed, (pa.RecordBatch, pa.Table, pa.Array, pa.ChunkedArray)) else listed
    at, rows = 0, []
    for item in listed:
        if isinstance(item, (pa.RecordBatch, pa.Table, pa.Array, pa.ChunkedArray)):
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
            for part in _arrow_rows(seed, at, item, arrow):
                yield part
                at += part.num_rows
            continue
        timed = isinstance(item, Timed)
        rows.append({
            "seed": seed, "pos": at, "value": item.value if timed else item, "event_ts": item.event_ts if timed else None
        })
        at += 1
        if len(rows) == ROWS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows = []
    rows.append({"seed": seed, "watermark": result.watermark, "complete": result.complete})
    yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def _arrow_rows(seed: str, at: int, item: Any, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Outputs that are Arrow already, numbered from ``at``."""
    if isinstance(item, (pa.Array, pa.ChunkedArray)):
        item = pa.table({"value": item})
    for part in pa.Table.from_batches([item]).to_batches() if isinstance(item, pa.RecordBatch) else item.to_batches():
        n = part.num_rows
        known = {"seed": pa.repeat(pa.scalar(seed, pa.string()), n), "pos": pa.array(range(at, at + n), pa.int64())}
        known |= {name: part.column(name) for name in ("value", "event_ts") if name in part.schema.names}
        yield pa.RecordBatch.from_arrays(
            [known[f.name].cast(f.type) if f.name in known else pa.nulls(n, f.type) for f in arrow], schema=arrow
        )
        at += n


def headers(rows: DataFrame, poll_no: int) -> DataFrame:
    """The ``polls`` rows of a written poll."""
    return rows.filter(F.col("pos").isNull()).select(
        "seed", F.lit(poll_no).alias("poll_no"), "poll_ts", "watermark", "complete"
    )


def listed(rows: DataFrame, poll_no: int) -> DataFrame:
    """The ``outputs`` rows of a written poll."""
    return rows.filter(F.col("pos").isNotNull()).select(
        "seed", F.lit(poll_no).alias("poll_no"), "pos", "value", "event_ts"
    )
