"""Streaming deduplication, with hot keys spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Rows, or bytes, beyond one row per id that a task holds.
HELD_ROWS = 100_000
HELD_BYTES = 32 << 20
#: Groups that the ids of a micro-batch are dealt into; a task holds the ids of one at a time.
ID_GROUPS = 1 << 12


def _salted(rows: DataFrame, spread_by: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))


def first_of_keys(rows: DataFrame, key: Sequence[str], spread_by: str) -> DataFrame:
    """One row per key over the whole stream; which of its rows is not defined.

    A key with most of the rows is first thinned out in ``SALTS`` tasks, so the second
    step sees at most ``SALTS`` rows of it.  The state grows with the number of keys.
    """
    return _salted(rows, spread_by).dropDuplicates([*key, "_salt"]).dropDuplicates(list(key)).drop("_salt")


def first_of_ids(rows: DataFrame, key: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The first delivery of each id by ``order``, however late it comes.

    Within a micro-batch the least by ``order`` counts, across micro-batches the one that came first.  Each task keeps one row
    per id of each ``HELD_ROWS`` or so that it reads, so an id with most of the rows sends few; then the ids are dealt
    into ``ID_GROUPS`` groups by hash, which Spark sorts, on disk if need be, and hands to Python one by one; and what is
    left, one row per id, goes through one stateful step.  So Python holds ``1 / ID_GROUPS`` of a micro-batch's ids, whatever
    the number of tasks.  Ids are never forgotten, so no first delivery is taken for a second one and none is dropped
    as late; the state, on disk, grows with the number of ids.
    """
    order = [order] if isinstance(order, str) else list(order)
    thinned = rows.mapInArrow(_keep_first(list(key), order, whole=False), rows.schema)
    groups = thinned.groupBy(F.pmod(F.xxhash64(*key), F.lit(ID_GROUPS)))
    return groups.applyInArrow(_keep_first(list(key), order, whole=True), rows.schema).dropDuplicates(list(key))


def _keep_first(
    key: list[str], order: list[str], whole: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per key of the given rows.

    With ``whole`` it holds the keys it has met and at most ``HELD_ROWS`` or ``HELD_BYTES`` more.  Without, it hands them on
    when they fill half of that and starts anew, so a key may come out again.
    """

    def first(table: pa.Table) -> pa.Table:
        ordered = table.sort_by([(name, "ascending") for name in order])
        numbered = ordered.append_column("_at", pa.array(np.arange(len(ordered))))
        least = numbered.group_by(key, use_threads=False).aggregate([("_at", "min")])["_at_min"]
        return ordered.take(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = size = kept_rows = kept_size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                size += batch.nbytes
            if rows > kept_rows + HELD_ROWS or size > kept_size + HELD_BYTES:
                held = [first(pa.concat_tables(held))]
                rows, size = len(held[0]), held[0].nbytes
                if not whole and (2 * rows > HELD_ROWS or 2 * size > HELD_BYTES):
                    yield from held.pop().to_batches()
                    rows = size = 0
                kept_rows, kept_size = rows, size
        if held:
            yield from first(pa.concat_tables(held)).to_batches()

    return run
