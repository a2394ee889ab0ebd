"""The integers 0 .. n-1 in ``numSplits`` contiguous splits; i happens at second i."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

from tidewatch.sources.split_source import SplitSource

ROWS_PER_BATCH = 100_000


class CountingSource(SplitSource):
    @classmethod
    def name(cls) -> str:
        return "counting_source"

    def schema(self) -> str:
        return "value bigint, event_ts timestamp_ntz, terminal boolean"

    def _n(self) -> int:
        return int(self.options.get("maxCount", 10))

    def splits(self) -> list[str]:
        return [str(i) for i in range(int(self.options.get("numSplits", 1)))]

    def _bounds(self, split: str) -> tuple[int, int]:
        parts = int(self.options.get("numSplits", 1))
        return int(split) * self._n() // parts, (int(split) + 1) * self._n() // parts

    def latest(self, split: str) -> int:
        first, last = self._bounds(split)
        return last - first

    def backlog_bytes(self, split: str, offset: int) -> int:
        return 8 * (self.latest(split) - offset)

    def read_range(self, schema: StructType, split: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        first, _ = self._bounds(split)
        for at in range(first + start, first + end, ROWS_PER_BATCH):
            values = pa.array(range(at, min(at + ROWS_PER_BATCH, first + end)), pa.int64())
            micros = pc.multiply(values, 1_000_000).cast(pa.timestamp("us"))
            last = pc.equal(values, self._n() - 1)
            yield pa.RecordBatch.from_arrays([values, micros, last], ["value", "event_ts", "terminal"])
