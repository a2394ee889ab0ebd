"""A source without splits: it has no records and is at its end from the start."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.types import StructType

from tidewatch.sources.split_source import SplitSource


class EmptySource(SplitSource):
    @classmethod
    def name(cls) -> str:
        return "empty_source"

    def schema(self) -> str:
        return "value string, event_ts timestamp_ntz"

    def splits(self) -> list[str]:
        return []

    def latest(self, split: str) -> int:
        return 0

    def read_range(self, schema: StructType, split: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        return iter(())
