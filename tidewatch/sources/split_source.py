"""A source made of splits, each a sequence of records numbered by offset.

A subclass names its splits, tells how far each one reaches, and reads a range of one.
Spark does the rest: the offsets of all splits are the stream's offset, kept in the
checkpoint folder; each range becomes one or more tasks, so a split that holds most of
the data is still read by many; a restart reads strictly after the saved offsets.
"""

from __future__ import annotations

import logging
from abc import abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LOG = logging.getLogger(__name__)
WHOLE = "whole"
BACKLOG_UNKNOWN = -1
MAX_ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class SplitRange(InputPartition):
    """Offsets ``start`` (included) to ``end`` (excluded) of one split."""

    split: str
    start: int
    end: int


class SplitSource(DataSource):
    """Base class; ``self.options`` holds what was given with ``.option(...)``."""

    @abstractmethod
    def splits(self) -> list[str]:
        """Names of the splits.

        If this fails, a batch read takes the source as one split.  A stream fails instead
        and is started again: its saved offsets stand for splits, and reading the source
        as a whole would repeat them.  A stream that is to be read as one from the start gets the
        option ``unsplit``, and keeps it.

        A split keeps its name and its records for good, since saved offsets refer to
        them; new splits may be added.
        """

    @abstractmethod
    def latest(self, split: str) -> int:
        """The offset after the last record available now.  At the end of the source it stays."""

    @abstractmethod
    def read_range(self, schema: StructType, split: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """The records of an offset range.  Called on executors; the same range gives the same records."""

    def earliest(self, split: str) -> int:
        """The first offset of the split."""
        return 0

    def backlog_bytes(self, split: str, offset: int) -> int:
        """Bytes from ``offset`` on, or -1 if not known."""
        return BACKLOG_UNKNOWN

    def finalize(self, offsets: dict[str, int]) -> None:
        """The records before ``offsets`` are durable downstream and may be discarded."""

    def close(self) -> None:
        """Release what ``read_range`` holds; called after each range, also when it failed."""

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self, schema)

    def split_names(self) -> list[str]:
        """The splits, or one that stands for the whole source if option ``unsplit`` is true."""
        whole = self.options.get("unsplit", "false").lower() == "true"
        return [WHOLE] if whole else list(self.splits())

    def split_names_or_whole(self) -> list[str]:
        """The same, and the whole source if it cannot be split."""
        try:
            return self.split_names()
        except Exception:
            LOG.warning("Cannot split %s; reading it as one.", type(self).__name__, exc_info=True)
            return [WHOLE]

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[SplitRange]:
        if (WHOLE in start) != (WHOLE in end) and start:
            raise RuntimeError("option unsplit must stay what it was when this read began")
        step = int(self.options.get("maxRowsPerTask", MAX_ROWS_PER_TASK))
        tasks = []
        for split, stop in end.items():
            first = start.get(split)
            first = self.earliest(split) if first is None else first
            tasks += [SplitRange(split, at, min(at + step, stop)) for at in range(first, stop, step)]
        return tasks

    def read_closing(self, schema: StructType, part: SplitRange) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.read_range(schema, part.split, part.start, part.end)
        finally:
            self.close()


class _BatchReader(DataSourceReader):
    """Everything that is available now."""

    def __init__(self, source: SplitSource, schema: StructType):
        self.source, self.schema = source, schema

    def partitions(self) -> list[SplitRange]:
        return self.source.ranges({}, {s: self.source.latest(s) for s in self.source.split_names_or_whole()})

    def read(self, partition: SplitRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return iter(())
        return self.source.read_closing(self.schema, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: SplitSource, schema: StructType):
        self.source, self.schema = source, schema

    def initialOffset(self) -> dict[str, int]:
        return {s: self.source.earliest(s) for s in self.source.split_names()}

    def latestOffset(self) -> dict[str, int]:
        return {s: self.source.latest(s) for s in self.source.split_names()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[SplitRange]:
        return self.source.ranges(start, end)

    def read(self, partition: SplitRange) -> Iterator[pa.RecordBatch]:
        return self.source.read_closing(self.schema, partition)

    def commit(self, end: dict[str, int]) -> None:
        self.source.finalize(end)
