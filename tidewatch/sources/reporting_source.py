"""A split source whose records say who they are, how far time has got, and where their split ends.

A subclass reads plain records and answers three questions about a batch of them.  The rows then
carry the columns that ``operators/records.py`` and ``streaming/splits.py`` work on, so deduplication by
id, watermarks and the end of a split need nothing else from the reader.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampNTZType

from tidewatch.sources.split_source import SplitSource

#: Columns put before those of the records.
REPORTED = (
    StructField("source_id", StringType()), StructField("split_id", StringType()),
    StructField("arrival_no", LongType()), StructField("off", LongType()), StructField("record_id", StringType()),
    StructField("source_wm", TimestampNTZType()), StructField("terminal", BooleanType()),
)


class ReportingSource(SplitSource):
    """Base class; option ``sourceId`` tells several sources of one kind apart, the name of the kind stands in for it."""

    @abstractmethod
    def record_schema(self) -> StructType:
        """The columns of ``read_records``.  Asked for where there is no session, so not as DDL."""

    @abstractmethod
    def read_records(self, split: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """The records of an offset range, one for each offset, in order.  Called on executors; the same range gives
        the same records."""

    def record_ids(self, split: str, batch: pa.RecordBatch) -> pa.Array | None:
        """What makes two deliveries of a record the same; ``None``: the source has no ids."""
        return None

    def watermarks(self, split: str, batch: pa.RecordBatch) -> pa.Array | None:
        """What the split reports once each record is read.  It may fall or be NULL; what is derived from it never falls."""
        return None

    def terminals(self, split: str, batch: pa.RecordBatch) -> pa.Array | None:
        """Which records end their split; ``None``: none of them.  What follows one is not emitted."""
        return None

    def schema(self) -> StructType:
        declared = self.record_schema()
        taken = {f.name.lower() for f in REPORTED} & {f.name.lower() for f in declared.fields}
        if taken:
            raise ValueError(f"columns of the records with names that the reader reports: {sorted(taken)}")
        return StructType([*REPORTED, *declared.fields])

    def read_range(self, schema: StructType, split: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        source, at = self.options.get("sourceId", self.name()), start
        for batch in self.read_records(split, start, end):
            n = len(batch)
            offsets = pa.array(np.arange(at, at + n, dtype=np.int64))
            at += n
            terminal = self.terminals(split, batch)
            columns = [
                pa.array([source] * n, pa.string()), pa.array([split] * n, pa.string()), offsets, offsets,
                _or_nulls(self.record_ids(split, batch), n, pa.string()),
                _or_nulls(self.watermarks(split, batch), n, pa.timestamp("us")),
                pa.array(np.zeros(n, bool)) if terminal is None else terminal.fill_null(False),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], schema.fieldNames())
        if at != end:
            # Offsets that were skipped would be taken for read.
            raise RuntimeError(f"split {split} gave {at - start} records for offsets {start} to {end}")


def _or_nulls(values: pa.Array | None, n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind) if values is None else values.cast(kind)
