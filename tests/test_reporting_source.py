"""A reader that reports record ids, watermarks and its end, read over two runs."""

import json
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators import records as ops
from tidewatch.sources import ReportingSource
from tidewatch.streaming import splits

T = datetime(2024, 1, 1)


class Journal(ReportingSource):
    """Test source: a JSON file of splits, each a list of (id, minute of the watermark, last?, value)."""

    @classmethod
    def name(cls):
        return "journal"

    def record_schema(self):
        return StructType().add("value", "long").add("id", "string").add("minute", "long").add("last", "boolean")

    def _split(self, split):
        return json.load(open(self.options["path"]))[split]

    def splits(self):
        return sorted(json.load(open(self.options["path"])))

    def latest(self, split):
        return len(self._split(split))

    def read_records(self, split, start, end):
        if self.options.get("short"):
            end -= 1
        for at in range(start, end, 2):  # batches of two
            ids, minutes, last, values = zip(*self._split(split)[at : min(at + 2, end)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()), pa.array(ids, pa.string()), pa.array(minutes, pa.int64()), pa.array(last, pa.bool_())],
                ["value", "id", "minute", "last"],
            )

    def record_ids(self, split, batch):
        return batch["id"]

    def watermarks(self, split, batch):
        return pa.array([None if m is None else T + timedelta(minutes=m) for m in batch["minute"].to_pylist()], pa.timestamp("us"))

    def terminals(self, split, batch):
        return batch["last"]


class Clash(Journal):
    def record_schema(self):
        return StructType().add("value", "long").add("Off", "long")


FIRST = {"a": [["x", 3, False, 1], ["y", 1, None, 2], ["x", None, False, 3]], "b": [["x", None, False, 4]]}
SECOND = {
    "a": FIRST["a"] + [["z", 2, False, 5], ["w", 9, True, 6], ["v", 20, False, 7]],
    "b": FIRST["b"] + [["u", 7, False, 8]], "c": [["t", 5, True, 9], ["s", 6, False, 10]],
}


def put(folder, content):
    (folder / "journal.json").write_text(json.dumps(content))


def options(folder):
    return {"path": f"{folder}/journal.json", "maxRowsPerTask": "2"}


def minute(wm):
    return None if wm is None else (wm - T).seconds // 60


def test_watermark_end_and_ids_over_two_runs(spark, tmp_path):
    spark.dataSource.register(Journal)
    for content in (FIRST, SECOND):
        put(tmp_path, content)
        stream = spark.readStream.format("journal").options(**options(tmp_path)).load()
        splits.follow_merged(stream, f"{tmp_path}/read")
    rows = splits.emitted(spark, f"{tmp_path}/read", stream.schema).collect()
    got = sorted((r.split_id, r.off, r.record_id, r.value, minute(r.watermark)) for r in rows)
    assert got == [
        ("a", 0, "x", 1, 3), ("a", 1, "y", 2, 3), ("a", 2, "x", 3, 3), ("a", 3, "z", 5, 3), ("a", 4, "w", 6, 9),
        ("b", 0, "x", 4, None), ("b", 1, "u", 8, 7), ("c", 0, "t", 9, 5),
    ]
    merged = splits.merged(spark, f"{tmp_path}/read").orderBy("batch").collect()
    assert [(minute(r.watermark), r.n_open, r.n_ended, r.held_back) for r in merged] == [(None, 2, 0, 1), (7, 1, 2, 0)]


def test_batch_operators_take_what_is_reported(spark, tmp_path):
    spark.dataSource.register(Journal)
    put(tmp_path, SECOND)
    records = spark.read.format("journal").options(sourceId="mine", **options(tmp_path)).load()
    assert {r.source_id for r in records.select("source_id").collect()} == {"mine"}
    read = ops.until_terminal(records)
    assert sorted(r.value for r in read.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    once = ops.dedup_by_id(read)
    assert sorted((r.record_id, r.value) for r in once.collect() if r.record_id != "x") == [
        ("t", 9), ("u", 8), ("w", 6), ("y", 2), ("z", 5)]
    assert once.filter(F.col("record_id") == "x").count() == 1


def test_skipped_offsets_and_clashing_columns_are_errors(spark, tmp_path):
    spark.dataSource.register(Journal)
    put(tmp_path, FIRST)
    with pytest.raises(Exception, match="gave [01] records for offsets"):
        spark.read.format("journal").options(short="1", **options(tmp_path)).load().collect()
    with pytest.raises(ValueError, match="off"):
        Clash({"path": ""}).schema()
