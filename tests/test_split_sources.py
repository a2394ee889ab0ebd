"""The split source contract on streams: resume, split errors, commit, options, closing."""

import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.parquet_rows import ParquetRowsSource
from tidewatch.sources import CountingSource, EmptySource, SplitSource
from tidewatch.sources.split_source import SplitRange
from tidewatch.streaming.run import write_available


class LinesSource(SplitSource):
    """Test source: each file of a folder is a split, each line a record."""

    @classmethod
    def name(cls):
        return "lines"

    def schema(self):
        return "value string, split string, suffix string"

    def splits(self):
        if self.options.get("unsplittable"):
            raise RuntimeError("cannot split")
        return sorted(os.listdir(f"{self.options['path']}/in"))

    def _lines(self, split):
        names = sorted(os.listdir(f"{self.options['path']}/in")) if split == "whole" else [split]
        return [line for n in names for line in open(f"{self.options['path']}/in/{n}").read().split()]

    def latest(self, split):
        return len(self._lines(split))

    def read_range(self, schema, split, start, end):
        lines = self._lines(split)[start:end]
        if self.options.get("failing"):
            raise RuntimeError("watermark explosion")
        n = len(lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lines, pa.string()), pa.array([split] * n), pa.array([self.options.get("suffix", "")] * n)],
            ["value", "split", "suffix"],
        )

    def finalize(self, offsets):
        with open(f"{self.options['path']}/commits", "a") as f:
            f.write(json.dumps(offsets) + "\n")

    def close(self):
        with open(f"{self.options['path']}/closed", "a") as f:
            f.write("closed\n")


def put(folder, name, text):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}", "a") as f:
        f.write(text + "\n")


def lines(spark, folder, **options):
    spark.dataSource.register(LinesSource)
    return spark.readStream.format("lines").options(path=str(folder), **options).load()


def read_back(spark, folder):
    return sorted(r.value for r in spark.read.parquet(f"{folder}/out/rows").collect())


def test_resume_reads_only_what_is_new(spark, tmp_path):
    put(tmp_path, "a", "0 1 2 3 4")
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    assert read_back(spark, tmp_path) == ["0", "1", "2", "3", "4"]
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    assert read_back(spark, tmp_path) == ["0", "1", "2", "3", "4"]
    put(tmp_path, "a", "5 6")
    put(tmp_path, "b", "7")
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    assert read_back(spark, tmp_path) == ["0", "1", "2", "3", "4", "5", "6", "7"]


def test_large_split_is_read_by_many_tasks(spark, tmp_path):
    put(tmp_path, "a", " ".join(map(str, range(25))))
    source = LinesSource({"path": str(tmp_path), "maxRowsPerTask": "10"})
    assert source.ranges({"a": 3}, {"a": 25, "b": 2}) == [
        SplitRange("a", 3, 13), SplitRange("a", 13, 23), SplitRange("a", 23, 25), SplitRange("b", 0, 2)
    ]
    stream = lines(spark, tmp_path, maxRowsPerTask=10)
    write_available(stream, f"{tmp_path}/out")
    assert read_back(spark, tmp_path) == sorted(map(str, range(25)))


def test_unsplittable_is_read_as_one(spark, tmp_path):
    put(tmp_path, "a", "x")
    put(tmp_path, "b", "y")
    with pytest.raises(Exception, match="cannot split"):
        write_available(lines(spark, tmp_path, unsplittable="yes"), f"{tmp_path}/failed")
    write_available(lines(spark, tmp_path, unsplittable="yes", unsplit="true"), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted((r.value, r.split) for r in rows) == [("x", "whole"), ("y", "whole")]


def test_options_reach_the_reader(spark, tmp_path):
    put(tmp_path, "a", "x")
    write_available(lines(spark, tmp_path, suffix="!"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/rows").first().suffix == "!"


def test_commit_follows_a_durable_batch(spark, tmp_path):
    put(tmp_path, "a", "0 1 2")
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    put(tmp_path, "a", "3 4")
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    assert read_back(spark, tmp_path) == ["0", "1", "2", "3", "4"]
    commits = [json.loads(line) for line in open(f"{tmp_path}/commits")]
    assert {"a": 3} in commits


def test_closed_after_an_error(spark, tmp_path):
    put(tmp_path, "a", "x")
    with pytest.raises(Exception, match="watermark explosion"):
        write_available(lines(spark, tmp_path, failing="yes"), f"{tmp_path}/out")
    assert os.path.exists(f"{tmp_path}/closed")


def test_idle_source_runs_no_batch(spark, tmp_path):
    put(tmp_path, "a", "x")
    write_available(lines(spark, tmp_path), f"{tmp_path}/out")
    before = len(glob.glob(f"{tmp_path}/out/checkpoint/commits/[0-9]*"))
    query = (
        lines(spark, tmp_path).writeStream.format("parquet").option("path", f"{tmp_path}/out/rows")
        .option("checkpointLocation", f"{tmp_path}/out/checkpoint").trigger(processingTime="200 milliseconds").start()
    )
    try:
        query.awaitTermination(3)
        assert query.isActive and query.exception() is None
    finally:
        query.stop()
    assert len(glob.glob(f"{tmp_path}/out/checkpoint/commits/[0-9]*")) == before


def test_batch_read(spark, tmp_path):
    put(tmp_path, "a", "x y")
    spark.dataSource.register(LinesSource)
    got = spark.read.format("lines").option("path", str(tmp_path)).load()
    assert sorted(r.value for r in got.collect()) == ["x", "y"]


def test_counting_and_empty(spark):
    spark.dataSource.register(CountingSource)
    spark.dataSource.register(EmptySource)
    got = spark.read.format("counting_source").option("maxCount", 11).option("numSplits", 3).load()
    assert sorted(r.value for r in got.collect()) == list(range(11))
    assert [r.value for r in got.filter("terminal").collect()] == [10]
    assert spark.read.format("empty_source").load().collect() == []


def test_backlog():
    source = CountingSource({"maxCount": "10", "numSplits": "2"})
    assert source.backlog_bytes("1", 2) == 24
    assert EmptySource({}).backlog_bytes("x", 0) == -1


def test_parquet_ranges_cross_row_groups(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    table = pa.table({"a": list(range(100)), "b": ["x"] * 100})
    pq.write_table(table, f"{tmp_path}/f.parquet", row_group_size=30)
    source = ParquetRowsSource({"path": str(tmp_path)})
    (split,) = source.splits()
    assert source.latest(split) == 100
    schema = StructType([StructField("a", LongType())])
    for start, end in ((0, 100), (25, 65), (90, 91), (60, 60)):
        batches = list(source.read_range(schema, split, start, end))
        assert [v for b in batches for v in b.column("a").to_pylist()] == list(range(start, end))
        assert all(b.schema.names == ["a"] for b in batches)


def test_failing_listing_in_mid_stream_repeats_nothing(tmp_path):
    """The error fails the batch, and a read cannot change between split and unsplit."""
    from tidewatch.sources.split_source import _BatchReader, _StreamReader

    class Shaky(CountingSource):
        broken = False

        def splits(self):
            if self.broken:
                raise RuntimeError("no listing")
            return super().splits()

        def latest(self, split):
            return 7 if split == "whole" else super().latest(split)

    source = Shaky({"maxCount": "10", "numSplits": "2"})
    reader = _StreamReader(source, None)
    start = reader.initialOffset()
    assert sorted(start) == ["0", "1"]
    source.broken = True
    with pytest.raises(RuntimeError, match="no listing"):
        reader.latestOffset()
    assert [p.split for p in _BatchReader(source, None).partitions()] == ["whole"]
    unsplit = _StreamReader(Shaky({"maxCount": "10", "unsplit": "true"}), None)
    assert unsplit.initialOffset() == {"whole": 0} and unsplit.latestOffset() == {"whole": 7}
    with pytest.raises(RuntimeError, match="unsplit"):
        reader.partitions({"whole": 3}, start)
