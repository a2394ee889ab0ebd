"""Small literal cases of reading split sources."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import records as ops

T = datetime(2024, 1, 1)
RECORDS = (
    "source_id string, split_id int, arrival_no bigint, off bigint, record_id string, value string, "
    "event_ts timestamp_ntz, source_wm timestamp_ntz, terminal boolean"
)
CHECKPOINTS = "source_id string, split_id int, off bigint, watermark timestamp_ntz"


def at(seconds):
    return None if seconds is None else T + timedelta(seconds=seconds)


def records(spark, rows):
    """Rows of (arrival_no, off, value, watermark second, terminal) in one split."""
    full = [("s", 0, a, o, f"r{o}", v, None, at(w), t) for a, o, v, w, t in rows]
    return spark.createDataFrame(full, RECORDS)


def plain(spark, values, first=0):
    return records(spark, [(i, i, v, i, False) for i, v in enumerate(values, first)])


def checkpoint(spark, off, wm=None):
    return spark.createDataFrame([("s", 0, off, at(wm))], CHECKPOINTS)


def vals(df):
    return [r.value for r in df.orderBy("arrival_no").collect()]


def test_regressing_watermark(spark):
    df = records(spark, [(0, 0, "a", 10, False), (1, 1, "b", 42, False), (2, 2, "c", 5, False)])
    assert [r.watermark for r in ops.monotone_watermark(df).orderBy("off").collect()] == [at(10), at(42), at(42)]


def test_regressing_watermark_in_tiny_blocks(spark):
    df = records(spark, [(i, i, "x", (i * 7) % 11, False) for i in range(40)])
    got = [r.watermark for r in ops.monotone_watermark(df, block_bits=1).orderBy("off").collect()]
    assert got == [at(max((j * 7) % 11 for j in range(i + 1))) for i in range(40)]


def test_no_regression_across_resume(spark):
    df = records(spark, [(i, i, v, w, False) for i, (v, w) in enumerate(zip("abcde", (10, 20, 15, 12, 50)))])
    got = ops.resume_watermark(df, checkpoint(spark, 2, 20)).orderBy("off").collect()
    assert [(r.value, r.watermark) for r in got] == [("d", at(20)), ("e", at(50))]


def test_resume(spark):
    df = plain(spark, ["0", "1", "2", "3", "4"])
    assert vals(ops.resume(df, checkpoint(spark, 4))) == []
    assert vals(ops.resume(plain(spark, [str(i) for i in range(7)]), checkpoint(spark, 4))) == ["5", "6"]
    assert vals(ops.resume(df, spark.createDataFrame([], CHECKPOINTS))) == ["0", "1", "2", "3", "4"]


def test_terminal_record_is_the_last(spark):
    df = records(spark, [(0, 0, "0", 1, False), (1, 1, "1", 2, True), (2, 2, "2", 3, False), (3, 3, "3", 4, True)])
    assert vals(ops.until_terminal(df)) == ["0", "1"]
    assert vals(ops.until_terminal(plain(spark, ["a", "b"]))) == ["a", "b"]


def test_record_ids_only_where_asked_for(spark):
    df = plain(spark, ["a", "b"], first=1)
    assert [r.record_id for r in ops.tag_record_ids(df, F.lit(True)).orderBy("off").collect()] == ["r1", "r2"]
    assert {r.record_id for r in ops.tag_record_ids(df, F.lit(False)).collect()} == {None}


def test_dedup_by_id_keeps_untagged(spark):
    df = records(spark, [(0, 0, "a", 1, False), (1, 1, "b", 1, False), (2, 0, "a again", 1, False)])
    assert vals(ops.dedup_by_id(df)) == ["a", "b"]
    untagged = ops.tag_record_ids(df, F.lit(False))
    assert vals(ops.dedup_by_id(untagged)) == ["a", "b", "a again"]


def test_dedup_by_offset(spark):
    df = records(spark, [(0, 0, "a", 1, False), (1, 2, "c", 1, False), (2, 1, "b", 1, False), (3, 3, "d", 1, False), (4, 3, "d2", 1, False)])
    for bits in (1, 16):
        assert vals(ops.dedup_by_offset(df, bits)) == ["a", "c", "d"]


def test_event_time_defaults_to_the_epoch(spark):
    got = ops.with_event_time(plain(spark, ["a"])).first()
    assert got.event_ts == datetime(1970, 1, 1)


def test_backlog(spark):
    df = plain(spark, [str(i) for i in range(12)])
    size = F.octet_length("record_id")
    assert ops.backlog_bytes(df, checkpoint(spark, 8), size).first().backlog_bytes == 2 + 3 + 3
    assert ops.backlog_bytes(df, checkpoint(spark, 11), size).first().backlog_bytes == 0
    assert ops.backlog_bytes(df, checkpoint(spark, 8), F.lit(None).cast("int")).first().backlog_bytes == -1


def test_progress(spark):
    df = records(spark, [(0, 0, "a", 1, False), (1, 1, "b", 2, True), (2, 2, "c", 2, False)])
    assert tuple(ops.progress(df, checkpoint(spark, 0)).first())[2:] == (1,)
    assert tuple(ops.progress(df, checkpoint(spark, 1)).first())[2:] == (2,)


def test_counting(spark):
    got = ops.counting_source(spark, 10).orderBy("value").collect()
    assert [r.value for r in got] == list(range(10))
    assert [r.event_ts for r in got] == [datetime(1970, 1, 1) + timedelta(seconds=i) for i in range(10)]
    assert [r.terminal for r in got] == [False] * 9 + [True]


def test_empty(spark):
    df = plain(spark, ["a"])
    empty = ops.empty_source(spark, df.schema)
    assert empty.collect() == [] and empty.schema == df.schema
    assert vals(ops.union_sources({"x": df, "e": empty})) == ["a"]
