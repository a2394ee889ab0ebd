"""The derived tables and queries follow the events, whatever their span and ids."""

import glob
import shutil

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.check import differences

NAMES = (
    "watch_new_outputs watch_growth watch_stop_at watch_reported_watermark watch_normalize watch_bounded_seen "
    "watch_incremental watch_log_stream watch_live_stream watch_files_stream source_resume source_watermark_resume "
    "source_dedup_stream source_read_metrics source_terminal_stream source_offset_dedup_stream "
    "source_merged_watermark source_merged_watermark_stream source_backlog_stream"
).split()
#: All queries over the poll log; those of the live watch take several ticks.
POLL_LOG = [name for name in queries() if name.startswith(("watch_", "term_"))]


def write_events(spark, folder, rows):
    made = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    made = made.withColumn("ts", made["ts"].cast("timestamp_ntz")).coalesce(1)
    made.write.parquet(f"{folder}/parts")
    shutil.copy(glob.glob(f"{folder}/parts/*.parquet")[0], f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def wide_events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(i, f"2024-01-{i % 9 + 1:02d} 0{i % 9}:00:00", i % 7, "click" if i % 3 else "view", float(i), "{}") for i in range(1, 41)]
    rows += [((1 << 41) + 1, "2024-03-02 01:00:00", 99, "click", 1.0, "{}"), ((1 << 42) + 1, "2024-04-20 01:00:00", 98, "view", 2.0, "{}")]
    return write_events(spark, folder, rows)


@pytest.fixture(scope="module")
def early_events(spark, tmp_path_factory):
    """One event before all others, and some without a time."""
    rows = [(i, f"2024-01-{i % 9 + 1:02d} 0{i % 9}:00:00", i % 7, ("click", "view", "error", "signup")[i % 4], float(i), '{"k": %d}' % (i % 5))
            for i in range(1, 41)]
    rows += [(41, "2023-12-20 05:00:00", 3, "view", 1.0, '{"k": 9}'), (42, None, 3, "click", 1.0, '{"k": 1}'), (43, None, 77, "view", 2.0, None)]
    return write_events(spark, str(tmp_path_factory.mktemp("early")), rows)


@pytest.fixture(scope="module")
def timeless_events(spark, tmp_path_factory):
    rows = [(i, None, i % 3, "click", 1.0, "{}") for i in range(5)]
    return write_events(spark, str(tmp_path_factory.mktemp("timeless")), rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, wide_events, name, monkeypatch):
    monkeypatch.setattr("tests.check.TABLES", ("events",))
    assert differences(queries()[name](spark, wide_events), wide_events, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", POLL_LOG)
def test_early_and_missing_times(spark, early_events, name, monkeypatch):
    monkeypatch.setattr("tests.check.TABLES", ("events",))
    assert differences(queries()[name](spark, early_events), early_events, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["watch_new_outputs", "watch_incremental", "watch_files_stream"])
def test_no_event_has_a_time(spark, timeless_events, name, monkeypatch):
    monkeypatch.setattr("tests.check.TABLES", ("events",))
    assert differences(queries()[name](spark, timeless_events), timeless_events, oracle_sql()[name]) is None
