"""The plans that must hold at scale: pruned scans, map-side combine, no nested loops."""

import contextlib
import io
import re

import pytest

from tidewatch.operators import records as ops
from tidewatch.operators.first_seen import first_in_poll, first_seen, not_seen_before
from tidewatch.operators.polls import with_discovery_time
from tidewatch.plans import source_queries, tables, watch_queries


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted({**watch_queries.QUERIES, **source_queries.QUERIES}))
def test_no_nested_loops(spark, sf_dir, no_broadcast, name):
    text = plan({**watch_queries.QUERIES, **source_queries.QUERIES}[name](spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_first_seen_is_one_shuffle_of_hash_aggregates(spark, sf_dir):
    for df in (first_seen(tables.poll_outputs(tables.events(spark, sf_dir))), first_in_poll(tables.poll_outputs(tables.events(spark, sf_dir)))):
        text = plan(df)
        assert text.count("Exchange") == 1
        assert "partial_min" in text and "SortAggregate" not in text and "Window" not in text
        assert "props" not in text.split("ReadSchema")[1]


def test_history_is_cut_down_by_a_semi_join(spark, sf_dir):
    outputs = first_seen(tables.poll_outputs(tables.events(spark, sf_dir)))
    text = plan(not_seen_before(outputs.filter("poll_no > 7"), outputs.filter("poll_no <= 7")))
    assert "LeftSemi" in text and "LeftAnti" in text


def test_running_watermark_never_windows_a_whole_split(spark, sf_dir):
    text = plan(ops.monotone_watermark(tables.records_of(tables.events(spark, sf_dir))))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", text)
    by_split_only = [w for w in windows if "_block" not in w]
    assert len(windows) == 3 and len(by_split_only) == 1  # the last level, over a table of blocks


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    text = plan(ops.split_counts(tables.records_of(tables.events(spark, sf_dir))))
    assert "value" not in text.split("ReadSchema")[1] and "props" not in text
    text = plan(tables.records_of(tables.events(spark, sf_dir)).filter("terminal").select("arrival_no"))
    assert "GreaterThan(value,200.0)" in text and "EqualTo(event_type,purchase)" in text


def test_records_are_not_shuffled_on_the_split(spark, sf_dir):
    """With the threshold between the small tables and the records, only the small side moves."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        records = tables.records_of(tables.events(spark, sf_dir))
        saved, polls = tables.checkpoints(records), tables.polls(tables.events(spark, sf_dir))
        outputs = tables.poll_outputs(tables.events(spark, sf_dir))
        for df in (
            ops.resume(records, saved), ops.until_terminal(records), with_discovery_time(outputs, polls),
            ops.with_checkpoint(records, saved),
        ):
            text = plan(df)
            assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dedup_by_id_is_one_shuffle(spark, sf_dir):
    text = plan(ops.dedup_by_id(tables.records_of(tables.events(spark, sf_dir))))
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
