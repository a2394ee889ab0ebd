"""Steps over a growing poll log: repeated steps, restarts, and streams with hot keys."""

import random
from datetime import datetime

import pytest

from tidewatch.operators.first_seen import first_seen
from tidewatch.streaming import dedup, splits
from tidewatch.streaming.files import new_files
from tidewatch.streaming.increments import extend, follow, found
from tidewatch.streaming.run import stream_session, write_available

OUTPUTS = "seed string, poll_no int, pos int, value int, event_ts timestamp_ntz"


def make_log(spark, polls, seed=11):
    rng = random.Random(seed)
    rows = [
        (s, p, pos, 7 if rng.random() < 0.4 else rng.randrange(30), None)
        for s in ("a", "b") for p in polls for pos in range(20)
    ]
    return spark.createDataFrame(rows, OUTPUTS)


def test_repeated_steps(spark, tmp_path):
    log = make_log(spark, range(1, 7))
    want = sorted(first_seen(log).collect())
    for after, upto in ((0, 2), (0, 2), (2, 3), (3, 6), (2, 3), (3, 6)):
        got = extend(log, str(tmp_path), after, upto)
    assert sorted(got.collect()) == want
    assert sorted(found(log, str(tmp_path), 2).collect()) == sorted(first_seen(log.filter("poll_no <= 2")).collect())


def test_overlapping_steps_are_refused(spark, tmp_path):
    log = make_log(spark, range(1, 7))
    extend(log, str(tmp_path), 0, 3)
    for after, upto in ((0, 5), (2, 5), (0, 2), (3, 3)):
        with pytest.raises(ValueError):
            extend(log, str(tmp_path), after, upto)
    got = extend(log, str(tmp_path), 3, 6)
    assert sorted(got.collect()) == sorted(first_seen(log).collect())


def test_late_first_delivery_is_kept(spark, tmp_path):
    session = stream_session(spark)
    schema = "source_id string, record_id string, arrival_no bigint, event_ts timestamp_ntz"
    waves = ([("s", "r1", 1, datetime(2024, 6, 1))], [("s", "r2", 2, datetime(2024, 1, 1)), ("s", "r1", 3, datetime(2024, 6, 1))])
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(schema).parquet(f"{tmp_path}/in")
        write_available(dedup.first_of_ids(stream, ["source_id", "record_id"], "arrival_no"), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted((r.record_id, r.arrival_no) for r in got) == [("r1", 1), ("r2", 2)]


def test_splits_end_and_carry_their_watermark_over_batches(spark, tmp_path):
    schema = "source_id string, split_id int, arrival_no bigint, off bigint, source_wm timestamp_ntz, terminal boolean"
    day = lambda d: datetime(2024, 1, d)
    waves = (
        [("s", 0, 1, 1, day(5), False), ("s", 0, 2, 2, day(3), False), ("s", 1, 1, 1, None, True), ("s", 1, 2, 2, day(9), False)],
        [],
        [("s", 0, 3, 3, day(4), False), ("s", 0, 4, 4, day(8), True), ("s", 0, 5, 5, day(9), False), ("s", 1, 3, 3, day(9), False)],
        [("s", 0, 6, 6, day(9), False)],
    )
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        splits.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/read")
    got = splits.emitted(spark, f"{tmp_path}/read", spark.createDataFrame([], schema).schema).collect()
    found = sorted((r.split_id, r.arrival_no, r.watermark) for r in got)
    assert found == [(0, 1, day(5)), (0, 2, day(5)), (0, 3, day(5)), (0, 4, day(8)), (1, 1, None)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    log = make_log(spark, range(1, 7))
    for first, last in ((1, 2), (3, 3), (4, 6)):
        log.filter(f"poll_no between {first} and {last}").write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        follow(stream, f"{tmp_path}/watch").awaitTermination()
        follow(stream, f"{tmp_path}/watch").awaitTermination()
    assert sorted(found(log, f"{tmp_path}/watch").collect()) == sorted(first_seen(log).collect())


def test_streaming_dedup_remembers_over_restarts(spark, tmp_path):
    session = stream_session(spark)
    log = make_log(spark, range(1, 5))
    for first, last in ((1, 2), (3, 4)):
        log.filter(f"poll_no between {first} and {last}").write.mode("append").parquet(f"{tmp_path}/log")
        stream = session.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        write_available(dedup.first_of_keys(stream, ["seed", "value"], "pos"), f"{tmp_path}/out")
    got = sorted(spark.read.parquet(f"{tmp_path}/out/rows").select("seed", "value").collect())
    assert got == sorted(log.select("seed", "value").distinct().collect())


def test_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for wave in (["a.csv", "b.csv"], [], ["c.csv", "skipped.txt"]):
        for name in wave:
            (tmp_path / "in" / name).write_text(name)
        write_available(new_files(spark, str(tmp_path / "in"), "*.csv"), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted(r.value.rsplit("/", 1)[1] for r in rows) == ["a.csv", "b.csv", "c.csv"]
    assert {r.length for r in rows} == {5}


def test_stream_session_leaves_settings_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session = stream_session(spark)
    assert session.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
