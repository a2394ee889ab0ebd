"""Keys seen before: constant work per step, replays, restarts; and first deliveries on a stream."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from tidewatch.operators.polls import normalize, with_discovery_time
from tidewatch.streaming import dedup
from tidewatch.streaming.increments import extend, found, seen_keys
from tidewatch.streaming.run import drained, stream_session, write_available
from tidewatch.streaming.seen import SeenKeys

ROWS = "seed string, key_hash string, value bigint"


def listing(spark, step, size=30):
    """``size`` keys a step, a third of them listed before; one seed holds most of them."""
    start = step * size * 2 // 3
    return spark.range(start, start + size, 1, 2).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("seed"),
        F.md5(F.col("id").cast("string")).alias("key_hash"), F.col("id").alias("value"),
    )


def test_a_step_costs_the_same_however_many_came_before(spark, tmp_path):
    emitted = []
    with SeenKeys(spark, str(tmp_path)) as seen:
        for step in range(1, 9):
            new = seen.admit(listing(spark, step), step)
            assert len(new.inputFiles()) <= 8  # files of this step only
            emitted += [(step, r.value) for r in new.collect()]
        read = [p.numInputRows for p in seen._query.recentProgress if p.numInputRows]
    assert read == [30] * 8
    want, known = [], set()
    for step in range(1, 9):
        ids = range(step * 20, step * 20 + 30)
        want += [(step, i) for i in ids if i not in known]
        known |= set(ids)
    assert sorted(emitted) == want


def test_replays_and_restarts(spark, tmp_path):
    first = SeenKeys(spark, str(tmp_path))
    one = sorted(first.admit(listing(spark, 1), 1).collect())
    again = SeenKeys(spark, str(tmp_path))  # as after a crash: the first one was never closed
    assert sorted(again.admit(listing(spark, 7), 1).collect()) == one  # what the step gave then
    two = sorted(r.value for r in again.admit(listing(spark, 2), 2).collect())
    again.close()
    assert two == list(range(50, 70))
    with SeenKeys(spark, str(tmp_path)) as later:
        assert later.admit(listing(spark, 2).limit(0), 3).collect() == []
        assert sorted(r.value for r in later.admit(listing(spark, 2), 2).collect()) == two
        null = spark.createDataFrame([(None, None, 1), (None, "k", 2)], ROWS)
        assert later.admit(null, 4).count() == 2
        assert later.admit(null, 5).count() == 0
    first.close()


OUTPUTS = "seed string, poll_no bigint, pos bigint, value double, event_ts timestamp_ntz"


def test_steps_with_gaps_are_refused(spark, tmp_path):
    log = spark.createDataFrame([("s", p, 0, 1.0 if p > 7 else 0.0, None) for p in range(1, 22)], OUTPUTS)
    root = str(tmp_path)
    with seen_keys(spark, root) as seen:
        extend(log, root, 0, 7, seen=seen)
        for after, upto in ((14, 21), (6, 9), (8, 9), (0, 8)):
            with pytest.raises(ValueError):
                extend(log, root, after, upto, seen=seen)
        extend(log, root, 7, 14, seen=seen)
        extend(log, root, 14, 21, seen=seen)
    assert sorted((r.poll_no, r.value) for r in found(log, root).collect()) == [(1, 0.0), (8, 1.0)]


def test_a_step_that_did_not_end_must_be_repeated(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame([("s", p, 0, float(p % 2), None) for p in range(1, 5)], OUTPUTS)
    with monkeypatch.context() as broken:
        broken.setattr("tidewatch.streaming.increments._add_step", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            extend(log, str(tmp_path), 0, 2)
    with pytest.raises(ValueError):
        extend(log, str(tmp_path), 2, 4)
    extend(log, str(tmp_path), 0, 2)
    assert extend(log, str(tmp_path), 2, 4).count() == 2


def test_polls_beyond_an_int_and_one_zero(spark, tmp_path):
    base = 2**32
    log = spark.createDataFrame([("s", base + 1, 0, 0.0, None), ("s", base + 25, 0, -0.0, None), ("s", base + 26, 0, 2.0, None)], OUTPUTS)
    root = str(tmp_path)
    extend(log, root, 0, base + 20)
    assert sorted(r.poll_no for r in extend(log, root, base + 20, base + 40).collect()) == [base + 1, base + 26]


def test_first_delivery_of_every_id(spark, tmp_path):
    """Ids whose second delivery differs, in one micro-batch, a third of all rows of one id."""
    rng = random.Random(3)
    rows = [("s", f"r{i}", 1000 * copy + i, float(copy)) for i in range(200) for copy in (0, 1)]
    rows += [("s", "hot", 5000 + k, float(k)) for k in range(200)] + [("t", None, 9, 9.0), ("t", None, 8, 8.0)]
    rng.shuffle(rows)
    schema = "source_id string, record_id string, arrival_no bigint, value double"
    spark.createDataFrame(rows, schema).repartition(7).write.parquet(f"{tmp_path}/in")
    session = stream_session(spark)
    stream = session.readStream.schema(schema).parquet(f"{tmp_path}/in")
    once = dedup.first_of_ids(stream, ["source_id", "record_id"], "arrival_no")
    got = {(r.source_id, r.record_id): (r.arrival_no, r.value) for r in drained(spark, once, "first").collect()}
    want = {("s", f"r{i}"): (i, 0.0) for i in range(200)} | {("s", "hot"): (5000, 0.0), ("t", None): (8, 8.0)}
    assert got == want


def test_ids_are_handed_on_before_a_task_has_read_its_rows():
    batches, size, read, got = 40, 10_000, 0, 0

    def unique():
        nonlocal read
        for k in range(batches):
            read += size
            yield pa.RecordBatch.from_pydict({"id": pa.array(range(k * size, (k + 1) * size)), "no": pa.array([k] * size)})

    for batch in dedup._keep_first(["id"], ["no"], whole=False)(unique()):
        assert read - got <= dedup.HELD_ROWS + size
        got += batch.num_rows
    assert got == batches * size


def test_ids_meet_in_groups_that_spark_sorts(spark, tmp_path, capsys):
    """Not in all that a task reads, which Python would have to hold."""
    spark.range(2000).selectExpr("id % 500 as id", "id as no").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = stream_session(spark).readStream.schema("id bigint, no bigint").parquet(f"{tmp_path}/in")
    write_available(dedup.first_of_ids(stream, ["id"], "no"), f"{tmp_path}/out").explain()
    ran = capsys.readouterr().out
    assert sorted(spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [(i, i) for i in range(500)]
    above, _, below = ran.partition("FlatMapGroupsInArrow")
    assert "MapInArrow" not in above and "Sort" in below


def test_an_output_without_its_poll_is_an_error_whatever_is_read(spark):
    polls = spark.createDataFrame([("s", 1, None, None, False)], "seed string, poll_no int, poll_ts timestamp_ntz, watermark timestamp_ntz, complete boolean")
    outputs = spark.createDataFrame([("s", 2, 0, 1, None)], "seed string, poll_no int, pos int, value int, event_ts timestamp_ntz")
    for made in (with_discovery_time(outputs, polls), normalize(polls, outputs)):
        with pytest.raises(Exception, match="no row in polls"):
            made.count()
    assert "RaiseError" in plan(with_discovery_time(outputs, polls)) or "raise_error" in plan(with_discovery_time(outputs, polls))
