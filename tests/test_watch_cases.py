"""Small literal cases of the watch semantics."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch import Watch, after_iterations
from tidewatch.functions.keys import canonical_key, key_digest
from tidewatch.functions.times import END_OF_TIME
from tidewatch.operators.first_seen import first_in_poll, first_seen, not_seen_before
from tidewatch.operators.polls import explode_results, normalize, with_discovery_time, with_emit_order

T = datetime(2024, 1, 1)
OUTPUTS = "seed string, poll_no int, pos int, value string, event_ts timestamp_ntz"
POLLS = "seed string, poll_no int, poll_ts timestamp_ntz, watermark timestamp_ntz, complete boolean"
SEEDS = "seed string, added_at timestamp_ntz, event_ts timestamp_ntz"


def at(seconds):
    return None if seconds is None else T + timedelta(seconds=seconds)


def log(spark, polls, seed="s", seed_ts=None):
    """Tables from a list of (now, outputs, watermark, complete); an output is a value or (seconds, value)."""
    outputs, heads = [], []
    for no, (now, items, wm, complete) in enumerate(polls, 1):
        heads.append((seed, no, at(now), at(wm), complete))
        for pos, item in enumerate(items):
            ts, value = item if isinstance(item, tuple) else (None, item)
            outputs.append((seed, no, pos, value, at(ts)))
    return (
        spark.createDataFrame([(seed, T, at(seed_ts))], SEEDS),
        spark.createDataFrame(heads, POLLS),
        spark.createDataFrame(outputs, OUTPUTS),
    )


def watch(tables, condition=None):
    spec = Watch.growth_of().with_max_completed_size(None)
    if condition is not None:
        spec = spec.with_termination_per_input(condition)
    return spec.over_log(*tables)


def values(df):
    return sorted((r.poll_no, r.value) for r in df.select("poll_no", "value").collect())


def progress(result):
    rows = result.progress.orderBy("poll_no").collect()
    return [(r.poll_no, r.n_new, None if r.watermark is None else (r.watermark - T).total_seconds(), r.done) for r in rows]


def test_end_to_end(spark):
    result = watch(log(spark, [(1, ["1", "1", "2"], None, True), (2, ["3"], None, False)]))
    assert values(result.outputs) == [(1, "1"), (1, "2")]
    assert progress(result) == [(1, 2, None, True)]


def test_snapshots_emit_once(spark):
    result = watch(log(spark, [(1, ["a"], None, False), (2, ["a", "b"], None, False), (3, ["b", "c", "a"], None, False)]))
    assert values(result.outputs) == [(1, "a"), (2, "b"), (3, "c")]


def test_first_by_position_wins_over_earlier_time(spark):
    _, polls, outputs = log(spark, [(1, [(30, "x"), (10, "x"), (20, "y")], None, False)])
    kept = with_discovery_time(first_in_poll(outputs), polls)
    got = {(r.value, r.pos, r.discovered_ts) for r in kept.collect()}
    assert got == {("x", 0, at(30)), ("y", 2, at(20))}


def test_emit_order_by_time_then_position(spark):
    _, polls, outputs = log(spark, [(1, [(30, "c"), (10, "a"), (20, "b"), (10, "d")], None, False)])
    ordered = with_emit_order(with_discovery_time(first_seen(outputs), polls))
    assert [r.value for r in ordered.orderBy("emit_no").collect()] == ["a", "d", "b", "c"]
    assert [r.emit_no for r in ordered.orderBy("emit_no").collect()] == [1, 2, 3, 4]


def test_dedup_is_per_seed(spark):
    _, _, a = log(spark, [(1, ["x"], None, False)], seed="a")
    _, _, b = log(spark, [(1, ["x"], None, False)], seed="b")
    assert first_seen(a.union(b)).count() == 2


def test_null_values_are_a_key(spark):
    rows = [("s", 1, 0, None, None), ("s", 1, 1, None, None), ("s", 2, 0, None, None), ("s", 2, 1, "v", None)]
    outputs = spark.createDataFrame(rows, OUTPUTS)
    assert first_seen(outputs).count() == 2
    seen = outputs.filter("poll_no = 1").select("seed", "value").distinct()
    fresh = not_seen_before(first_in_poll(outputs.filter("poll_no = 2")), seen)
    assert [r.value for r in fresh.collect()] == ["v"]


def test_order_of_large_numbers(spark):
    wide = OUTPUTS.replace("pos int", "pos bigint").replace("poll_no int", "poll_no bigint")
    rows = [("s", 9_000_000, 1 << 62, "a", None), ("s", 9_000_001, -(1 << 62), "a", None), ("s", 1 << 61, 0, "b", None)]
    got = sorted((r.poll_no, r.pos, r.value) for r in first_seen(spark.createDataFrame(rows, wide)).collect())
    assert got == [(9_000_000, 1 << 62, "a"), (1 << 61, 0, "b")]


def test_output_without_its_poll_is_an_error(spark):
    import pytest
    from pyspark.errors import PySparkException

    seeds, polls, outputs = log(spark, [(1, ["a"], None, False), (2, ["b"], None, False)])
    for lost in (with_discovery_time(outputs, polls.filter("poll_no = 1")), normalize(polls.filter("poll_no = 1"), outputs)):
        with pytest.raises(PySparkException, match="no row in polls"):
            lost.collect()


def test_digest_does_not_depend_on_the_zone_or_the_sign_of_zero(spark):
    from tidewatch.functions.keys import key_digest, with_one_zero

    df = spark.sql("select timestamp'2024-01-01 00:00:00Z' as t, named_struct('x', array(1.5D, null)) as n, null as z")
    found = set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.add(df.select(key_digest("t"), key_digest("n"), key_digest("z")).first())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == 1
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double")
    assert with_one_zero(zeros, ["v"]).select(key_digest("v")).distinct().count() == 1


def test_empty_poll_counts_but_moves_no_watermark(spark):
    polls = [(1, [(5, "a")], None, False), (2, [], None, False), (3, [(9, "b")], None, False)]
    result = watch(log(spark, polls), after_iterations(3))
    assert progress(result) == [(1, 1, 5, False), (2, 0, 5, False), (3, 1, 5, True)]


def test_watermark_never_falls(spark):
    polls = [(1, ["a"], 100, False), (2, ["b"], 50, False), (3, ["c"], 120, False)]
    assert progress(watch(log(spark, polls))) == [(1, 1, 100, False), (2, 1, 100, False), (3, 1, 120, False)]


def test_watermark_of_a_poll_is_its_earliest_new_output(spark):
    polls = [(50, [(40, "b"), (30, "a")], None, False), (60, [(10, "a"), "c"], None, False)]
    assert progress(watch(log(spark, polls))) == [(1, 2, 30, False), (2, 1, 60, False)]


def test_seed_time_is_the_first_watermark(spark):
    polls = [(1, [], None, False), (2, [(10, "a")], None, False), (3, [(50, "b")], None, False)]
    result = watch(log(spark, polls, seed_ts=42))
    assert progress(result) == [(1, 0, 42, False), (2, 1, 42, False), (3, 1, 50, False)]


def test_watermark_at_the_end_of_time_stops(spark):
    seeds, polls, outputs = log(spark, [(1, ["a"], None, False), (2, ["b"], None, False), (3, ["c"], None, False)])
    ending = F.when(F.col("poll_no") == 2, F.lit(END_OF_TIME).cast("timestamp_ntz"))
    result = watch((seeds, polls.withColumn("watermark", ending), outputs))
    assert values(result.outputs) == [(1, "a"), (2, "b")]
    assert [p[3] for p in progress(result)] == [False, True]


def test_stopping_poll_is_emitted(spark):
    polls = [(i, [f"v{i}"], None, False) for i in range(1, 6)]
    assert values(watch(log(spark, polls), after_iterations(2)).outputs) == [(1, "v1"), (2, "v2")]


def test_missing_arrival_counts_from_the_first_poll(spark):
    from tidewatch import after_total_of

    seeds, polls, outputs = log(spark, [(10, ["a"], None, False), (15, ["b"], None, False), (16, ["c"], None, False), (17, ["d"], None, False)])
    seeds = seeds.withColumn("added_at", F.lit(None).cast("timestamp_ntz"))
    assert values(watch((seeds, polls, outputs), after_total_of(5)).outputs) == [(1, "a"), (2, "b"), (3, "c")]


def test_key_function(spark):
    tables = log(spark, [(1, ['{"id": 1, "n": 1}', '{"id": 1, "n": 2}'], None, False)])
    spec = Watch.growth_of(output_key=lambda v: F.get_json_object(v, "$.id")).with_max_completed_size(None)
    assert [r.pos for r in spec.over_log(*tables).outputs.collect()] == [0]


def test_normalize_keeps_empty_polls(spark):
    _, polls, outputs = log(spark, [(1, ["a", "b"], 7, False), (2, [], None, False), (3, [], 9, True)])
    got = sorted((r.poll_no, r.value or "", r.done, r.watermark) for r in normalize(polls, outputs).collect())
    assert got == [(1, "a", False, at(7)), (1, "b", False, at(7)), (2, "", False, None), (3, "", True, None)]


def test_nested_results(spark):
    schema = (
        "seed string, poll_no int, poll_ts timestamp_ntz, "
        "outputs array<struct<value: string, event_ts: timestamp_ntz>>, watermark timestamp_ntz, complete boolean"
    )
    results = spark.createDataFrame(
        [("s", 1, T, [("a", None), ("b", at(3))], None, False), ("s", 2, T, [], None, True)], schema
    )
    got = sorted((r.poll_no, r.pos, r.value, r.done) for r in explode_results(results).collect())
    assert got == [(1, 0, "a", False), (1, 1, "b", False), (2, None, None, True)]


def test_digest(spark):
    rows = spark.createDataFrame(
        [("a", "bc", T), ("ab", "c", T), ("a", None, T), (None, "a", T), ("a", "bc", T + timedelta(microseconds=1))],
        "x string, y string, t timestamp_ntz",
    )
    digests = [r[0] for r in rows.select(key_digest("x", "y", "t")).collect()]
    assert len(set(digests)) == 5 and all(len(d) == 32 for d in digests)
    nested = spark.sql("select map('k', array('v', '1')) as value").select(canonical_key("value")).first()[0]
    assert nested == '{"k0":{"k":["v","1"]}}'
