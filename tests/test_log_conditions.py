"""Conditions with a state of their own over a log, offsets on a stream, and polled folders."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch import StatefulTermination, Watch, after_iterations, either_of
from tidewatch.operators.polls import with_stop_flags
from tidewatch.streaming import files, splits, ticks
from tidewatch.streaming.run import stream_session

T = datetime(2024, 1, 1)


class Quiet(StatefulTermination):
    """Stop after so many polls in a row without new outputs; the state is a list, as JSON has it."""

    def __init__(self, n):
        self.n, self.name = n, f"quiet {n}"

    def for_new_input(self, now, seed):
        return [0, now.isoformat(), seed]

    def on_seen_new_output(self, now, state):
        return [-1, *state[1:]]

    def on_poll_complete(self, state):
        return [state[0] + 1, *state[1:]]

    def can_stop_polling(self, now, state):
        return state[0] >= self.n


def test_flags_same_as_model(spark):
    rng = random.Random(8)
    state = [(seed, p, T, T + timedelta(hours=p), rng.choice([0, 0, 1, 5])) for seed in ("a", "b", "hot", None) for p in range(1, 400 if seed == "hot" else 30)]
    rng.shuffle(state)
    df = spark.createDataFrame(state, "seed string, poll_no int, start_ts timestamp_ntz, poll_ts timestamp_ntz, n_new bigint")
    got = {(r.seed, r.poll_no): r.stop_flags for r in with_stop_flags(df.repartition(5), [Quiet(2), Quiet(4)]).collect()}
    want, quiet = {}, {}
    for seed, poll_no, _, _, n_new in sorted(state, key=lambda r: (r[0] or "", r[1])):
        quiet[seed] = 0 if n_new else quiet.get(seed, 0) + 1
        want[seed, poll_no] = {f"quiet {n}": quiet[seed] >= n for n in (2, 4)}
    assert got == want
    assert with_stop_flags(df, []) is df


def test_log_stops_where_the_live_watch_does(spark, tmp_path):
    listed = [("s", 1, 0, 1), ("s", 2, 0, 1), ("s", 3, 0, 2), ("s", 4, 0, 2), ("s", 5, 0, 1), ("s", 6, 0, 9), ("t", 2, 0, 5), ("t", 6, 0, 6)]
    stop = either_of(Quiet(2), after_iterations(6))
    outputs = spark.createDataFrame([(*row, None) for row in listed], "seed string, poll_no int, pos bigint, value int, event_ts timestamp_ntz")
    seeds = spark.createDataFrame([("s", T, None), ("t", T, None)], "seed string, added_at timestamp_ntz, event_ts timestamp_ntz")
    polls = spark.createDataFrame(
        [(s, p, T + timedelta(minutes=p), None, False) for s in ("s", "t") for p in range(1, 7)],
        "seed string, poll_no int, poll_ts timestamp_ntz, watermark timestamp_ntz, complete boolean")
    spec = Watch.growth_of().with_termination_per_input(stop).with_max_completed_size(None)
    result = spec.over_log(seeds, polls, outputs)
    over_log = sorted((r.seed, r.poll_no, r.value) for r in result.outputs.collect())

    def poll(watched, poll_no, poll_ts):
        rows = outputs.filter(F.col("poll_no") == poll_no).drop("poll_no").join(watched.select("seed"), "seed")
        return rows.select("*", F.lit(None).cast("timestamp_ntz").alias("watermark"), F.lit(False).alias("complete"))

    live = Watch.growth_of(poll).with_termination_per_input(stop).with_max_completed_size(None)
    watch = ticks.Ticks(spark, live, lambda s: seeds, str(tmp_path), lambda p: T + timedelta(minutes=p))
    for poll_no in range(1, 7):
        watch.tick(poll_no)
    watch.close()
    assert over_log == sorted((r.seed, r.poll_no, r.value) for r in watch.emitted().collect())
    assert over_log == [("s", 1, 1), ("s", 3, 2), ("t", 2, 5)]
    done = {r.seed: r.poll_no for r in result.progress.filter("done").collect()}
    assert done == {"s": 5, "t": 4}


def test_offsets_over_batches(spark, tmp_path):
    """Repeats within a batch and of an earlier one are left out; their watermark counts."""
    schema = "source_id string, split_id int, arrival_no bigint, off bigint, source_wm timestamp_ntz, terminal boolean"
    day = lambda d: datetime(2024, 1, d)
    waves = (
        [("s", 0, 1, 5, day(1), None), ("s", 0, 2, 5, day(9), None), ("s", 0, 3, 6, day(2), None), ("s", 1, 1, 7, None, True)],
        [("s", 0, 4, 6, day(10), None), ("s", 0, 5, 3, None, None), ("s", 0, 6, 8, day(3), None), ("s", 1, 2, 9, day(1), None)],
    )
    session = stream_session(spark)
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session.readStream.schema(schema).parquet(f"{tmp_path}/in")
        splits.follow(stream, f"{tmp_path}/read", drop_repeats=True)
    got = splits.emitted(spark, f"{tmp_path}/read", stream.schema).collect()
    assert sorted((r.split_id, r.arrival_no, r.off, r.watermark) for r in got) == [
        (0, 1, 5, day(1)), (0, 3, 6, day(9)), (0, 6, 8, day(10)), (1, 1, 7, None)]


def test_folders_that_appear_later(spark, tmp_path):
    there, later = tmp_path / "a", tmp_path / "b"
    there.mkdir()
    (there / "x.csv").write_text("x")
    (there / "skip.txt").write_text("x")
    seeds = spark.createDataFrame([(str(there), None, None), (str(later), None, None)], "seed string, added_at timestamp_ntz, event_ts timestamp_ntz")
    spec = Watch.growth_of(files.folder_poll("*.csv")).with_max_completed_size(None).with_termination_per_input(after_iterations(2))
    found = []
    for poll_no in (1, 2):
        watch = ticks.Ticks(spark, spec, lambda s: seeds, str(tmp_path / "watch"), lambda p: T + timedelta(minutes=p))
        watch.tick(poll_no)
        watch.close()
        os.makedirs(later / "deep", exist_ok=True)
        (later / "deep" / "y.csv").write_text("y")
    found = sorted((r.poll_no, os.path.basename(r.value), r.discovered_ts) for r in watch.emitted().collect())
    assert found == [(1, "x.csv", T + timedelta(minutes=1)), (2, "y.csv", T + timedelta(minutes=2))]
    assert not watch.active(2)
