"""Polls side by side with a deadline, Arrow answers, and seeds that are asked at their own pace."""

import time
from datetime import datetime, timedelta
from threading import Event

import pyarrow as pa
import pytest

from tidewatch import PollResult, Timed, Watch, after_iterations, per_seed
from tidewatch.plans.poll import answer_batches
from tidewatch.plans.side_by_side import side_by_side
from tidewatch.streaming import ticks

T = datetime(2024, 1, 1)
SEEDS = "seed string, added_at timestamp_ntz, event_ts timestamp_ntz, poll_every interval day to second"
ARROW = pa.schema([
    ("seed", pa.string()), ("pos", pa.int64()), ("value", pa.string()), ("event_ts", pa.timestamp("us")),
    ("watermark", pa.timestamp("us")), ("complete", pa.bool_()),
])


def clock(poll_no):
    return T + timedelta(minutes=poll_no)


def rows_of(answer):
    return [row for batch in answer_batches("s", answer, ARROW) for row in batch.to_pylist()]


def test_answers_in_arrow_and_in_python_are_numbered_alike():
    times = pa.array([T, None], pa.timestamp("us"))
    table = pa.table({"value": ["c", "d"], "event_ts": times, "more": [1, 2]})
    mixed = ["a", pa.array(["b"]), table, Timed("e", T), pa.record_batch({"value": pa.array([], pa.string())}), pa.chunked_array([["f"], ["g"]])]
    found = rows_of(PollResult.of(mixed, T, True))
    assert [(r["pos"], r["value"], r["event_ts"]) for r in found[:-1]] == [
        (0, "a", None), (1, "b", None), (2, "c", T), (3, "d", None), (4, "e", T), (5, "f", None), (6, "g", None)
    ]
    assert (found[-1]["pos"], found[-1]["watermark"], found[-1]["complete"]) == (None, T, True)
    assert [r["value"] for r in rows_of(pa.array([1, 2]))] == ["1", "2", None]
    assert len(rows_of([])) == 1


@pytest.mark.parametrize("at_once", [1, 3, 50])
def test_every_call_is_made_once(at_once):
    names = [f"n{i}" for i in range(20)] + [None]
    found = list(side_by_side("once", iter(names), lambda n: iter([(n, k) for k in range(7)]), at_once, 30.0))
    assert sorted(found, key=str) == sorted([(n, k) for n in names for k in range(7)], key=str)
    assert list(side_by_side("none", iter([]), None, at_once, None)) == []


def test_a_late_call_holds_up_no_other_and_is_not_doubled():
    release, begun = Event(), []

    def work(name):
        begun.append(name)
        yield f"{name} first"
        if name == "slow":
            release.wait(60)
            yield "too late"

    start = time.monotonic()
    found = list(side_by_side("late", iter(["slow", "a", "b", "c"]), work, 2, 0.5))
    assert sorted(found) == ["a first", "b first", "c first", "slow first"]
    assert time.monotonic() - start < 30
    assert list(side_by_side("late", iter(["slow"]), work, 1, 5.0)) == []
    assert begun.count("slow") == 1
    release.set()
    end = time.monotonic() + 30
    again = []
    while not again and time.monotonic() < end:
        again = list(side_by_side("late", iter(["slow"]), work, 1, 5.0))
    assert again == ["slow first", "too late"]


def test_an_error_is_raised():
    def work(name):
        yield 1
        raise KeyError(name)

    with pytest.raises(KeyError):
        list(side_by_side("error", iter(["x"]), work, 2, 5.0))


def slow_first(seed):
    if seed.startswith("slow"):
        time.sleep(90)
    return PollResult.of([f"{seed} {i}" for i in range(3)], complete=seed.startswith("slow"))


def test_a_slow_seed_counts_as_an_empty_poll(spark, tmp_path):
    table = lambda s: s.createDataFrame([(n, T, None, None) for n in ("slow", "a", "b")], SEEDS).drop("poll_every")
    spec = Watch.growth_of(per_seed(slow_first, "string", at_once=4, deadline=1.0)).with_termination_per_input(after_iterations(3))
    watch = ticks.Ticks(spark, spec, table, str(tmp_path), clock)
    start = time.monotonic()
    watch.tick(1)
    watch.close()
    assert time.monotonic() - start < 80
    assert {(r.seed, r["count"]) for r in watch.emitted().groupBy("seed").count().collect()} == {("a", 3), ("b", 3)}
    status = {r.seed: r for r in watch.status(1).collect()}
    assert (status["slow"].poll_no, status["slow"].n_new, status["slow"].done) == (1, 0, False)


def test_seeds_at_their_own_pace(spark, tmp_path):
    """Asked at ticks 1, 3, 5 (two minutes), at all (no pace), at 2 and 4 (came late); replays ask the same."""
    asked, late = [], [False]
    minutes = lambda n: None if n is None else timedelta(minutes=n)

    def poll(watched, poll_no, poll_ts):
        names = sorted(r.seed for r in watched.collect())
        asked.append((poll_no, names))
        rows = [(n, None, None, None, None, False) for n in names] + [(n, 0, poll_no, None, None, None) for n in names]
        return watched.sparkSession.createDataFrame(
            rows, "seed string, pos bigint, value int, event_ts timestamp_ntz, watermark timestamp_ntz, complete boolean"
        )

    def table(s):
        rows = [("two", T, None, minutes(2)), ("each", T, None, None), ("rare", T, None, minutes(60))]
        return s.createDataFrame(rows + [("new", T, None, minutes(2))] * late[0], SEEDS)

    spec = Watch.growth_of(poll).with_poll_interval(60).with_termination_per_input(after_iterations(3))
    watch = ticks.Ticks(spark, spec, table, str(tmp_path), clock)
    watch.tick(1)
    late[0] = True
    for poll_no in (2, 2, 3, 4, 5):
        watch.tick(poll_no)
    watch.close()
    assert asked == [
        (1, ["each", "rare", "two"]), (2, ["each", "new"]), (3, ["each", "two"]), (4, ["new"]), (5, ["two"]),
    ]
    assert sorted((r.seed, r.poll_no, r.discovered_ts) for r in watch.emitted().collect()) == sorted(
        (name, poll_no, clock(poll_no)) for poll_no, names in asked for name in names
    )
    status = {r.seed: (r.poll_no, r.done, r.poll_ts) for r in watch.status(5).collect()}
    assert status == {
        "each": (3, True, clock(3)), "rare": (1, False, clock(1)), "two": (3, True, clock(5)), "new": (2, False, clock(4)),
    }
    assert watch.active(5)


def test_a_tick_without_a_due_seed(spark, tmp_path):
    spec = Watch.growth_of(per_seed(lambda seed: [seed], "string"))
    table = lambda s: s.createDataFrame([("x", T, None, timedelta(hours=1))], SEEDS)
    watch = ticks.Ticks(spark, spec, table, str(tmp_path), clock)
    for poll_no in (1, 2, 2):
        watch.tick(poll_no)
    watch.close()
    assert watch.next_poll() == 3 and watch.emitted().count() == 1
    (status,) = watch.status(2).collect()
    assert (status.poll_no, status.poll_ts, status.done) == (1, clock(1), False)
