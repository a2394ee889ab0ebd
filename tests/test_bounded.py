"""The bounded memory against a plain model, in ranges of all sizes, with right and wrong guesses."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest

from tidewatch.operators import bounded
from tidewatch.operators.bounded import bounded_first_seen

T = datetime(2024, 1, 1)


def make_log(n_polls=8, n_keys=6, seed=3):
    rng = random.Random(seed)
    polls, outputs = [], []
    for s in ("hot", "cold"):
        for p in range(1, n_polls + 1):
            polls.append((s, p, T + timedelta(minutes=p)))
            for pos in range(rng.randrange(0, 9 if s == "hot" else 3)):
                ts = None if rng.random() < 0.3 else T + timedelta(seconds=rng.randrange(20))
                outputs.append((s, p, pos, rng.randrange(n_keys), ts))
    return polls, outputs


def model(polls, outputs, cap):
    emitted = []
    for s in {p[0] for p in polls}:
        seen = OrderedDict()
        for _, p, now in sorted(x for x in polls if x[0] == s):
            new = {}
            for _, _, pos, value, ts in sorted((o for o in outputs if o[:2] == (s, p)), key=lambda o: o[2]):
                if value not in seen and value not in new:
                    new[value] = (ts or now, pos)
            for value, (ts, pos) in sorted(new.items(), key=lambda kv: kv[1]):
                emitted.append((s, p, pos, value, ts))
                seen[value] = None
            while cap is not None and len(seen) > cap:
                seen.popitem(last=False)
    return sorted(emitted)


def found(spark, polls, outputs, cap, **how):
    p = spark.createDataFrame(polls, "seed string, poll_no int, poll_ts timestamp_ntz")
    o = spark.createDataFrame(outputs, "seed string, poll_no int, pos int, value int, event_ts timestamp_ntz")
    got = bounded_first_seen(o, p, cap, **how)
    return sorted((r.seed, r.poll_no, r.pos, r.value, r.discovered_ts) for r in got.collect())


@pytest.mark.parametrize("cap", [None, 0, 1, 2, 4, 100])
@pytest.mark.parametrize("range_rows, guesses", [(None, 4), (12, 4), (3, 1), (1, 2)])
def test_same_as_model(spark, cap, range_rows, guesses):
    polls, outputs = make_log()
    assert found(spark, polls, outputs, cap, range_rows=range_rows, guesses=guesses) == model(polls, outputs, cap)


def test_polls_larger_than_ranges_and_memory(spark):
    rng = random.Random(5)
    polls = [(s, p, T + timedelta(minutes=p)) for s in ("a", "b") for p in (1, 2, 3, 4)]
    outputs = [(s, p, k, v, None) for s, p, _ in polls for k, v in enumerate(rng.sample(range(40), 30))]
    for cap in (3, 10, 25):
        assert found(spark, polls, outputs, cap, range_rows=7, guesses=2) == model(polls, outputs, cap)


def rounds(monkeypatch):
    made = []
    plain = bounded._replay
    monkeypatch.setattr(bounded, "_replay", lambda cap: made.append(cap) or plain(cap))
    return made


def test_growing_listing_is_guessed_right(spark, monkeypatch):
    """Keys that never come back after they were forgotten: one round, although every seed overflows."""
    made = rounds(monkeypatch)
    polls = [("s", p, T + timedelta(minutes=p)) for p in range(1, 31)]
    outputs = [("s", p, k, v, None) for p in range(1, 31) for k, v in enumerate(range(max(0, 4 * p - 12), 4 * p))]
    assert found(spark, polls, outputs, 16, range_rows=20) == model(polls, outputs, 16)
    assert len(made) == 1


def test_keys_that_come_back_take_a_bounded_number_of_rounds(spark, monkeypatch):
    made = rounds(monkeypatch)
    rng = random.Random(8)
    polls = [("s", p, T + timedelta(minutes=p)) for p in range(1, 61)]
    outputs = [("s", p, k, v, None) for p in range(1, 61) for k, v in enumerate(rng.sample(range(14), 6))]
    assert found(spark, polls, outputs, 12, range_rows=5, guesses=3) == model(polls, outputs, 12)
    assert 1 < len(made) <= 4


def test_memory_holds_twice_the_cap_at_most():
    memory = bounded.Memory(5)
    for poll in range(20):
        memory.take([poll] * 50, range(50), [f"{poll % 3}-{k}" for k in range(50)])
        assert len(memory.order) <= 5 and len(memory.keys) <= 5 and len(memory.fresh) <= 5


def test_forgotten_key_comes_back(spark):
    polls = [("s", p, T) for p in (1, 2, 3)]
    outputs = [("s", 1, 0, 1, None), ("s", 2, 0, 2, None), ("s", 2, 1, 3, None), ("s", 3, 0, 1, None), ("s", 3, 1, 3, None)]
    p = spark.createDataFrame(polls, "seed string, poll_no int, poll_ts timestamp_ntz")
    o = spark.createDataFrame(outputs, "seed string, poll_no int, pos int, value int, event_ts timestamp_ntz")
    got = bounded_first_seen(o, p, 2)
    assert sorted((r.poll_no, r.value) for r in got.collect()) == [(1, 1), (2, 2), (2, 3), (3, 1)]


def test_empty_log(spark):
    p = spark.createDataFrame([], "seed string, poll_no int, poll_ts timestamp_ntz")
    o = spark.createDataFrame([], "seed string, poll_no int, pos int, value int, event_ts timestamp_ntz")
    assert bounded_first_seen(o, p, 3).collect() == []
