import random

import pytest

from tests.llm.helpers import words
from tidewatch.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, copies string"


def wanted(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by handing out what is left, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(seed=1, n=1200):
    rng = random.Random(seed)
    names = ["a", "B", "é", "c", None, "", "tiny"]
    rows = []
    for i in range(n):
        source = "a" if rng.random() < 0.35 else rng.choice(names[1:6])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 90])) or rng.choice([None, "", " \n"]), source, "s", "c"))
    rows.append((n, "x " * 500, "tiny", "s", "c"))
    return rows


@pytest.mark.parametrize("block_rows", [2, 16, 2048])
def test_targets_and_copies(spark, block_rows):
    rows = corpus()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), block_rows=block_rows).collect()
    target = wanted(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source == rows[r.doc_id][2]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies <= 2 * r.size
        assert r.copies in (int(r.target / r.source_size), -int(-r.target // r.source_size))
        taken[r.source] += r.taken
    for source in sizes:
        longest = max(r.size for r in got if r.source == source)
        assert abs(taken[source] - target[source]) <= longest
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=block_rows).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_expectation_is_kept(spark):
    """Over many seeds every document is taken about as often as its source's share says."""
    sizes, rounds = [5, 1, 30, 7, 7, 60, 2, 11], 400
    mean = [0] * len(sizes)
    for seed in range(rounds):
        copies = [1.3] * len(sizes)
        mixing._trade(sizes, copies, random.Random(seed).random, True)
        assert set(copies) <= {1.0, 2.0}
        mean = [m + c / rounds for m, c in zip(mean, copies)]
    assert all(abs(m - 1.3) < 0.09 for m in mean)


def test_repeats_nulls_and_nothing(spark):
    rows = [(1, "a b c", "s", "", "")] * 4 + [(None, "a b", "s", "", ""), (None, None, None, "", ""), (2, "", "e", "", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7
    assert len({r.copies for r in got if r.doc_id == 1}) == 1 and all(r.size == 3 for r in got if r.doc_id == 1)
    assert {(r.size, r.taken) for r in got if r.source in (None, "e")} == {(0, 0)}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_ids_survive(spark):
    big = (1 << 62) + 1
    got = mixing.mix(spark.createDataFrame([(big, "a b", "s", "", ""), (None, "a b c", "s", "", "")], SCHEMA)).collect()
    assert {r.doc_id for r in got} == {big, None}
