import collections
import random
import re

import numpy as np
import pandas as pd

from tests.llm.helpers import words
from tidewatch.llm import rules

SCHEMA = "doc_id bigint, text string, isolation string, kept string"


def model(text):
    found = words(text)
    windows = collections.Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
    covered = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_statistics_same_as_model():
    rng = random.Random(5)
    texts = ["", " \t\n\x0b\x0c\r", "a", "a b", "a a a", "a a a a", "x\x1cy\u00a0z w", "é#*$%&|<> ü", "a\n\na\na \n a", "w " * 20_000]
    texts += ["".join(rng.choices(["a", "bb", " ", "\n", "a b c ", "#", "É", "\x85", "\t"], k=rng.randrange(60))) for _ in range(400)]
    for text in texts:
        assert rules.statistics(text)[:5] == model(text), text[:80]
    assert rules.statistics(None) == (0,) * 7


def ordinary(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) + "".join(rng.choices("abcdeilnorst", k=rng.randrange(1, 8))) for _ in range(n))


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        text = ordinary(rng, rng.randrange(60, 160))
        bad = i % 12 == 0
        if bad:
            text = [text.replace(" ", "### "), text.replace(" ", " | "), text.upper().replace(" ", "!! ")][i // 12 % 3]
        rows.append((i, text, "x", "y"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_forest_finds_what_is_unlike_the_rest(spark):
    rows, labels = corpus()
    rows += [(1000, None, "", ""), (1001, "", "", ""), (None, rows[1][1], "", ""), (1, rows[1][1], "", ""), (1002, "the same words " * 40, "", "")]
    got = rules.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, None), (None, 0)], "doc_id bigint, quality int"))
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, good in labels:
        assert not by[i].base_failed and by[i].kept == bool(good), i
    assert by[1000].base_failed and not by[1000].kept and by[1002].base_failed
    assert by[None].kept and sum(r.doc_id == 1 and r.kept for r in found) == 2


def test_without_labels_only_the_plain_rules_hold(spark):
    rows, _ = corpus()
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r.kept for r in rules.judge(spark.createDataFrame(rows[:40], SCHEMA), none).collect())
    assert rules.judge(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_path_lengths():
    rng = np.random.RandomState(0)
    sample = np.concatenate([rng.randn(500, 2), [[9.0, 9.0]]])
    forest = rules.grow(sample, trees=60, rows=256)
    scores = rules.isolation(forest, np.array([[0.0, 0.0], [9.0, 9.0], [1.0, 1.0]]), 256)
    assert scores[1] > scores[2] > 0 and scores[1] > scores[0] + 0.1
    assert rules.isolation([], sample, 256).max() == 0 and len(rules.measures(pd.DataFrame(columns=[*rules.BASE, *rules.MORE]))) == 0


def test_word_length_and_duplicate_lines_count(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = ordinary(rng, 80)
        bad = i % 20 == 0
        if bad and i % 40:  # distinct words of 40 letters
            text = " ".join("".join(rng.choices("abcdeilnorst", k=40)) for _ in range(80))
        elif bad:  # most lines are copies of a two-word line, which is under the limit on repeated words
            text = "\n".join([text, *["so it"] * 12])
        rows.append((i, text, "x", "y"))
        labels.append((i, int(not bad)))
    got = rules.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert not any(r.base_failed for r in got)
    good = dict(labels)
    assert not any(r.kept for r in got if not good[r.doc_id])
    assert sum(not r.kept for r in got if good[r.doc_id]) <= rules.MAX_GOOD_LOSS * 570
