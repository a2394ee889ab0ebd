import random

import numpy as np

from tidewatch.llm import quality
from tidewatch.llm.common import table
from tidewatch.llm.queries import op10_quality

SCHEMA = "doc_id bigint, text string, score string, _label string"


def test_features_are_the_hashed_grams():
    columns = quality.features("the cat sat")
    assert len(columns) == 2 * (3 + 2) and columns.min() >= 0 and columns.max() < 1 << quality.BITS
    assert sorted(quality.features("the\tcat\n sat")) == sorted(columns)
    assert len(quality.features(None)) == len(quality.features(" \n")) == 0 and len(quality.features("one")) == 2
    assert set(quality.features("a b")[:2]) & set(quality.features("b a")[:2])
    assert quality.features("a b")[2] != quality.features("b a")[2]


def test_score_is_a_sparse_dot_product():
    rng = np.random.RandomState(3)
    weights = rng.randn(1 << quality.BITS)
    text = "one two two three " * 7
    columns = quality.features(text)
    dense = np.bincount(columns, minlength=1 << quality.BITS) / np.sqrt(len(columns))
    assert abs(quality.score(weights, columns) - 1 / (1 + np.exp(-(weights[0] + dense @ weights)))) < 1e-9
    assert quality.score(weights, quality.features("")) == 1 / (1 + np.exp(-weights[0]))


def test_updates_same_as_plain_loops():
    """FTRL-proximal by the book, one number at a time."""
    rng = random.Random(2)
    rows = [(quality.features(" ".join(rng.choices("abcdef", k=9))), rng.randrange(2)) for _ in range(30)]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.01, 0.05
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(quality.EPOCHS):
        for columns, y in rows:
            x = {0: 1.0}
            for c in columns.tolist():
                x[c] = x.get(c, 0) + 1 / len(columns) ** 0.5
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / alpha * w
                n[i] = n.get(i, 0) + g * g
    got = quality.train(rows)
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, "good words here", "", ""), (1, "good words here", "", ""), (2, None, "", ""), (None, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (9, 1)], "doc_id bigint, quality int")
    weights = quality.fit(docs, labels)
    got = quality.with_score(docs, weights).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id == 2] == [r.score for r in got if r.doc_id is None]
    none = quality.fit(docs, labels.filter("false"))
    assert not none.any() and {r.score for r in quality.with_score(docs, none).collect()} == {0.5}
    assert quality.with_score(docs.filter("false"), weights).collect() == []


def test_held_out_accuracy_and_reruns(spark, sf_dir):
    got = {r.doc_id: r for r in op10_quality(spark, sf_dir).collect()}
    labels = table(spark, sf_dir, "labels").collect()
    held = [(r.quality, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50
    assert sum(p for y, p in held if y) / sum(y for y, _ in held) >= 0.98
    assert sum(1 - p for y, p in held if not y) / sum(1 - y for y, _ in held) >= 0.8
    again = {r.doc_id: r for r in op10_quality(spark, sf_dir).collect()}
    assert again == got
