import random

import numpy as np
import pytest

from tests.llm.helpers import classes
from tidewatch.llm.components import components, local_roots

EDGES = "node bigint, root bigint"


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle"])
def test_same_as_union_find(spark, kind):
    rng = random.Random(4)
    names = rng.sample(range(-500, 10_000), 60)
    links = {
        "path": list(zip(names, names[1:])),
        "star": [(names[7], n) for n in names],
        "random": [tuple(rng.sample(names, 2)) for _ in range(45)],
        "cycle": list(zip(names, names[1:] + names[:1])),
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, EDGES)).collect()}
    assert {n: got.get(n, n) for n in names} == classes(names, links)
    assert all(node > root for node, root in got.items())


def test_nothing_and_nulls(spark):
    assert components(spark.createDataFrame([], EDGES)).collect() == []
    rows = [(None, 1), (2, None), (3, 3), (5, 4), (5, 4)]
    assert [tuple(r) for r in components(spark.createDataFrame(rows, EDGES)).collect()] == [(5, 4)]


def test_local_roots():
    rng = np.random.RandomState(2)
    left, right = rng.randint(0, 50, 30), rng.randint(0, 50, 30)
    want = classes(range(50), list(zip(left.tolist(), right.tolist())))
    assert local_roots(50, left, right).tolist() == [want[n] for n in range(50)]
