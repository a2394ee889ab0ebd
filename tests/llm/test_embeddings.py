import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import classes
from tidewatch.llm.embeddings import _in_cells, _units, near_duplicates, pivots_that_pay

SCHEMA = "vec_id bigint, embedding array<double>, label int, vec_size int"


def model(rows, threshold):
    usable = {
        i: (np.array(v) / np.linalg.norm(v), lab)
        for i, v, lab in rows
        if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    links = [
        (a, b) for a, (x, p) in usable.items() for b, (y, q) in usable.items()
        if a != b and p == q and len(x) == len(y) and x @ y >= threshold
    ]
    found = classes([i for i, _, _ in rows if i is not None], links)
    return {i: (sum(a == i for a, _ in links), root) for i, root in found.items()}


def clustered(seed, n, size):
    rng = np.random.RandomState(seed)
    centres = rng.randn(8, size)
    return [(i, (centres[rng.randint(8)] + rng.randn(size) * rng.choice([0.02, 0.25, 1.0])).tolist(), int(rng.randint(3))) for i in range(n)]


@pytest.mark.parametrize("size, cell_rows, tile_rows", [(3, 20, 16), (24, 10, 7), (24, 4096, 4096), (2, 5, 1000)])
def test_same_as_all_pairs(spark, size, cell_rows, tile_rows):
    rows = clustered(size, 240, size)
    df = spark.createDataFrame([(*r, size) for r in rows], SCHEMA)
    got = near_duplicates(df, cell_rows=cell_rows, tile_rows=tile_rows).collect()
    want = model(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(n for n, _ in want.values()) > 0


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0),
        (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 0.0], 0), (10, [None, 1.0], 0), (11, [1e300, 0.0], 0),
        (12, [1.0, 0.0, 0.0], 0), (13, [5e-324, 0.0], 0), (-7, [1.0, 1e-9], 0),
    ]
    got = near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in got}
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert found[i] == (0, i)
    for i in (1, 2, 11, 13, -7):
        assert found[i] == (4, -7)


def test_repeated_ids_nulls_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 0, 0), (1, [1.0, 0.0], 0, 0), (2, [1.0, 0.01], 0, 0), (None, [1.0, 0.0], 0, 0), (None, None, 0, 0)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exactly_at_the_threshold_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "a"), (2, [0.93, math.sqrt(1 - 0.93**2)], 0, "b"), (3, [0.9299, math.sqrt(1 - 0.9299**2)], 5, "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, links string")
    df = df.withColumn("cell", F.lit(3)).withColumn("root", F.lit(4)).withColumn("unit", F.lit(1))
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert got[1] == got[2] == int(0.93 * 1.0 / np.linalg.norm(rows[1][1]) >= 0.93)


def test_triangle_inequality_excludes_cells(spark):
    """Where clusters are far apart, vectors stay in their home cells."""
    rng = random.Random(1)
    rows = [(i, [(i % 4 == k) * 1.0 + rng.random() * 0.01 for k in range(4)], 0) for i in range(80)]
    units = _units(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").select("vec_id", "label", "embedding"))
    placed = _in_cells(units, np.eye(4), float(np.arccos(0.93)))
    assert placed.count() == 80 and placed.filter("home").count() == 80


@pytest.mark.parametrize("visit_cost", [0, 500])
def test_many_pivots_same_as_all_pairs(spark, visit_cost):
    rows = clustered(3, 400, 6)
    df = spark.createDataFrame([(*r, 6) for r in rows], SCHEMA)
    got = near_duplicates(df, cell_rows=4, tile_rows=30, visit_cost=visit_cost).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == model(rows, 0.93)


def test_pivots_grow_where_they_exclude_pairs():
    rng = np.random.RandomState(5)
    radius = float(np.arccos(0.93))

    def units(x):
        return list(x / np.linalg.norm(x, axis=1)[:, None])

    centres = rng.randn(64, 32)
    near = units(centres[rng.randint(64, size=2000)] + 0.02 * rng.randn(2000, 32))
    counts = []
    for per_label in (500, 5_000, 5_000_000):
        pivots, cells, compared = pivots_that_pay(near, radius, per_label, 64)
        counts.append(len(pivots))
    assert counts[0] <= counts[1] <= counts[2] == 64
    assert compared < 0.1 and cells < 6
    far = units(rng.randn(2000, 64))
    pivots, cells, compared = pivots_that_pay(far, radius, 500, 64)
    assert len(pivots) == 2 and compared > 0.9
    assert pivots_that_pay(far, radius, 5_000_000, 64)[1] <= 8
    assert len(pivots_that_pay(near, radius, 1e6, 1)[0]) == 1
    assert pivots_that_pay([], radius, 0, 2)[0].shape == (0, 0)


def test_rows_of_a_repeated_id_are_all_compared(spark):
    rows = [
        (1, [1.0, 0.0], 0, 0), (2, [1.0, 0.01], 0, 0), (2, [1.0, 0.01], None, 0), (2, None, 0, 0),
        (3, [0.0, 1.0], 0, 0), (3, [1.0, 0.02], 0, 0), (4, [0.0, 1.0], 1, 0), (4, [-0.0, 3.0], 0, 0), (4, [0.0, 1.0], 0, 0),
        (5, [1.0, 1.0], 7, 0), (5, [1.0, 1.001], 7, 0),
    ]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (3, 3, 1, False), (4, 1, 1, False), (5, 0, 5, True)}
