"""Near duplicates among embeddings: an exact range join in a metric space.

Pivots, spread out over a sample, partition the vectors: the home of a vector is the cell
of its nearest pivot.  By the triangle inequality, a vector with a partner within radius
r whose home is cell q is at most 2 r farther from pivot q than from its own, so it also
visits these cells, and no others.  Each home vector then finds all its partners within its
cell.  Cells join independently; a large cell is cut into tiles, each pair of which is a
task, and the products of a task are made in slices.  Only counts and a spanning forest of
the links leave a task.

The metric is the angle.  How many pivots pay is measured on the sample: more of them exclude
more pairs where vectors cluster, and only make more visits where the angles between unrelated
vectors hardly differ, as in many dimensions.  There few are taken, the result stays exact, and
the work is that of comparing all rows of a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship
from tidewatch.llm.components import components, local_roots
from tidewatch.workspace import written

THRESHOLD = 0.93
#: Pivots are chosen from so many vectors, those with the lowest hash of their id; there are so many at most.
SAMPLE_ROWS = 4096
MAX_PIVOTS = 1024
#: Cells are not made smaller than this on average, from so many rows on there are two at least, and a tile has so many rows.
CELL_ROWS = 256
LEAST_ROWS = 256
TILE_ROWS = 4096
#: A row that visits a cell costs as much as so many products of two vectors.
VISIT_COST = 500
#: More pivots than two are not taken if a vector would be in more cells than this on average, which bounds the rows written.
MOST_CELLS = 8
#: Rows of a tile whose products are held at a time.
SLICE_ROWS = 512


def _units(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``size`` and ``unit`` (packed doubles) of vectors that can have a cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, units = [], [], []
            for at, values in enumerate(batch.column(2).to_pylist()):
                if not values or any(v is None for v in values):
                    continue
                x = np.array(values, np.float64)
                most = np.abs(x).max()
                if not np.isfinite(x).all() or most == 0:
                    continue
                x = x / most + 0.0  # no negative zeros, which would make equal rows differ
                kept.append(at)
                sizes.append(len(x))
                units.append((x / np.sqrt(x @ x)).tobytes())
            rows = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(sizes, pa.int32()), pa.array(units, pa.binary())],
                ["vec_id", "label", "size", "unit"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null")
    return usable.mapInArrow(run, f"vec_id long, label {kind}, size int, unit binary")


def choose_pivots(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Up to ``count`` vectors that are far from each other: each next one is the farthest from all before."""
    if not sample:
        return np.zeros((0, 0))
    sizes = [len(x) for x in sample]
    common = max(sorted(set(sizes)), key=sizes.count)
    points = np.array([x for x in sample if len(x) == common])
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(count, len(points)):
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-12:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, points @ points[at])
    return points[chosen]


def pivots_that_pay(
    sample: list[np.ndarray], radius: float, rows_per_label: float, most: int, visit_cost: float = VISIT_COST
) -> tuple[np.ndarray, float, float]:
    """The pivots whose cells cost least, how many cells a vector is in, and the share of pairs compared.

    Both figures are those of the sample.  With ``n`` pivots a vector is compared with all that are in its
    home cell, and every visit is a row to be shuffled.  At least two pivots are taken where ``most`` allows.
    """
    pivots = choose_pivots(sample, most)
    if len(pivots) < 2:
        return pivots, 1.0, 1.0
    points = np.array([x for x in sample if len(x) == pivots.shape[1]])
    angles = np.arccos(np.clip(points @ pivots.T, -1, 1))
    found = []
    for count in sorted({min(2**k, len(pivots)) for k in range(1, 1 + len(pivots).bit_length())}):
        home = angles[:, :count].argmin(axis=1)
        visits = angles[:, :count] <= angles[np.arange(len(points)), home][:, None] + 2 * radius
        compared = float((np.bincount(home, minlength=count) / len(points)) @ visits.mean(axis=0))
        cells = float(visits.sum(axis=1).mean())
        if cells <= MOST_CELLS or count == 2:
            found.append((rows_per_label * compared + visit_cost * cells, count, cells, compared))
    _, count, cells, compared = min(found)
    return pivots[:count], cells, compared


def _in_cells(units: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """Each vector once in its home cell and once in every cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, homes = [], [], []
            for at, (size, unit) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if size != pivots.shape[1]:  # vectors of another length only meet their own kind
                    rows.append(at), cells.append(-1), homes.append(True)
                    continue
                angles = np.arccos(np.clip(pivots @ np.frombuffer(unit), -1, 1))
                home = int(np.argmin(angles))
                for cell in np.flatnonzero(angles <= angles[home] + 2 * radius + 1e-6).tolist():
                    rows.append(at), cells.append(cell), homes.append(cell == home)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cells, pa.int32()), pa.array(homes, pa.bool_())],
                [*batch.schema.names, "cell", "home"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(run, f"{schema}, cell int, home boolean")


def _block_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the home vectors of one tile with the vectors of another: counts and lowest ids."""
    ids, place = np.unique(rows["vec_id"].to_numpy(), return_inverse=True)
    points = np.frombuffer(b"".join(rows["unit"])).reshape(len(rows), -1)
    asks = np.flatnonzero(rows["asks"].to_numpy())
    answers = np.flatnonzero(~rows["asks"].to_numpy())
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    other = points[answers].T.copy()
    for start in range(0, len(asks), SLICE_ROWS):
        part = asks[start : start + SLICE_ROWS]
        left, right = np.nonzero(points[part] @ other >= threshold)
        left, right = place[part[left]], place[answers[right]]
        differ = left != right
        left, right = left[differ], right[differ]
        np.add.at(counts, left, 1)
        if len(left):
            nodes = np.arange(len(ids))
            root = local_roots(len(ids), np.append(left, nodes), np.append(right, root))
    linked = np.flatnonzero((counts > 0) | (root != np.arange(len(ids))))
    return pd.DataFrame({"vec_id": ids[linked], "links": counts[linked], "low": ids[root[linked]]})


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    max_pivots: int = MAX_PIVOTS,
    cell_rows: int = CELL_ROWS,
    tile_rows: int = TILE_ROWS,
    visit_cost: float = VISIT_COST,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Two vectors are linked if their labels are equal, their lengths too, and their cosine in
    double precision is ``threshold`` or more.  Vectors that are null, empty or zero or hold a
    null or a number that is not finite, and vectors without a label or an id, link with
    nothing.  ``component_id`` is the smallest id reachable by links.  Rows that repeat an id are
    all compared: those equal in label and direction count once, others as vectors of their
    own, of which links between two of the same id do not count.  All rows without an id become
    one, which is not kept.  Pivots come from a bounded sample; all vectors are compared.
    """
    spark = vectors.sparkSession
    ship(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    units = written(_units(named).distinct(), "units")
    rows, labels = units.agg(F.count("*"), F.approx_count_distinct("label")).first()
    radius = float(np.arccos(threshold))
    sample = units.orderBy(F.xxhash64("vec_id"), "vec_id", "unit").limit(sample_rows).select("unit").collect()
    per_label = rows / max(1, labels)
    most = min(max_pivots, max(1 + (rows >= LEAST_ROWS), int(per_label // cell_rows)))
    pivots, _, _ = pivots_that_pay([np.frombuffer(row[0]) for row in sample], radius, per_label, most, visit_cost)
    placed = written(_in_cells(units, pivots, radius), "cells")

    cell = ["label", "size", "cell"]
    tiles = placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    joined = placed.join(tiles, cell).withColumn("tile", F.pmod(F.xxhash64("vec_id", "unit"), F.col("tiles")).cast("int"))

    def with_all(asks: bool):
        first, second = ("tile", "_other") if asks else ("_other", "tile")
        every = joined.withColumn("_other", F.explode(F.expr("sequence(0, tiles - 1)")))
        every = every.filter("home") if asks else every
        return every.select("vec_id", "unit", *cell, F.col(first).alias("asking"), F.col(second).alias("answering"), F.lit(asks).alias("asks"))

    def join_block(rows: pd.DataFrame) -> pd.DataFrame:
        return _block_links(rows, threshold)

    blocks = with_all(True).unionByName(with_all(False)).groupBy(*cell, "asking", "answering")
    links = written(blocks.applyInPandas(join_block, "vec_id long, links long, low long"), "links")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("vec_id").alias("node"), F.col("low").alias("root")))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    found = every.join(counts, "vec_id", "left").join(roots, F.col("vec_id") == roots["node"], "left")
    component = F.coalesce("root", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
