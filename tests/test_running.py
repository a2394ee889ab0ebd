"""Blocked running maxima and positions against plain windows, on skewed random groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.running import position_in_group, running_max


def skewed(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else (None if rng.random() < 0.1 else f"k{rng.randrange(6)}")
        rows.append((key, i * (1 + i % 3 == 0) + i, rng.choice([None, rng.randrange(-1000, 1000) + i // 10])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, n bigint, v bigint")


@pytest.mark.parametrize("bits,levels", [(1, 1), (3, 2), (4, 3), (16, 2)])
def test_running_max(spark, bits, levels):
    df = skewed(spark)
    got = running_max(
        df, ["k"], "n", up_to={"m": F.col("v")}, before={"b": F.col("v")}, block_bits=bits, levels=levels
    )
    w = Window.partitionBy("k").orderBy("n")
    want = df.select(
        "*",
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
    )
    assert got.columns == want.columns
    assert got.count() == df.count()
    assert got.exceptAll(want).isEmpty()


def test_negative_order(spark):
    df = spark.createDataFrame([("a", i, -i) for i in range(-50, 50)], "k string, n bigint, v bigint")
    got = running_max(df, ["k"], "n", up_to={"m": F.col("v")}, block_bits=2)
    assert {r.m for r in got.collect()} == {50}


def test_position(spark):
    df = skewed(spark).withColumn("t", F.col("v") % 5)
    got = position_in_group(df, ["k"], ["t", "n"], "i")
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("t", "n")).cast("long"))
    assert got.count() == df.count()
    assert got.exceptAll(want).isEmpty()
