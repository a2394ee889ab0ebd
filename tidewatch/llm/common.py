"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: What separates words: the ASCII white space, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _shipped(context: SparkContext) -> None:
    # A name of its own, since the session may already hold an archive of the package.
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/tidewatch-llm", "zip", ROOT, "tidewatch"))


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, as ``--py-files`` would."""
    _shipped(spark.sparkContext)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` separates at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of all ``keys`` with NULL equal to NULL; Spark can hash it."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few whole texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
