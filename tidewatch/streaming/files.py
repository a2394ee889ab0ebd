"""Watched folders: each new file once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear under ``folder``; their contents are not read.

    The stream's checkpoint remembers the files, so a restart emits only what came since.  Spark's scans skip
    files without content, so an empty file appears once something is in it.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select(
        F.lit(folder).alias("seed"), F.col("path").alias("value"), F.col("modificationTime").alias("event_ts"), "length"
    )


def folder_poll(pattern: str = "*") -> Callable[[DataFrame, int, datetime], DataFrame]:
    """A poll for a watch whose seeds are folders: every file under each, by Spark's own listing.

    Spark's scans skip files without content, so an empty file appears once something is in it; a poll that must
    see empty files is one per seed, in Python.  Nothing of the files is read, so the folders may be in any store that Spark reads.  A file is discovered by the poll
    that lists it first; a folder that isn't there yet is an empty poll.  The driver asks for the folders, not for the files.
    """

    def poll(seeds: DataFrame, poll_no: int, poll_ts: datetime) -> DataFrame:
        rows = seeds.select(
            "seed", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("value"),
            F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.lit(None).cast("timestamp_ntz").alias("watermark"),
            F.lit(False).alias("complete"),
        )
        for (folder,) in seeds.select("seed").collect():
            reader = seeds.sparkSession.read.format("binaryFile").option("pathGlobFilter", pattern)
            try:
                files = reader.option("recursiveFileLookup", "true").load(folder)
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            listed = files.select(F.lit(folder).alias("seed"), F.xxhash64("path").alias("pos"), F.col("path").alias("value"))
            rows = rows.unionByName(listed, allowMissingColumns=True)
        return rows

    return poll
