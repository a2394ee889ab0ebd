"""Splits on a running stream: they end, and what they report never falls.

Under ``root``, one folder per micro-batch: ``rows``, the records that were read with the
watermark after each, and ``state``, one row per split with its watermark, highest offset and whether it has ended.
``merged`` has one row per batch: the watermark of all splits together.
A batch reads the state that the one before it left and overwrites its own folders, so it can be
repeated.  Only the state, a row per split, is joined with the records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampNTZType

from tidewatch.operators.records import SPLIT, until_terminal
from tidewatch.operators.running import running_max
from tidewatch.streaming.run import each_batch

STATE = (
    StructField("saved_wm", TimestampNTZType()), StructField("saved_top", LongType()), StructField("ended", BooleanType()),
)
MERGED = "reached timestamp_ntz, watermark timestamp_ntz, done boolean, n_open bigint, n_ended bigint, held_back bigint"


def follow(records: DataFrame, root: str, drop_repeats: bool = False) -> StreamingQuery:
    """Read what is available now; started again on the same ``root`` it goes on.

    The records of a split must arrive in the order of ``arrival_no``, at least from batch to batch.
    With ``drop_repeats`` a delivery whose offset is not above all earlier ones of its split is left out; its
    watermark counts.
    """
    return each_batch(records, root, lambda batch, batch_id: _add_batch(batch, root, batch_id, drop_repeats))


def emitted(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The records read so far, up to the terminal one of each split, with ``watermark``."""
    fields = StructType([*schema.fields, StructField("watermark", TimestampNTZType())])
    kept = StructType([*fields.fields, StructField("_kept", BooleanType())])
    return spark.read.schema(kept).parquet(f"{root}/rows").filter("_kept").select(*fields.names)


def follow_merged(records: DataFrame, root: str, expected: DataFrame | None = None) -> StreamingQuery:
    """As :func:`follow`, and keep the watermark of all splits together after every batch; see :func:`merged`.

    ``expected(source_id, split_id)`` are splits known before they are read: they hold the watermark
    back until they report one.  Any other split does so from the batch on that first reads it, and
    what was reported before never falls.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        _add_batch(batch, root, batch_id, drop_repeats=False)
        _merge(batch, root, batch_id, expected)

    return each_batch(records, root, work)


def merged(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch: ``watermark``, ``done`` and how many splits are open, ended and without a watermark.

    The watermark is the lowest of the open splits' watermarks, and never falls.  It stays where it was while an
    open split has none, and is NULL with ``done`` once all splits have ended.
    """
    return spark.read.schema(f"batch bigint, {MERGED}").parquet(f"{root}/merged").drop("reached")


def _merge(batch: DataFrame, root: str, batch_id: int, expected: DataFrame | None) -> None:
    spark = batch.sparkSession
    splits = _state(batch, root, batch_id)
    if expected is not None:
        awaited = expected.select(*SPLIT).distinct().join(splits.select(*SPLIT), list(SPLIT), "left_anti")
        splits = splits.unionByName(awaited.withColumn("ended", F.lit(False)), allowMissingColumns=True)
    is_open = ~F.col("ended")
    counts = splits.agg(
        F.min(F.when(is_open, F.col("saved_wm"))).alias("_low"),
        F.count_if(is_open).alias("n_open"),
        F.count_if(F.col("ended")).alias("n_ended"),
        F.count_if(is_open & F.col("saved_wm").isNull()).alias("held_back"),
    )
    earlier = spark.read.schema(MERGED).parquet(f"{root}/merged/batch={batch_id - 1}").first() if batch_id else None
    before = earlier.reached.isoformat(" ") if earlier and earlier.reached else None
    reached = F.greatest(F.lit(before).cast("timestamp_ntz"), F.when(F.col("held_back") == 0, F.col("_low")))
    done = (F.col("n_open") == 0) & (F.col("n_ended") > 0)
    row = counts.select(
        reached.alias("reached"), F.when(~done, reached).alias("watermark"), done.alias("done"), "n_open", "n_ended", "held_back"
    )
    row.write.mode("overwrite").parquet(f"{root}/merged/batch={batch_id}")


def _state(batch: DataFrame, root: str, batch_id: int) -> DataFrame:
    spark = batch.sparkSession
    state = StructType([*[batch.schema[c] for c in SPLIT], *STATE])
    try:
        return spark.read.schema(state).parquet(f"{root}/state/batch={batch_id}")
    except AnalysisException as missing:
        if batch_id >= 0 or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], state)


def _add_batch(batch: DataFrame, root: str, batch_id: int, drop_repeats: bool) -> None:
    spark = batch.sparkSession
    before = _state(batch, root, batch_id - 1)
    open_splits = batch.join(before.filter("ended").select(*SPLIT), list(SPLIT), "left_anti")
    running = running_max(
        until_terminal(open_splits), SPLIT, "arrival_no", up_to={"watermark": F.col("source_wm")},
        before={"_top": F.col("off")} if drop_repeats else None,
    )
    known = running.join(before.drop("ended"), list(SPLIT), "left")
    above = F.coalesce(F.col("off") > F.greatest("_top", "saved_top"), F.lit(True)) if drop_repeats else F.lit(True)
    rows = known.select(*batch.columns, F.greatest("saved_wm", "watermark").alias("watermark"), above.alias("_kept"))
    folder = f"{root}/rows/batch={batch_id}"
    rows.write.mode("overwrite").parquet(folder)
    now = spark.read.schema(rows.schema).parquet(folder).select(
        *SPLIT, F.col("watermark").alias("saved_wm"), F.col("off").alias("saved_top"),
        F.coalesce("terminal", F.lit(False)).alias("ended"),
    )
    after = before.unionByName(now).groupBy(*SPLIT).agg(
        F.max("saved_wm").alias("saved_wm"), F.max("saved_top").alias("saved_top"), F.max("ended").alias("ended"))
    after.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")
