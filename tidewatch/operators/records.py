"""Operators over records of split sources.

``records(source_id, split_id, arrival_no, off, record_id, value, event_ts, source_wm,
terminal)``: ``arrival_no`` numbers the deliveries of a split, ``off`` is the record's
place in its split and repeats when a record is delivered again.
``checkpoints(source_id, split_id, off, watermark)``: how far each split was read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.times import EPOCH, event_time, ntz
from tidewatch.operators.first_seen import first_by
from tidewatch.operators.running import BLOCK_BITS, running_max
from tidewatch.workspace import written

SPLIT = ("source_id", "split_id")
BACKLOG_UNKNOWN = -1


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Merge many sources into one read, each row naming its source."""
    named = [df.withColumn("source_id", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def empty_source(spark: SparkSession, schema: StructType) -> DataFrame:
    """A source without records; it is at its end from the start."""
    return spark.createDataFrame([], schema)


def counting_source(spark: SparkSession, n: int) -> DataFrame:
    """The integers below ``n``; the event time of i is i seconds, the last one is terminal."""
    return spark.range(n).select(
        F.col("id").alias("value"),
        (ntz(EPOCH) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("event_ts"),
        (F.col("id") == n - 1).alias("terminal"),
    )


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(*SPLIT).agg(F.count("*").alias("n_records"), F.max("off").alias("last_off"))


def with_checkpoint(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Add the split's saved ``checkpoint_off`` and ``checkpoint_wm``; NULL if never read.

    The checkpoints, one row per split, are written first: their size is known when the join
    is planned, so the records are not shuffled on the split while it is small enough.
    """
    saved = checkpoints.select(
        *SPLIT, F.col("off").alias("checkpoint_off"), F.col("watermark").alias("checkpoint_wm")
    )
    saved = written(saved, "checkpoints")
    return records.join(saved, list(SPLIT), "left")


def _unread() -> Column:
    return F.col("checkpoint_off").isNull() | (F.col("off") > F.col("checkpoint_off"))


def resume(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records strictly after the saved position of their split."""
    return with_checkpoint(records, checkpoints).filter(_unread())


def until_terminal(records: DataFrame) -> DataFrame:
    """Records up to and including the first terminal one of their split."""
    ends = written(records.filter("terminal").groupBy(*SPLIT).agg(F.min("arrival_no").alias("_end")), "ends")
    cut = records.join(ends, list(SPLIT), "left")
    return cut.filter(F.col("_end").isNull() | (F.col("arrival_no") <= F.col("_end"))).drop("_end")


def backlog_bytes(records: DataFrame, checkpoints: DataFrame, size: Column) -> DataFrame:
    """Bytes left to read per split: -1 if the size of a record left to read is unknown."""
    left = with_checkpoint(records, checkpoints).withColumn("_size", size)
    unknown = F.count_if(_unread() & F.col("_size").isNull())
    total = F.sum(F.when(_unread(), F.col("_size").cast("long")).otherwise(F.lit(0)))
    return left.groupBy(*SPLIT).agg(
        F.when(unknown > 0, F.lit(BACKLOG_UNKNOWN)).otherwise(total).cast("long").alias("backlog_bytes")
    )


def progress(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records read per split up to its checkpoint."""
    return with_checkpoint(records, checkpoints).groupBy(*SPLIT).agg(F.count_if(~_unread()).alias("completed"))


def with_event_time(records: DataFrame) -> DataFrame:
    return records.withColumn("event_ts", event_time(F.col("event_ts")))


def monotone_watermark(records: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``watermark``: what the split reported so far, never falling."""
    return running_max(
        records, SPLIT, "arrival_no", up_to={"watermark": F.col("source_wm")}, block_bits=block_bits
    )


def resume_watermark(records: DataFrame, checkpoints: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The records left to read with a watermark that starts at the saved one."""
    running = monotone_watermark(resume(records, checkpoints), block_bits)
    return running.withColumn("watermark", F.greatest("checkpoint_wm", "watermark"))


def merged_watermark(records: DataFrame, step: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The watermark of all splits together: one row per ``step`` with ``watermark`` and ``done``.

    ``step`` is an integer from 0 on, below 2^62, that doesn't fall within a split in the order of ``arrival_no``.  After a step the
    watermark is the lowest that an open split has reported so far.  A split holds it back (NULL) from the
    start until it reports one, and is left out from the step on in which it ends.  ``done``: every split
    has ended, and the watermark is NULL, since nothing is to come.  Without records there are no rows.

    No grid of splits and steps is made.  What a split has reported holds until its next step, and never
    falls; so the lowest after step s is the lowest of all values that hold beyond s, also of those that begin
    later.  That is a running minimum from the last step back to the first.
    """
    low, held = "_low", "_held"
    # From a fixed instant back to the watermark: the larger, the lower the watermark.
    behind = ntz(EPOCH) - F.col("source_wm")
    cut = until_terminal(records).withColumn("_step", step.cast("long"))
    by_step = cut.groupBy(*SPLIT, "_step").agg(
        F.max("source_wm").alias("source_wm"), F.max(F.coalesce("terminal", F.lit(False))).alias("_ended")
    )
    by_step = written(by_step, "steps")
    until_next = running_max(by_step, SPLIT, "_step", before={low: F.col("source_wm")}, block_bits=block_bits)
    left = by_step.groupBy(*SPLIT).agg(F.max("source_wm").alias(low), F.max("_ended").alias("_ended")).filter("not _ended")
    open_end = left.select(F.lit(None).cast("long").alias("_step"), low)
    holding = until_next.select("_step", low).unionByName(open_end).withColumn("source_wm", F.col(low))
    by_end = holding.groupBy("_step").agg(F.max(behind).alias(low), F.max(F.col(low).isNull()).alias(held))
    back = by_end.withColumn("_back", F.coalesce(-F.col("_step"), F.lit(-(1 << 62))))
    beyond = running_max(
        back.withColumn("_all", F.lit(0)), ["_all"], "_back",
        before={"_after": F.col(low), "_holds": F.col(held)}, block_bits=block_bits,
    )
    done = F.col("_holds").isNull()
    return beyond.filter("_step is not null").select(
        F.col("_step").alias("step"), F.when(~F.col("_holds"), ntz(EPOCH) - F.col("_after")).alias("watermark"), done.alias("done")
    )


def tag_record_ids(records: DataFrame, needs_ids: Column) -> DataFrame:
    """Keep ``record_id`` for the sources that ask for deduplication, NULL for the others."""
    return records.withColumn("record_id", F.when(needs_ids, F.col("record_id")))


def dedup_by_id(records: DataFrame) -> DataFrame:
    """The first delivery of each record id.  Records without an id are all kept."""
    group = ["source_id", "record_id"]
    keep = [c for c in records.columns if c not in group]
    tagged = records.filter(F.col("record_id").isNotNull())
    firsts = first_by(tagged, group, F.col("arrival_no"), keep).select(*records.columns)
    return firsts.unionByName(records.filter(F.col("record_id").isNull()))


def dedup_by_offset(records: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Drop a delivery whose offset is not above all earlier ones of its split."""
    seen = running_max(records, SPLIT, "arrival_no", before={"_top": F.col("off")}, block_bits=block_bits)
    return seen.filter(F.col("_top").isNull() | (F.col("off") > F.col("_top"))).drop("_top")
