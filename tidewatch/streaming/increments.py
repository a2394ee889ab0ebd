"""First-seen kept up to date as the poll log grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.functions.keys import key_digest, with_one_zero
from tidewatch.operators.first_seen import first_seen
from tidewatch.streaming.dedup import first_of_ids
from tidewatch.streaming.seen import SeenKeys

STEPS = "after bigint, upto bigint, ended boolean"


def extend(
    outputs: DataFrame, root: str, after: int, upto: int, key: Sequence[str] = ("value",), seen: SeenKeys | None = None
) -> DataFrame:
    """Find what is new in polls ``after + 1`` to ``upto`` and add it to ``root/fresh``.

    Reads only those polls of the log, which should be partitioned by ``poll_no``; of the earlier ones it
    looks up the keys at hand.  ``seen`` are the opened keys of ``root`` (:func:`seen_keys`), for callers with many steps.
    Repeating a step gives the same rows; a step must be one that was taken before, or follow the last one,
    which must have ended.
    """
    _claim(outputs.sparkSession, root, after, upto)
    polls = outputs.filter((F.col("poll_no") > after) & (F.col("poll_no") <= upto))
    if seen is None:
        with seen_keys(outputs.sparkSession, root) as own:
            _add_step(polls, root, upto, key, own)
    else:
        _add_step(polls, root, upto, key, seen)
    _note(outputs.sparkSession, root, after, upto, ended=True)
    return found(outputs, root, upto)


def seen_keys(spark: SparkSession, root: str) -> SeenKeys:
    """The keys that the steps under ``root`` have found; close them after the last step."""
    return SeenKeys(spark, f"{root}/seen")


def _claim(spark: SparkSession, root: str, after: int, upto: int) -> None:
    """Note the range of a step before it is worked off."""
    if after >= upto:
        raise ValueError(f"no polls after {after} up to {upto}")
    try:
        taken = spark.read.schema(STEPS).parquet(f"{root}/steps")
        last = taken.orderBy(F.desc("upto")).first()
        same = taken.filter((F.col("after") == after) & (F.col("upto") == upto)).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = same = None
    if same is not None:
        return
    if after != (last["upto"] if last else 0):
        raise ValueError(f"polls {after + 1} to {upto} don't follow those up to {last['upto'] if last else 0}")
    if last is not None and not last["ended"]:
        raise ValueError(f"the step of polls {last['after'] + 1} to {last['upto']} has not ended")
    _note(spark, root, after, upto, ended=False)


def _note(spark: SparkSession, root: str, after: int, upto: int, ended: bool) -> None:
    row = spark.range(1).select(
        F.lit(after).cast("long").alias("after"), F.lit(upto).cast("long").alias("upto"), F.lit(ended).alias("ended"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/steps/step={upto}")


def follow(log: DataFrame, root: str, key: Sequence[str] = ("value",)) -> StreamingQuery:
    """Work off a streaming poll log: what is new goes to ``root/fresh``, a folder per micro-batch.

    Takes what is available now and stops; started again on the same ``root`` it goes on.
    Within a batch the first output by poll and position counts, across batches the one
    that arrived first.  A batch that is run again overwrites its own step.  The keys seen are the state of
    the stream, so a batch costs as much as its own rows.
    """
    first = first_of_ids(with_one_zero(log, key), ["seed", *key], ["poll_no", "pos"])
    return (
        first.select(*log.columns)
        .writeStream.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{root}/fresh/step={batch_id}"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def found(outputs: DataFrame, root: str, upto: int | None = None) -> DataFrame:
    """The new outputs of all steps, or of those up to ``upto``, as columns of ``outputs``."""
    schema = StructType([*outputs.schema.fields, StructField("step", LongType())])
    every = outputs.sparkSession.read.schema(schema).parquet(f"{root}/fresh")
    if upto is not None:
        every = every.filter(F.col("step") <= upto)
    return every.select(*outputs.columns)


def _add_step(outputs: DataFrame, root: str, step: int, key: Sequence[str], seen: SeenKeys) -> None:
    marked = with_one_zero(first_seen(outputs, key), key).withColumn("key_hash", key_digest(*key))
    new = seen.admit(marked, step).select(*outputs.columns)
    new.write.mode("overwrite").parquet(f"{root}/fresh/step={step}")
