"""Running maxima and positions over groups that may be far too large for one task.

A plain ``max(...) over (partition by split order by n)`` sends a whole split to one
task.  Here a group is cut into blocks of neighbouring order values: the blocks are
summarised with map-side aggregation, the running value is carried over the small
block table, and each block is then finished on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.workspace import written

BLOCK_BITS = 16


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    up_to: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    block_bits: int = BLOCK_BITS,
    levels: int = 2,
) -> DataFrame:
    """Add running maxima per ``keys`` in the order of the integer column ``order``.

    ``up_to`` maps new column names to values whose maximum includes the row itself,
    ``before`` to values whose maximum covers the earlier rows only.  NULL values are
    ignored.  ``order`` must be unique within a group, so a block holds at most
    ``2 ** block_bits`` rows.  With ``levels`` above 1 the block table is itself cut into
    blocks; the last level is one window per group with a row per
    ``2 ** (levels * block_bits)`` order values.
    """
    up_to, before = up_to or {}, before or {}
    values = {**up_to, **before}
    block, head = f"_block{levels}", f"_head{levels}"

    rows = df.select(
        "*",
        F.shiftright(F.col(order).cast("long"), block_bits).alias(block),
        *[value.alias(name) for name, value in values.items()],
    )
    summary = rows.groupBy(*keys, block).agg(*[F.max(name).alias(f"_max_{name}") for name in values])
    carried = {name: F.col(f"_max_{name}") for name in values}
    if levels > 1:
        # Written, since the rows would be read once more for the blocks above.
        summary = written(summary, "blocks")
        heads = running_max(summary, keys, block, before=carried, block_bits=block_bits, levels=levels - 1)
    else:
        earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        heads = summary.select("*", *[F.max(c).over(earlier).alias(name) for name, c in carried.items()])

    # Each block starts with one extra row that holds what the earlier blocks reached.
    # A union instead of a join keeps NULL keys and needs no second shuffle.
    marked = rows.withColumn(head, F.lit(False)).unionByName(
        heads.select(*keys, block, *values, F.lit(True).alias(head)), allowMissingColumns=True
    )
    in_block = Window.partitionBy(*keys, block).orderBy(F.col(head).desc(), order)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    done = marked.select(
        *df.columns,
        head,
        *[F.max(name).over(so_far).alias(name) for name in up_to],
        *[F.max(name).over(earlier).alias(name) for name in before],
    )
    return done.filter(~F.col(head)).drop(head)


def position_in_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, folder: str | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group, without one task per group.

    The rows are range-partitioned on group and order, so a large group spans many
    partitions; each partition's share of a group is counted and the counts are summed
    up over partitions.  The sorted rows are written first, since both passes must see
    the same partitions even if an executor is lost in between; a given ``folder`` keeps
    them.  ``order`` must be unique within a group.
    """
    placed = (
        df.repartitionByRange(*groups, *order)
        .sortWithinPartitions(*groups, *order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    )
    spread = written(placed, "positions", folder)
    shares = spread.groupBy(*groups, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select(
        *[F.col(c).alias(f"_at_{c}") for c in (*groups, "_part")],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same_share = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*groups, "_part")]
    return spread.join(starts, same_share).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
