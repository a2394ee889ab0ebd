"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the same expected number of copies as its source:
``target / source size``.  The whole part is taken; the fraction is a probability.
Two documents of a source that are both fractional trade words, in a random direction whose
odds keep each one's expectation, until one of the two is integral.  The words of
the source stay what they were after every trade.  Blocks of documents trade on their
own and leave one fractional document at most; these residuals trade in blocks again, level
by level, until a source has one left, which is drawn alone.  So a source misses its target
by less than its last document.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, same, ship
from tidewatch.operators.running import position_in_group
from tidewatch.workspace import written

#: Documents in a block of the first level, and residuals in a block of each level above.
BLOCK_ROWS = 2048


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    units: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source of ``units(source, size)``.

    Sources in code point order, null last, get ``weights`` in turn and divide ``share`` of
    all sizes by them.  A target stops at ``most`` times its source's size; the excess is
    divided again among the others until none is above.  The sources are ranked by range
    partitions, and each round is one aggregation whose two sums the driver sees.
    ``most`` must not be below ``share``.  A source of size 0 has target 0.
    """
    sizes = units.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sizes = sizes.withColumn("_last", F.col("source").isNull())
    ranked = position_in_group(sizes, [], ["_last", "source"], "_rank")
    turn = ((F.col("_rank") - 1) % len(weights) + 1).cast("int")
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    ranked = written(
        ranked.select("source", "source_size", "_weight", (F.col("source_size") * F.lit(float(most))).alias("_most")),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        above = F.col("_most") < F.col("_weight") * F.lit(level) if full is not None else F.lit(False)
        spent, open_weight, count = ranked.agg(
            F.sum(F.when(above, F.col("_most")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))),
            F.sum(above.cast("long")),
        ).first()
        if not open_weight or count == full:
            break
        full = count
        level = (share * total - spent) / open_weight
    target = F.least(F.col("_most"), F.col("_weight") * F.lit(level)) if open_weight else F.col("_most")
    return ranked.select("source", "source_size", target.alias("target"))


def _trade(sizes: list[int], copies: list[float], draw: Callable[[], float], last: bool) -> int:
    """Trade within a block, in place; returns the row that is still fractional, or -1."""
    held = -1
    for at, (size, value) in enumerate(zip(sizes, copies)):
        if size == 0 or value == int(value):
            copies[at] = float(int(value))
            continue
        if held < 0:
            held = at
            continue
        base_held, base = int(copies[held]), int(value)
        p, q, s, t = copies[held] - base_held, value - base, sizes[held], size
        up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
        if draw() * (up + down) < down:  # towards more of the held one
            if s * (1 - p) <= t * q:
                copies[held], copies[at], held = base_held + 1.0, base + min(max(q - s * (1 - p) / t, 0.0), 1.0), at
            else:
                copies[at], copies[held] = float(base), base_held + min(p + t * q / s, 1.0)
        elif s * p <= t * (1 - q):
            copies[held], copies[at], held = float(base_held), base + min(q + s * p / t, 1.0), at
        else:
            copies[at], copies[held] = base + 1.0, base_held + max(p - t * (1 - q) / s, 0.0)
        if copies[held] == int(copies[held]):
            held = -1
    if last and held >= 0:
        whole = int(copies[held])
        copies[held], held = whole + float(draw() < copies[held] - whole), -1
    return held


def copies_of(
    units: DataFrame, targets: DataFrame, seed: int = 0, block_rows: int = BLOCK_ROWS, unit: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Whole numbers of copies: ``units`` (``unit`` columns, ``source``, ``size``) with ``copies``.

    Rows that are equal in all of these columns must have been combined before.  The
    result depends on the rows, the seed and ``block_rows``, not on partitions or order.
    A block holds about ``block_rows`` rows whatever the size of its source.
    """
    spark = units.sparkSession
    ship(spark)
    columns = [*unit, "source", "size"]
    counts = units.groupBy("source").agg(F.count("*").alias("_rows"))
    counts = written(counts.join(targets, same(counts, targets, ["source"])).select(counts["*"], "source_size", "target"), "counts")
    # The greater side carries the source; the other has one row per source.
    joined = units.select(*columns).join(counts, same(units, counts, ["source"]), "left").drop(counts["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_rows") / block_rows)).cast("long")
    current = joined.select(
        *columns,
        ratio.alias("copies"),
        blocks.alias("blocks"),
        F.pmod(F.xxhash64(*columns, F.lit(seed)), blocks).alias("block"),
        F.lit(0).alias("level"),
    )
    most = counts.agg(F.max("_rows")).first()[0] or 0
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    schema += ", copies double, blocks long, block long, level int, open boolean"
    names = [*columns, "copies", "blocks", "block", "level"]

    def trade(rows: pa.Table) -> pa.Table:
        # Large documents first: their fractions are settled by the many small ones after them.
        rows = rows.sort_by([("size", "descending"), *[(c, "ascending") for c in unit]])
        source, block, level, blocks = (rows[c][0].as_py() for c in ("source", "block", "level", "blocks"))
        copies = rows["copies"].to_pylist()
        draw = random.Random(f"{seed} {source} {block} {level}").random
        held = _trade(rows["size"].to_pylist(), copies, draw, blocks <= 1)
        still = [at == held for at in range(len(copies))]
        rows = rows.select(names).set_column(names.index("copies"), "copies", pa.array(copies, pa.float64()))
        return rows.append_column("open", pa.array(still, pa.bool_()))

    results, blocks_left = [], -(-most // block_rows)
    while True:
        traded = written(current.groupBy("source", "block", "blocks").applyInArrow(trade, schema), "copies")
        results.append(traded.filter("not open").select(*columns, F.col("copies").cast("long").alias("copies")))
        if blocks_left <= 1:
            break
        blocks_left = -(-blocks_left // block_rows)
        current = traded.filter("open").select(
            *columns, "copies",
            F.ceil(F.col("blocks") / block_rows).cast("long").alias("blocks"),
            F.floor(F.col("block") / block_rows).cast("long").alias("block"),
            (F.col("level") + 1).alias("level"),
        )
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``copies``
    and ``taken`` (``size * copies``), one row for each row of ``docs``.  Rows that
    agree in id, source and size are decided together and all get the same number of copies.
    A null source is a source of its own, null texts have size 0, null ids are kept; documents
    of size 0 get no fraction of a copy, but the whole part.  Only these three columns are read.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = written(sized, "sizes")
    targets = written(source_targets(sized, weights, share, most), "targets")
    keys = ["doc_id", "source", "size"]
    units = sized.groupBy(*keys).agg(F.count("*").alias("rows"))
    units = units.select("doc_id", "source", (F.col("size") * F.col("rows")).alias("size"), "rows")
    decided = copies_of(units, targets, seed, block_rows, unit=("doc_id", "rows"))
    decided = decided.select("*", F.when(F.col("rows") > 0, (F.col("size") / F.col("rows")).cast("long")).alias("_each"))
    again = decided.filter("rows > 1").withColumn("rows", F.explode(F.expr("sequence(1, cast(rows as int))")))
    every = decided.filter("rows = 1").unionByName(again.withColumn("rows", F.col("rows").cast("long")))
    joined = every.join(targets, same(every, targets, ["source"]), "left").drop(targets["source"])
    return joined.select(
        "doc_id", "source", F.col("_each").alias("size"), "source_size", "target", "copies",
        (F.col("_each") * F.col("copies")).alias("taken"),
    )
