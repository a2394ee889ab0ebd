"""First-seen with a bounded memory: at most ``cap`` keys per seed, oldest forgotten first.

A forgotten key is emitted again when it is listed again, so what poll k emits depends
on what all earlier polls emitted.  Still the log of a seed is replayed in parallel: it is
cut into ranges of rows, and each is replayed from a guess of what is remembered where it
begins.  The guess is right if no key came back after it was forgotten.  Then every border
is checked: a range that began with other keys than the range before it ended with is
replayed from those.  Ranges may guess wrong a few times; what is wrong then is replayed in
order, one stream of rows per seed from its first wrong range on.  A task holds
``2 * cap`` keys at most, and as many read for a start, however many rows a poll or a seed has and however wide they are.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidewatch.functions.keys import key_digest
from tidewatch.operators.first_seen import first_in_poll, first_seen
from tidewatch.operators.polls import with_discovery_time
from tidewatch.operators.running import position_in_group, running_max
from tidewatch.workspace import new_folder, written

#: Rows of a range; eight times the memory if that is more, so that guesses stay below a quarter of the log.
RANGE_ROWS = 100_000
#: How often ranges are replayed side by side before the wrong ones are replayed in order.
GUESSES = 4

HEAD, HELD, ROW = 0, 1, 2  # what a task is given for a range, in this order
NEW, KEPT, BEGAN, ENDED = 0, 1, 2, 3  # what it answers


def bounded_first_seen(
    outputs: DataFrame,
    polls: DataFrame,
    cap: int | None,
    key: Sequence[str] = ("value",),
    range_rows: int | None = None,
    guesses: int = GUESSES,
) -> DataFrame:
    """New outputs per poll under a memory of ``cap`` keys per seed; ``None`` is unbounded.

    Result: the columns of ``outputs`` with ``discovered_ts`` in place of ``event_ts``.
    """
    if cap is None:
        return with_discovery_time(first_seen(outputs, key), polls)
    if cap == 0:
        return with_discovery_time(first_in_poll(outputs, key), polls)
    size = range_rows or max(RANGE_ROWS, 8 * cap)
    listed = with_discovery_time(first_in_poll(outputs, key), polls)
    # Written, since a range partitioning reads what it sorts twice.
    keyed = written(listed.withColumn("_key", key_digest(*key)), "listed")
    ordered = position_in_group(keyed, ["seed"], ["poll_no", "discovered_ts", "pos"], "_n")
    log = ordered.select("seed", _range_of("_n", size), F.col("poll_no").cast("long").alias("_poll"), "_n", "_key")
    new = _replayed(written(log, "log"), cap, size, guesses)
    return ordered.join(new, ["seed", "_n"], "left_semi").select(*listed.columns)


def _range_of(n: str, size: int):
    return F.floor((F.col(n) - 1) / size).cast("long").alias("_range")


def _replayed(log: DataFrame, cap: int, size: int, guesses: int) -> DataFrame:
    """``seed`` and ``_n`` of the new rows of ``log(seed, _range, _poll, _n, _key)``."""
    spark = log.sparkSession
    folder = new_folder(spark, "bounded")
    # One row per range, so one window per seed has a row per 100,000 of the log.
    following = F.lead("_poll").over(Window.partitionBy("seed").orderBy("_range"))
    begins = log.groupBy("seed", "_range").agg(F.min("_poll").alias("_poll"))
    heads = written(begins.select("seed", "_range", following.alias("_next")), "ranges")
    several = not heads.filter("_range > 0").isEmpty()
    schema = StructType([
        log.schema["seed"], StructField("_range", LongType()), StructField("_kind", IntegerType()),
        StructField("_poll", LongType()), StructField("_n", LongType()), StructField("_key", StringType()),
    ])
    answers = spark.read.schema(StructType([*schema.fields, StructField("round", LongType())]))

    redo, held = heads.withColumn("_chain", F.col("_range")), _guessed(log, heads, cap, size) if several else None
    valid = None
    for turn in range(guesses + 1):
        given = redo.select("seed", "_range", "_chain", F.lit(HEAD).alias("_kind"), F.col("_next").alias("_poll"))
        chains = redo.select("seed", "_range", "_chain")
        for rows, kind in ((held, HELD), (log, ROW)):
            if rows is not None:
                rows = rows.join(chains, ["seed", "_range"]).withColumn("_kind", F.lit(kind))
                given = given.unionByName(rows, allowMissingColumns=True)
        given = given.repartition("seed", "_chain").sortWithinPartitions("seed", "_chain", "_range", "_kind", "_n")
        given = given.select("seed", "_range", "_chain", "_kind", "_poll", "_n", "_key")
        given.mapInArrow(_replay(cap), schema).write.parquet(f"{folder}/round={turn}")

        done = answers.parquet(folder)
        if not several:
            return done.filter(f"_kind = {NEW}").select("seed", "_n")
        borders = done.filter(f"round = {turn} and _kind in ({BEGAN}, {ENDED})").groupBy("seed", "_range").agg(
            F.max(F.when(F.col("_kind") == BEGAN, F.col("_key"))).alias("_began"),
            F.max(F.when(F.col("_kind") == ENDED, F.col("_key"))).alias("_ended"),
            F.lit(turn).cast("long").alias("round"),
        )
        if valid is not None:
            borders = borders.unionByName(valid.join(redo.select("seed", "_range"), ["seed", "_range"], "left_anti"))
        valid = written(borders, "borders")
        before = valid.select("seed", (F.col("_range") + 1).alias("_range"), F.col("_ended").alias("_before"))
        wrong = valid.join(before, ["seed", "_range"]).filter("_began <> _before").select("seed", "_range")
        if wrong.isEmpty():
            break
        if turn == guesses - 1:  # from now on in order
            first = wrong.groupBy("seed").agg(F.min("_range").alias("_chain"))
            redo = heads.join(first, "seed").filter("_range >= _chain")
        else:
            redo = heads.join(wrong, ["seed", "_range"]).withColumn("_chain", F.col("_range"))
        redo = written(redo, "redo")
        starts = redo.filter("_range = _chain").select("seed", (F.col("_range") - 1).alias("_range"))
        ends = valid.select("seed", "_range", "round").join(starts, ["seed", "_range"])
        held = done.filter(f"_kind = {KEPT}").join(ends, ["seed", "_range", "round"])
        held = held.select("seed", (F.col("_range") + 1).alias("_range"), "_poll", "_n", "_key")
    new = answers.parquet(folder).filter(f"_kind = {NEW}")
    return new.join(valid.select("seed", "_range", "round"), ["seed", "_range", "round"]).select("seed", "_n")


def _guessed(log: DataFrame, heads: DataFrame, cap: int, size: int) -> DataFrame:
    """What is remembered where ranges begin if no key comes back: the keys that were first listed last.

    Twice ``cap`` of them, as a range that begins within a poll needs those of the poll and those before it.
    """
    first = log.groupBy("seed", "_key").agg(F.min("_n").alias("_n"), F.min("_poll").alias("_poll"))
    ranked = position_in_group(first, ["seed"], ["_n"], "_rank")
    tops = ranked.groupBy("seed", _range_of("_n", size)).agg(F.max("_rank").alias("_top"))
    tops = heads.select("seed", "_range").join(tops, ["seed", "_range"], "left")
    known = running_max(tops, ["seed"], "_range", before={"_seen": F.col("_top")}, levels=1).filter("_range > 0")
    near = F.floor(F.col("_seen") / (2 * cap))
    known = known.select("seed", "_range", "_seen", F.explode(F.array(near, near - 1)).alias("_bucket"))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_rank") / (2 * cap)))
    found = known.join(ranked, ["seed", "_bucket"]).filter(f"_rank <= _seen and _rank > _seen - {2 * cap}")
    return found.select("seed", "_range", "_poll", "_n", "_key")


class Memory:
    """The keys that a seed remembers, oldest first: of earlier polls, and the new ones of the current poll."""

    def __init__(self, cap: int):
        self.cap = cap
        self.keys: set[str] = set()
        self.order: deque[tuple[int, str]] = deque()
        self.fresh: deque[tuple[int, str]] = deque(maxlen=cap)
        self.poll: int | None = None

    def enter(self, poll: int) -> None:
        """Go on to ``poll``.  Nothing is forgotten before a poll has ended."""
        if poll != self.poll:
            self._remember(self.fresh)
            self.fresh.clear()
            self.poll = poll

    def _remember(self, entries) -> None:
        self.order.extend(entries)
        self.keys.update(key for _, key in entries)
        while len(self.order) > self.cap:
            self.keys.discard(self.order.popleft()[1])

    def load(self, held: list[tuple[int | None, int, str]], poll: int) -> None:
        """Take over (poll, number, key) of what is remembered where rows of ``poll`` follow."""
        self._remember([(n, key) for of, n, key in held if of != poll])
        self.fresh.extend((n, key) for of, n, key in held if of == poll)
        self.poll = poll

    def digest(self) -> str:
        """Equal for memories that will act alike: the same keys in the same order."""
        parts = (",".join(key for _, key in part) for part in (self.order, self.fresh))
        return hashlib.md5(";".join(parts).encode()).hexdigest()

    def take(self, polls: Sequence[int], numbers: Sequence[int], keys: Sequence[str]) -> list[bool]:
        """Which rows are new.  They come in emit order, each key once per poll."""
        known, fresh, new = self.keys, self.fresh, []
        for poll, n, key in zip(polls, numbers, keys):
            if poll != self.poll:
                self.enter(poll)
            if key in known:
                new.append(False)
            else:
                new.append(True)
                fresh.append((n, key))
        return new


def _replay(cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replay sorted ranges: a head row, what is held at the begin of a chain of ranges, then rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memory, chain, at, following, held, begun = None, None, None, None, None, [], False
        borders: list[tuple] = []  # rows of ``schema`` on what was remembered at the ends of ranges

        def end() -> None:
            # Nobody asks what is remembered after the last range of a seed.
            if following is not None:
                memory.enter(following)
                borders.extend((*at, KEPT, None, n, key) for n, key in memory.order)
                borders.extend((*at, KEPT, memory.poll, n, key) for n, key in memory.fresh)
                borders.append((*at, ENDED, None, None, memory.digest()))

        def at_borders() -> pa.RecordBatch:
            columns = list(zip(*borders)) or [()] * len(schema)
            borders.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("seed", batch.schema.field("seed").type), ("_range", pa.int64()), ("_kind", pa.int32()),
                ("_poll", pa.int64()), ("_n", pa.int64()), ("_key", pa.string()),
            ])
            kinds = batch["_kind"].to_numpy()
            new = np.zeros(len(kinds), bool)
            changes = np.flatnonzero(np.append(kinds[1:] != kinds[:-1], True)) + 1
            # Two heads never follow each other, as every range has rows.
            for start, stop in zip([0, *changes[:-1]], changes):
                part = batch.slice(start, stop - start)
                polls = part["_poll"].to_pylist()
                if kinds[start] == HEAD:
                    end()
                    at = (part["seed"][0].as_py(), part["_range"][0].as_py())
                    following, held, begun = polls[0], [], False
                    if (at[0], part["_chain"][0].as_py()) != chain:
                        chain, memory = (at[0], part["_chain"][0].as_py()), Memory(cap)
                    continue
                numbers, keys = part["_n"].to_pylist(), part["_key"].to_pylist()
                if kinds[start] == HELD:
                    held += zip(polls, numbers, keys)
                    continue
                if not begun:
                    if held:
                        memory.load(held, polls[0])
                    memory.enter(polls[0])
                    borders.append((*at, BEGAN, None, None, memory.digest()))
                    held, begun = [], True
                new[start:stop] = memory.take(polls, numbers, keys)
            found = batch.filter(pa.array(new))
            nothing = [pa.nulls(len(found), t) for t in (pa.int64(), pa.string())]
            kind = pa.array(np.full(len(found), NEW, np.int32))
            yield pa.RecordBatch.from_arrays(
                [found["seed"], found["_range"], kind, nothing[0], found["_n"], nothing[1]], schema=schema)
            if borders:
                yield at_borders()
        end()
        if borders:
            yield at_borders()

    return run


def admit(listed: DataFrame, memory: DataFrame, folder: str | None = None) -> DataFrame:
    """New outputs of one poll with ``idx``, their insertion number per seed.

    ``listed`` has one row per seed and ``key_hash``; ``memory(seed, key_hash, idx)`` are
    the keys remembered so far.  The newest key is always remembered, so the largest
    ``idx`` of a seed is the number of its insertions so far.  The new outputs are
    written, to ``folder`` if given.
    """
    new = listed.join(memory.select("seed", "key_hash"), ["seed", "key_hash"], "left_anti")
    numbered = position_in_group(new, ["seed"], ["discovered_ts", "pos"], "_n", folder)
    inserted = memory.groupBy("seed").agg(F.max("idx").alias("_inserted"))
    return numbered.join(inserted, ["seed"], "left").select(
        *listed.columns, (F.coalesce("_inserted", F.lit(0)) + F.col("_n")).alias("idx")
    )


def forget(memory: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """What is remembered after a poll: the ``cap`` latest insertions per seed."""
    every = memory.unionByName(new.select("seed", "key_hash", "idx"))
    last = every.groupBy("seed").agg(F.max("idx").alias("_last"))
    return every.join(last, ["seed"]).filter(F.col("idx") > F.col("_last") - cap).drop("_last")
