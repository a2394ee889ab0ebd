"""Registered stream and tick queries, with the SQL of the same result in one go."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions import termination as term
from tidewatch.plans import tables
from tidewatch.plans.source_queries import ORACLES as SOURCE_SQL
from tidewatch.plans.source_queries import RECORDS_SQL, merged_sql
from tidewatch.plans.poll import PollResult, per_seed
from tidewatch.plans.spec import Watch, WatchSpec
from tidewatch.plans.tables import Days, PollLog
from tidewatch.plans.watch_queries import DAY_SQL, LOG_SQL, START_SQL
from tidewatch.sources import CountingSource, EmptySource
from tidewatch.streaming import dedup, files, splits, ticks
from tidewatch.streaming.increments import extend, follow, found, seen_keys
from tidewatch.streaming.progress import BatchLog, batches
from tidewatch.streaming.run import drained, each_batch, stream_session, write_available
from tidewatch.workspace import new_folder, written

# A snapshot poll sees eight more days than the one before; the last one sees them all.
SNAPSHOT_DAYS = 8
STEP = 7
# Waves of equal spans of offsets, each read by a run of its own.
WAVES = 5
BACKLOG_ROW = "n_records bigint, n_terminal bigint, last_off bigint, records_left bigint, bytes_left bigint"


def _snapshots(days: Days) -> int:
    """Snapshot polls until every event is listed; one at least."""
    return max(1, -(-days.last // SNAPSHOT_DAYS))


def _event_stream(session: SparkSession, sf_dir: str) -> DataFrame:
    return session.readStream.schema(tables.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


# --- sources -----------------------------------------------------------------


def source_read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read without an end, through Spark's own file stream."""
    session = stream_session(spark)
    return drained(spark, tables.records_of(_event_stream(session, sf_dir)), "source-read")


def source_counting_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stream_session(spark)
    session.dataSource.register(CountingSource)
    n = tables.events(spark, sf_dir).count()
    numbers = (
        session.readStream.format("counting_source").option("maxCount", n).option("numSplits", tables.SPLITS).load()
    )
    return drained(spark, numbers, "source-counting")


def source_empty_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty source merged with the events: it adds nothing and does not hold the stream up."""
    session = stream_session(spark)
    session.dataSource.register(EmptySource)
    empty = session.readStream.format("empty_source").load().withColumn("source_id", F.lit("empty"))
    events = _event_stream(session, sf_dir).select(
        F.col("event_id").cast("string").alias("value"), F.col("ts").alias("event_ts"), F.lit("events").alias("source_id")
    )
    return drained(spark, empty.unionByName(events), "source-empty")


def source_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stream_session(spark)
    records = tables.records_of(_event_stream(session, sf_dir))
    once = dedup.first_of_ids(records, ["source_id", "record_id"], "arrival_no")
    plain = once.select("source_id", "split_id", "off", "record_id", "value", "event_ts")
    return drained(spark, plain, "source-dedup")


def follow_waves(spark: SparkSession, sf_dir: str, root: str, read: Callable[[DataFrame], object]) -> StructType:
    """Read the records as a stream that has been read once when the second deliveries arrive."""
    session = stream_session(spark)
    records = tables.records_of(tables.events(spark, sf_dir))
    second = F.col("arrival_no") >= tables.REDELIVERED_SHIFT
    for wave in (records.filter(~second), records.filter(second)):
        wave.write.mode("append").parquet(f"{root}/in")
        read(session.readStream.schema(records.schema).parquet(f"{root}/in"))
    return records.schema


def _in_two_waves(spark: SparkSession, sf_dir: str, root: str, drop_repeats: bool = False) -> DataFrame:
    schema = follow_waves(spark, sf_dir, root, lambda stream: splits.follow(stream, f"{root}/read", drop_repeats))
    return splits.emitted(spark, f"{root}/read", schema)


def source_terminal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that end: what comes after a terminal record stays unread, also in a later run."""
    found = _in_two_waves(spark, sf_dir, new_folder(spark, "source-terminal"))
    return found.select("source_id", "split_id", "arrival_no", "off", "record_id", "value", "event_ts", "terminal")


def source_watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split has reported so far, carried over from run to run."""
    found = _in_two_waves(spark, sf_dir, new_folder(spark, "source-watermark"))
    return found.select("source_id", "split_id", "arrival_no", "source_wm", "watermark")


def source_merged_watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark of all splits together after each of two runs; the splits are known from the start."""
    root = new_folder(spark, "source-merged")
    expected = written(tables.records_of(tables.events(spark, sf_dir)).select("source_id", "split_id").distinct(), "expected")
    follow_waves(spark, sf_dir, root, lambda stream: splits.follow_merged(stream, f"{root}/read", expected))
    return splits.merged(spark, f"{root}/read").select(F.col("batch").alias("step"), "watermark", "done")


def source_offset_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that don't go beyond what their split has read before are left out, also in a later run."""
    found = _in_two_waves(spark, sf_dir, new_folder(spark, "source-offsets"), drop_repeats=True)
    return found.select("source_id", "split_id", "arrival_no", "off", "record_id", "value", "watermark")


def source_read_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the stream reports while it reads, over all its batches."""
    session = stream_session(spark)
    records = tables.records_of(_event_stream(session, sf_dir))
    root = new_folder(spark, "source-metrics")

    def count(batch: DataFrame, batch_id: int) -> None:
        counters = batch.agg(
            F.count("*").alias("n_records"),
            F.count_if("terminal").alias("n_terminal"),
            F.max("off").alias("last_off"),
            F.max(F.unix_micros(F.col("event_ts").cast("timestamp"))).alias("last_event_us"),
        )
        counters.write.mode("overwrite").parquet(f"{root}/counters/batch={batch_id}")

    each_batch(records, root, count)
    counters = spark.read.schema(
        "n_records bigint, n_terminal bigint, last_off bigint, last_event_us bigint"
    ).parquet(f"{root}/counters")
    return counters.agg(
        F.sum("n_records").alias("n_records"), F.sum("n_terminal").alias("n_terminal"),
        F.max("last_off").alias("last_off"), F.max("last_event_us").alias("last_event_us"),
    )


def source_backlog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch reports while the records arrive in waves of offsets, and what it leaves unread.

    The stream is started again for every wave; its log goes on.
    """
    session = stream_session(spark)
    root = new_folder(spark, "source-backlog")
    records = tables.records_of(tables.events(spark, sf_dir))
    counters = {
        "n_terminal": F.count_if("terminal"), "last_off": F.max("off"), "n_bytes": F.sum(F.octet_length("record_id")),
    }
    ends = records.agg(F.min("off"), F.max("off"), counters["n_bytes"], F.count("*")).first()
    first, last, n_bytes, n_records = ends
    if first is None:
        return spark.createDataFrame([], BACKLOG_ROW)
    placed = records.withColumn("wave", F.expr(f"(off - ({first}L)) div {(last - first) // WAVES + 1}L"))
    for number in range(WAVES):
        placed.filter(F.col("wave") == number).drop("wave").write.mode("append").parquet(f"{root}/in")
        with BatchLog(session, f"{root}/log", counters) as log:
            stream = log.observed(session.readStream.schema(records.schema).parquet(f"{root}/in"))
            write_available(stream, f"{root}/read", log.name)
    found = batches(spark, f"{root}/log", list(counters), {"n_records": n_records, "n_bytes": n_bytes})
    # A wave without offsets is a batch without records.
    return found.filter("n_records > 0").select(
        "n_records", "n_terminal", "last_off", F.col("left_n_records").alias("records_left"), F.col("left_n_bytes").alias("bytes_left")
    )


# --- watch -------------------------------------------------------------------


def watch_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stream_session(spark)
    outputs = PollLog(tables.events(spark, sf_dir)).outputs(_event_stream(session, sf_dir))
    once = dedup.first_of_keys(outputs, ["seed", "value"], "pos")
    return drained(spark, once.select("seed", "value"), "watch-dedup")


def watch_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is written by poll, then worked off in steps of seven polls."""
    root = new_folder(spark, "watch-incremental")
    polls = PollLog(tables.events(spark, sf_dir))
    outputs, last = polls.outputs(), polls.last_poll
    outputs.repartitionByRange("poll_no", "pos").write.partitionBy("poll_no").parquet(f"{root}/log")
    log = spark.read.schema(outputs.schema).parquet(f"{root}/log")
    with seen_keys(spark, root) as seen:
        for after in range(0, last, STEP):
            extend(log, root, after, min(after + STEP, last), seen=seen)
    return found(log, root) if last else log


def watch_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll log arrives in two waves and is followed as a stream, which restarts in between."""
    session = stream_session(spark)
    root = new_folder(spark, "watch-log")
    outputs = PollLog(tables.events(spark, sf_dir)).outputs()
    for wave in (outputs.filter("poll_no <= 15"), outputs.filter("poll_no > 15")):
        wave.write.mode("append").parquet(f"{root}/log")
        log = session.readStream.schema(outputs.schema).parquet(f"{root}/log")
        follow(log, f"{root}/watch").awaitTermination()
    return found(outputs, f"{root}/watch")


def snapshot_poll(sf_dir: str, days: Days):
    """A poll of all seeds in one job: every event up to the poll's day, as a full listing."""

    def poll(seeds: DataFrame, poll_no: int, poll_ts: datetime) -> DataFrame:
        events = tables.events(seeds.sparkSession, sf_dir)
        known = events.filter(days.number("ts") <= poll_no * SNAPSHOT_DAYS)
        listed = known.select(
            F.col("event_type").alias("seed"),
            F.col("event_id").alias("pos"),
            F.col("user_id").alias("value"),
            F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("event_ts"),
        ).join(seeds.select("seed"), ["seed"], "left_semi")
        headers = seeds.select("seed", F.lit(False).alias("complete"))
        return listed.unionByName(headers, allowMissingColumns=True).withColumn(
            "watermark", F.lit(None).cast("timestamp_ntz")
        )

    return poll


def _snapshot_spec(sf_dir: str, days: Days) -> WatchSpec:
    return (
        Watch.growth_of(snapshot_poll(sf_dir, days))
        .with_poll_interval(0.1)
        .with_max_completed_size(None)
        .with_termination_per_input(term.after_iterations(_snapshots(days)))
    )


def _snapshot_ticks(spark: SparkSession, log: PollLog, root: str, spec: WatchSpec) -> ticks.Ticks:
    start = datetime.combine(log.days.first, time())
    clock = lambda poll_no: start + timedelta(days=poll_no * SNAPSHOT_DAYS)
    return ticks.Ticks(spark, spec, lambda _: log.seeds(), root, clock)


def watch_live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running watch: the stream's clock polls until every seed has stopped."""
    log = PollLog(tables.events(spark, sf_dir))
    watch = _snapshot_ticks(spark, log, new_folder(spark, "watch-live"), _snapshot_spec(sf_dir, log.days))
    if not ticks.run(watch, timeout=3600):
        raise RuntimeError("the watch did not end")
    return watch.emitted().select("seed", "poll_no", "pos", "value", "discovered_ts")


def watch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick is worked off twice, as after a crash: nothing may change."""
    log = PollLog(tables.events(spark, sf_dir))
    watch = _snapshot_ticks(spark, log, new_folder(spark, "watch-replay"), _snapshot_spec(sf_dir, log.days))
    for poll_no in range(1, _snapshots(log.days) + 1):
        watch.tick(poll_no)
        watch.tick(poll_no)
    watch.close()
    return watch.emitted().select("seed", "poll_no", "pos", "value", "discovered_ts")


class Harvests(term.StatefulTermination):
    """Stop after three polls that had new outputs."""

    name = "harvests"

    def for_new_input(self, now: datetime, seed: str) -> int:
        return 0

    def on_seen_new_output(self, now: datetime, state: int) -> int:
        return state + 1

    def can_stop_polling(self, now: datetime, state: int) -> bool:
        return state >= 3


def term_custom_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live watch whose stop condition keeps a state of its own per seed."""
    log = PollLog(tables.events(spark, sf_dir))
    polls = _snapshots(log.days)
    spec = _snapshot_spec(sf_dir, log.days).with_termination_per_input(
        term.either_of(Harvests(), term.after_iterations(polls))
    )
    watch = _snapshot_ticks(spark, log, new_folder(spark, "watch-custom"), spec)
    for poll_no in range(1, polls + 1):
        watch.tick(poll_no)
    watch.close()
    return watch.emitted().select("seed", "poll_no", "pos", "value", "discovered_ts")


def term_custom_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition with a state of its own over a recorded poll log."""
    log = PollLog(tables.events(spark, sf_dir))
    stop = term.either_of(Harvests(), term.after_iterations(20))
    spec = Watch.growth_of().with_termination_per_input(stop).with_max_completed_size(None)
    return spec.over_log(log.seeds(), log.polls(), log.outputs()).outputs


def watch_folders_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that fill up, watched for sixteen days; the watch starts anew at every poll and ends by itself."""
    root = new_folder(spark, "watch-folders")
    log = PollLog(tables.events(spark, sf_dir))
    folder = F.concat(F.lit(f"{root}/incoming/event_type="), F.col("seed"))
    seeds = written(log.seeds().select(folder.alias("seed"), "added_at", F.lit(None).cast("timestamp_ntz").alias("event_ts")), "folders")
    spec = (
        Watch.growth_of(files.folder_poll("*.parquet")).with_max_completed_size(None)
        .with_termination_per_input(term.after_total_of(timedelta(days=2 * SNAPSHOT_DAYS)))
    )
    start = datetime.combine(log.days.first, time())
    clock = lambda poll_no: start + timedelta(days=poll_no * SNAPSHOT_DAYS)
    listed = log.events.select("event_type", "event_id", log.days.number("ts").alias("day"))
    poll_no, active = 0, True
    while active:
        poll_no += 1
        wave = listed.filter(F.ceil(F.col("day") / SNAPSHOT_DAYS) == poll_no)
        wave.repartitionByRange("event_type", "day", "event_id").write.mode("append").partitionBy("event_type", "day").parquet(f"{root}/incoming")
        watch = ticks.Ticks(spark, spec, lambda _: seeds, f"{root}/watch", clock)
        watch.tick(poll_no)
        active = watch.active(poll_no)
        watch.close()
    part = "event_type=([^/]+)/day=([0-9]+)/"
    found = watch.emitted().select(
        F.regexp_extract("value", part, 1).alias("event_type"), F.regexp_extract("value", part, 2).cast("int").alias("day"), "poll_no")
    # A hot folder may hold several files, so the folders are counted once.
    return found.distinct()


def listed_days(folder: str) -> PollResult:
    """What a folder holds now: the names of its subfolders, as one Arrow array."""
    found, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    inside = found.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted(info.base_name for info in inside if info.type == fs.FileType.Directory)
    return PollResult.of(pa.array(names, pa.string()))


def watch_own_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that fill up, listed in Python, several at once; names of odd length are asked at every other tick."""
    root = new_folder(spark, "watch-pace")
    log = PollLog(tables.events(spark, sf_dir))
    folder = F.concat(F.lit(f"{root}/incoming/event_type="), F.col("seed"))
    pace = (F.length("seed") % 2 + 1) * SNAPSHOT_DAYS
    seeds = written(log.seeds().select(
        folder.alias("seed"), "added_at", F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.make_dt_interval(pace).alias("poll_every")
    ), "folders")
    spec = Watch.growth_of(per_seed(listed_days, "string", at_once=8)).with_max_completed_size(None)
    start = datetime.combine(log.days.first, time())
    watch = ticks.Ticks(spark, spec, lambda _: seeds, f"{root}/watch", lambda n: start + timedelta(days=n * SNAPSHOT_DAYS))
    listed = log.events.select("event_type", "event_id", log.days.number("ts").alias("day"))
    # One tick more than it takes to list all days, for those that wait at the last one.
    for poll_no in range(1, _snapshots(log.days) + 2):
        wave = listed.filter(F.ceil(F.col("day") / SNAPSHOT_DAYS) == poll_no)
        wave.repartitionByRange("event_type", "day", "event_id").write.mode("append").partitionBy("event_type", "day").parquet(f"{root}/incoming")
        watch.tick(poll_no)
    watch.close()
    return watch.emitted().select(
        F.regexp_extract("seed", "event_type=([^/]+)", 1).alias("event_type"),
        F.regexp_extract("value", "day=([0-9]+)", 1).cast("int").alias("day"), "poll_no", "discovered_ts",
    )


def watch_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that appear in a folder in two waves; the stream restarts in between."""
    session = stream_session(spark)
    root = new_folder(spark, "watch-files")
    events = tables.events(spark, sf_dir)
    events = events.withColumn("day", tables.days_of(events).number("ts"))
    for wave in (events.filter("day <= 15"), events.filter("day > 15")):
        wave.select("event_type", "event_id", "day").repartitionByRange("event_type", "day", "event_id").write.mode("append").partitionBy(
            "event_type", "day"
        ).parquet(f"{root}/incoming")
        write_available(files.new_files(session, f"{root}/incoming", "*.parquet"), f"{root}/watch")
    found = spark.read.parquet(f"{root}/watch/rows")
    folder = F.regexp_extract("value", "event_type=([^/]+)/day=([0-9]+)/", 1)
    day = F.regexp_extract("value", "event_type=([^/]+)/day=([0-9]+)/", 2)
    # A hot folder may hold several files, so the folders are counted once.
    return found.select(folder.alias("event_type"), day.cast("int").alias("day")).distinct()


QUERIES = {
    "source_read_stream": source_read_stream,
    "source_counting_stream": source_counting_stream,
    "source_empty_stream": source_empty_stream,
    "source_dedup_stream": source_dedup_stream,
    "source_read_metrics": source_read_metrics,
    "source_backlog_stream": source_backlog_stream,
    "source_terminal_stream": source_terminal_stream,
    "source_watermark_stream": source_watermark_stream,
    "watch_dedup_stream": watch_dedup_stream,
    "watch_incremental": watch_incremental,
    "watch_log_stream": watch_log_stream,
    "watch_replay": watch_replay,
    "term_custom_live": term_custom_live,
    "term_custom_log": term_custom_log,
    "watch_folders_until": watch_folders_until,
    "watch_own_pace": watch_own_pace,
    "source_offset_dedup_stream": source_offset_dedup_stream,
    "source_merged_watermark_stream": source_merged_watermark_stream,
    "watch_live_stream": watch_live_stream,
    "watch_files_stream": watch_files_stream,
}

SNAPSHOT_SQL = f"""
select seed, poll_no, pos, value, coalesce(event_ts, start + to_days({SNAPSHOT_DAYS} * poll_no)) as discovered_ts
from (select *, row_number() over (partition by seed, value order by poll_no, pos) as rn
      from (select event_type as seed, cast(ceil({DAY_SQL} / {SNAPSHOT_DAYS}) as int) as poll_no, event_id as pos,
                   user_id as value, case when event_id % 3 <> 0 then ts end as event_ts, {START_SQL} as start
            from events))
where rn = 1"""

FIRST_SEEN_SQL = LOG_SQL + """
select seed, poll_no, pos, value, event_ts
from (select *, row_number() over (partition by seed, value order by poll_no, pos) as rn from poll_outputs)
where rn = 1"""

ORACLES = {
    "source_read_stream": RECORDS_SQL + "select * from source_records",
    "source_counting_stream": """
select i as value, timestamp '1970-01-01 00:00:00' + to_seconds(i) as event_ts, i = n - 1 as terminal
from (select unnest(range(0, (select count(*) from events))) as i, (select count(*) from events) as n)""",
    "source_empty_stream": """
select cast(event_id as varchar) as value, ts as event_ts, 'events' as source_id from events""",
    "source_dedup_stream": RECORDS_SQL + """
select source_id, split_id, off, record_id, value, event_ts
from (select *, row_number() over (partition by source_id, record_id order by arrival_no) as rn from source_records)
where rn = 1""",
    "source_read_metrics": RECORDS_SQL + """
select count(*) as n_records, max(off) as last_off, epoch_us(max(event_ts)) as last_event_us,
       count(*) filter (where terminal) as n_terminal
from source_records""",
    "source_backlog_stream": RECORDS_SQL + f""",
ends as (select min(off) as first_off, max(off) as last_off from source_records),
saved as (
  select (off - first_off) // ((ends.last_off - first_off) // {WAVES} + 1) as wave, count(*) as n_records,
         count(*) filter (where terminal) as n_terminal, max(off) as last_off
  from source_records cross join ends group by wave)
select s.n_records, s.n_terminal, s.last_off, count(r.off) as records_left,
       cast(coalesce(sum(octet_length(encode(r.record_id))), 0) as bigint) as bytes_left
from saved s left join source_records r on r.off > s.last_off
group by all""",
    "source_terminal_stream": SOURCE_SQL["source_terminal"],
    "source_watermark_stream": RECORDS_SQL + """,
cut as (
  select *, coalesce(max(cast(terminal as int)) over (partition by source_id, split_id order by arrival_no
                     rows between unbounded preceding and 1 preceding), 0) as ended
  from source_records)
select source_id, split_id, arrival_no, source_wm,
       max(source_wm) over (partition by source_id, split_id order by arrival_no rows unbounded preceding) as watermark
from cut where ended = 0""",
    "watch_dedup_stream": LOG_SQL + "select distinct seed, value from poll_outputs",
    "watch_incremental": FIRST_SEEN_SQL,
    "watch_log_stream": FIRST_SEEN_SQL,
    "term_custom_live": f"""
with fresh as ({SNAPSHOT_SQL}),
snaps as (select cast(greatest(1, ceil(max({DAY_SQL}) / {SNAPSHOT_DAYS})) as int) as last from events),
polls as (select seed, poll_no, count(f.value) as n_new
          from (select distinct seed from fresh) s cross join (select cast(unnest(range(1, (select max(last) from snaps) + 1)) as int) as poll_no) n
          left join fresh f using (seed, poll_no) group by seed, poll_no),
harvests as (select *, sum(cast(n_new > 0 as int)) over (partition by seed order by poll_no) as had from polls),
stops as (select seed, min(poll_no) as stop_at from harvests where had >= 3 or poll_no = (select max(last) from snaps) group by seed)
select f.* from fresh f join stops s on f.seed = s.seed where f.poll_no <= s.stop_at""",
    "term_custom_log": LOG_SQL + """,
harvests as (
  select *, sum(cast(n_new > 0 as int)) over (partition by seed order by poll_no rows unbounded preceding) as had from c),
ends as (select seed, min(case when done or had >= 3 or poll_no >= 20 then poll_no end) as stop_at from harvests group by seed)
select n.* exclude (emit_no) from n join ends e on n.seed = e.seed where e.stop_at is null or n.poll_no <= e.stop_at""",
    "watch_folders_until": f"""
select distinct event_type, cast({DAY_SQL} as int) as day, cast(ceil({DAY_SQL} / {SNAPSHOT_DAYS}) as int) as poll_no
from events where ceil({DAY_SQL} / {SNAPSHOT_DAYS}) <= 3""",
    "watch_own_pace": f"""
with listed as (select distinct event_type, cast({DAY_SQL} as int) as day, cast(ceil({DAY_SQL} / {SNAPSHOT_DAYS}) as int) as tick,
                       length(event_type) % 2 + 1 as pace, {START_SQL} as start from events),
found as (select *, cast(1 + pace * ceil((tick - 1) / pace) as int) as poll_no from listed)
select event_type, day, poll_no, start + to_days({SNAPSHOT_DAYS} * poll_no) as discovered_ts from found""",
    "source_offset_dedup_stream": RECORDS_SQL + """,
cut as (
  select *, coalesce(max(cast(terminal as int)) over (partition by source_id, split_id order by arrival_no
                     rows between unbounded preceding and 1 preceding), 0) as ended
  from source_records),
tops as (
  select *, max(off) over (partition by source_id, split_id order by arrival_no
                           rows between unbounded preceding and 1 preceding) as top,
         max(source_wm) over (partition by source_id, split_id order by arrival_no rows unbounded preceding) as watermark
  from cut where ended = 0)
select source_id, split_id, arrival_no, off, record_id, value, watermark from tops where top is null or off > top""",
    "source_merged_watermark_stream": merged_sql(f"cast(arrival_no >= {tables.REDELIVERED_SHIFT} as bigint)"),
    "watch_replay": SNAPSHOT_SQL,
    "watch_live_stream": SNAPSHOT_SQL,
    "watch_files_stream": f"select distinct event_type, cast({DAY_SQL} as int) as day from events",
}
