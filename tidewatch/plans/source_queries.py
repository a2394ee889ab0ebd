"""Registered queries over source records derived from ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import records as ops
from tidewatch.plans import tables

RECORD = ("source_id", "split_id", "arrival_no", "off", "record_id", "value", "event_ts")
STEP_BITS = 8
DEDUP_SOURCES = ("click", "purchase", "signup")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.records_of(tables.events(spark, sf_dir))


def source_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split_counts(_records(spark, sf_dir))


def source_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return ops.resume(records, tables.checkpoints(records)).select(*RECORD)


def source_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.until_terminal(_records(spark, sf_dir)).select(*RECORD, "terminal")


def source_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.events(spark, sf_dir).select(
        F.col("event_id").alias("off"), "value", F.col("ts").alias("event_ts")
    )
    return ops.union_sources({"events": events, "empty": ops.empty_source(spark, events.schema)})


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.events(spark, sf_dir).select(
        F.col("event_id").alias("off"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("record_id"),
        "value",
        F.col("ts").alias("event_ts"),
    )
    orders = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("off"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("event_ts"),
    )
    return ops.union_sources({"events": events, "orders": orders})


def source_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counting_source(spark, tables.events(spark, sf_dir).count())


def source_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    tagged = ops.tag_record_ids(records, F.col("source_id").isin(*DEDUP_SOURCES))
    return ops.backlog_bytes(tagged, tables.checkpoints(records), F.octet_length("record_id"))


def source_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    untimed = F.when(F.col("off") % 3 != 0, F.col("event_ts"))
    return ops.with_event_time(_records(spark, sf_dir).withColumn("event_ts", untimed)).select(*RECORD)


def source_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.monotone_watermark(_records(spark, sf_dir)).select(
        "source_id", "split_id", "arrival_no", "source_wm", "watermark"
    )


def source_merged_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark of all splits together after every 256 deliveries."""
    return ops.merged_watermark(_records(spark, sf_dir), F.shiftright("arrival_no", STEP_BITS))


def source_watermark_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return ops.resume_watermark(records, tables.checkpoints(records)).select(
        "source_id", "split_id", "arrival_no", "source_wm", "watermark"
    )


def source_record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tag_record_ids(_records(spark, sf_dir), F.col("source_id").isin(*DEDUP_SOURCES)).select(*RECORD)


def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup_by_id(_records(spark, sf_dir).select(*RECORD))


def source_offset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup_by_offset(_records(spark, sf_dir).select(*RECORD))


def source_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return ops.progress(records, tables.checkpoints(records))


QUERIES = {
    "source_split_counts": source_split_counts,
    "source_resume": source_resume,
    "source_terminal": source_terminal,
    "source_empty": source_empty,
    "source_union": source_union,
    "source_counting": source_counting,
    "source_backlog": source_backlog,
    "source_event_time": source_event_time,
    "source_watermark": source_watermark,
    "source_watermark_resume": source_watermark_resume,
    "source_merged_watermark": source_merged_watermark,
    "source_record_id": source_record_id,
    "source_dedup": source_dedup,
    "source_offset_dedup": source_offset_dedup,
    "source_progress": source_progress,
}

# ---------------------------------------------------------------------------
# SQL
# ---------------------------------------------------------------------------

RECORDS_SQL = """
with source_records as (
  select event_type as source_id, cast(user_id % 4 as int) as split_id, event_id as arrival_no,
         event_id as off, concat('r', cast(event_id as varchar)) as record_id, value, ts as event_ts,
         ts - to_seconds(cast((event_id * 7919) % 3600 as int)) as source_wm,
         (event_type = 'purchase' and value > 200) as terminal
  from events
  union all
  select event_type, cast(user_id % 4 as int), event_id + 4611686018427387904, event_id,
         concat('r', cast(event_id as varchar)), value, ts,
         ts - to_seconds(cast((event_id * 7919) % 3600 as int)), false
  from events where event_id % 10 = 0),
checkpoints as (
  select source_id, split_id, cast(floor(max(off) * 0.4) as bigint) as off,
         max(case when off <= reach then source_wm end) as watermark
  from (select *, cast(floor(max(off) over (partition by source_id, split_id) * 0.4) as bigint) as reach
        from source_records) group by source_id, split_id),
tagged as (
  select * replace (case when source_id in ('click', 'purchase', 'signup') then record_id end as record_id)
  from source_records),
unread as (
  select r.*, k.off as checkpoint_off, k.watermark as checkpoint_wm
  from source_records r left join checkpoints k on r.source_id = k.source_id and r.split_id = k.split_id
  where k.off is null or r.off > k.off)
"""
_RECORD = "source_id, split_id, arrival_no, off, record_id, value, event_ts"
_ARRIVAL = "partition by source_id, split_id order by arrival_no rows"


def merged_sql(step: str) -> str:
    """All splits at all steps: what each has reported by then, and whether it has ended."""
    return RECORDS_SQL + f""",
numbered as (select *, {step} as step from source_records),
cut as (
  select *, coalesce(max(cast(terminal as int)) over (partition by source_id, split_id order by arrival_no
                     rows between unbounded preceding and 1 preceding), 0) as ended
  from numbered),
by_step as (select source_id, split_id, step, max(source_wm) as wm, max(cast(coalesce(terminal, false) as int)) as ended
            from cut where ended = 0 group by all),
grid as (select * from (select distinct source_id, split_id from by_step) cross join (select distinct step from by_step)),
so_far as (
  select step, max(wm) over w as wm, coalesce(max(ended) over w, 0) as ended
  from grid left join by_step using (source_id, split_id, step)
  window w as (partition by source_id, split_id order by step rows unbounded preceding))
select step, min(ended) = 1 as done,
       case when count(*) filter (where ended = 0 and wm is null) = 0 then min(wm) filter (where ended = 0) end as watermark
from so_far group by step"""


ORACLES = {
    "source_split_counts": RECORDS_SQL + """
select source_id, split_id, count(*) as n_records, max(off) as last_off
from source_records group by source_id, split_id""",
    "source_resume": RECORDS_SQL + f"select {_RECORD} from unread",
    "source_terminal": RECORDS_SQL + f"""
select {_RECORD}, terminal
from (select *, coalesce(max(cast(terminal as int)) over ({_ARRIVAL} between unbounded preceding and 1 preceding),
                         0) as ended
      from source_records)
where ended = 0""",
    "source_empty": "select event_id as off, value, ts as event_ts, 'events' as source_id from events",
    "source_union": """
select event_id as off, concat('e', cast(event_id as varchar)) as record_id, value, ts as event_ts,
       'events' as source_id from events
union all
select o_orderkey, concat('o', cast(o_orderkey as varchar)), o_totalprice, o_orderdate, 'orders' from orders""",
    "source_counting": """
select i as value, timestamp '1970-01-01 00:00:00' + to_seconds(i) as event_ts, i = n - 1 as terminal
from (select unnest(range(0, (select count(*) from events))) as i, (select count(*) from events) as n)""",
    "source_backlog": RECORDS_SQL + """
select r.source_id, r.split_id,
       cast(case when bool_or(r.off > k.off and r.record_id is null) then -1
                 else sum(case when r.off > k.off then octet_length(encode(r.record_id)) else 0 end)
            end as bigint) as backlog_bytes
from tagged r join checkpoints k on r.source_id = k.source_id and r.split_id = k.split_id
group by r.source_id, r.split_id""",
    "source_event_time": RECORDS_SQL + """
select source_id, split_id, arrival_no, off, record_id, value,
       coalesce(case when off % 3 <> 0 then event_ts end, timestamp '1970-01-01 00:00:00') as event_ts
from source_records""",
    "source_watermark": RECORDS_SQL + f"""
select source_id, split_id, arrival_no, source_wm, max(source_wm) over ({_ARRIVAL} unbounded preceding) as watermark
from source_records""",
    "source_merged_watermark": merged_sql(f"arrival_no >> {STEP_BITS}"),
    "source_watermark_resume": RECORDS_SQL + f"""
select source_id, split_id, arrival_no, source_wm,
       greatest(checkpoint_wm, max(source_wm) over ({_ARRIVAL} unbounded preceding)) as watermark
from unread""",
    "source_record_id": RECORDS_SQL + f"select {_RECORD} from tagged",
    "source_dedup": RECORDS_SQL + f"""
select {_RECORD}
from (select *, row_number() over (partition by source_id, record_id order by arrival_no) as rn from source_records)
where rn = 1""",
    "source_offset_dedup": RECORDS_SQL + f"""
select {_RECORD}
from (select *, max(off) over ({_ARRIVAL} between unbounded preceding and 1 preceding) as top from source_records)
where top is null or off > top""",
    "source_progress": RECORDS_SQL + """
select r.source_id, r.split_id, count(*) filter (where r.off <= k.off) as completed
from source_records r join checkpoints k on r.source_id = k.source_id and r.split_id = k.split_id
group by r.source_id, r.split_id""",
}
