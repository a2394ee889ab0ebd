"""Registered watch queries over the poll log derived from ``events``, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import termination as term
from tidewatch.functions.keys import key_digest
from tidewatch.operators.bounded import bounded_first_seen
from tidewatch.operators.first_seen import first_in_poll, first_seen
from tidewatch.operators.polls import (
    initial_watermark,
    normalize,
    poll_summary,
    reported_watermarks,
    stops,
    until_stop,
    with_discovery_time,
    with_emit_order,
    with_running_state,
)
from tidewatch.plans import tables
from tidewatch.plans.tables import PollLog
from tidewatch.plans.spec import Watch

TOTAL = term.after_total_of(timedelta(days=10))
IDLE = term.after_time_since_new_output(timedelta(days=3))
ITERATIONS = term.after_iterations(20)
MIXED = term.either_of(term.all_of(TOTAL, IDLE), ITERATIONS)
QUIET_POLL = term.custom(lambda: (F.col("n_new") == 0) & (F.col("poll_no") % 4 == 0))
CAP = 50


def _fresh(log: PollLog) -> DataFrame:
    return first_seen(log.outputs())


def _new_outputs(log: PollLog) -> DataFrame:
    found = with_discovery_time(_fresh(log), log.polls())
    return found.withColumn("key_hash", key_digest("value"))


def _summary(log: PollLog) -> DataFrame:
    return poll_summary(log.seeds(), log.polls(), _fresh(log))


def _state(log: PollLog) -> DataFrame:
    return with_running_state(_summary(log))


def watch_normalize(log: PollLog) -> DataFrame:
    return normalize(log.polls(), log.outputs())


def watch_discovery_time(log: PollLog) -> DataFrame:
    return with_discovery_time(log.outputs(), log.polls())


def watch_key_digest(log: PollLog) -> DataFrame:
    return log.outputs().select(
        "seed", "poll_no", "pos",
        key_digest("value").alias("key_hash"),
        key_digest("seed", "value").alias("pair_hash"),
    )


def watch_poll_dedup(log: PollLog) -> DataFrame:
    return first_in_poll(log.outputs())


def watch_new_by_key(log: PollLog) -> DataFrame:
    by_field = Watch.growth_of().with_output_key(lambda v: F.get_json_object(v, "$.k")).with_key_type("int")
    outputs, key = by_field.keyed(log.outputs_with_props())
    return first_seen(outputs, key).select("seed", "key", "poll_no", "pos", "value")


def watch_emit_order(log: PollLog) -> DataFrame:
    found = with_discovery_time(_fresh(log), log.polls())
    return with_emit_order(found)


def watch_poll_watermark(log: PollLog) -> DataFrame:
    return _summary(log).select("seed", "poll_no", "n_new", "candidate", "done")


def watch_watermark(log: PollLog) -> DataFrame:
    return _state(log).select("seed", "poll_no", F.col("wm").alias("watermark"))


def watch_watermark_initial(log: PollLog) -> DataFrame:
    return _state(log).select("seed", "poll_no", initial_watermark("wm").alias("watermark"))


def watch_reported_watermark(log: PollLog) -> DataFrame:
    state = _state(log)
    return reported_watermarks(state, stops(state, MIXED))


def watch_complete_stop(log: PollLog) -> DataFrame:
    stop_at = stops(_state(log), term.never())
    return until_stop(_fresh(log), stop_at).select("seed", "poll_no", "pos", "value", "stop_at")


def watch_stop_at(log: PollLog) -> DataFrame:
    return stops(_state(log), MIXED)


def watch_growth(log: PollLog) -> DataFrame:
    spec = Watch.growth_of().with_termination_per_input(MIXED).with_max_completed_size(None)
    return spec.over_log(
        log.seeds(), log.polls(), log.outputs()
    ).outputs


def watch_bounded_seen(log: PollLog) -> DataFrame:
    return bounded_first_seen(log.outputs(), log.polls(), CAP)


def watch_bounded_growth(log: PollLog) -> DataFrame:
    spec = Watch.growth_of().with_termination_per_input(MIXED).with_max_completed_size(CAP)
    return spec.over_log(
        log.seeds(), log.polls(), log.outputs()
    ).outputs


def _stop_query(condition: term.Termination):
    def run(log: PollLog) -> DataFrame:
        return _state(log).select("seed", "poll_no", condition.stop().alias("stop"))

    return run


QUERIES = {
    "watch_normalize": watch_normalize,
    "watch_discovery_time": watch_discovery_time,
    "watch_key_digest": watch_key_digest,
    "watch_poll_dedup": watch_poll_dedup,
    "watch_new_outputs": _new_outputs,
    "watch_new_by_key": watch_new_by_key,
    "watch_emit_order": watch_emit_order,
    "watch_poll_watermark": watch_poll_watermark,
    "watch_watermark": watch_watermark,
    "watch_watermark_initial": watch_watermark_initial,
    "watch_reported_watermark": watch_reported_watermark,
    "watch_complete_stop": watch_complete_stop,
    "term_never": _stop_query(term.never()),
    "term_after_total": _stop_query(TOTAL),
    "term_idle": _stop_query(IDLE),
    "term_iterations": _stop_query(ITERATIONS),
    "term_either": _stop_query(term.either_of(ITERATIONS, TOTAL)),
    "term_all": _stop_query(term.all_of(TOTAL, IDLE)),
    "term_custom": _stop_query(QUIET_POLL),
    "watch_stop_at": watch_stop_at,
    "watch_growth": watch_growth,
    "watch_bounded_seen": watch_bounded_seen,
    "watch_bounded_growth": watch_bounded_growth,
}
QUERIES = {name: tables.over_log(query) for name, query in QUERIES.items()}

# ---------------------------------------------------------------------------
# SQL
# ---------------------------------------------------------------------------

# The first day is that of the earliest event; an event without a time falls on it.
FIRST_DAY_SQL = "(select coalesce(min(cast(ts as date)), date '2024-01-01') from events)"
DAY_SQL = f"coalesce(date_diff('day', {FIRST_DAY_SQL}, cast(ts as date)) + 1, 1)"
START_SQL = f"cast({FIRST_DAY_SQL} as timestamp)"

LOG_SQL = f"""
with recursive seeds as (
  select distinct event_type as seed, {START_SQL} as added_at,
         case when event_type = 'click' then {START_SQL} + to_days(2) end as event_ts
  from events),
polls as (
  select s.seed, n.poll_no, s.added_at + to_days(n.poll_no) as poll_ts,
         case when n.poll_no % 7 = 0 then s.added_at + to_days(n.poll_no - 5)
              when n.poll_no % 5 = 0 then s.added_at + to_days(n.poll_no - 1)
         end as watermark,
         (s.seed = 'error' and n.poll_no = 25) as complete
  from seeds s cross join (
    select cast(unnest(range(1, (select max({DAY_SQL}) + 3 from events))) as int) as poll_no) n),
listed as (
  select event_type as seed,
         cast({DAY_SQL} + lag as int) as poll_no,
         event_id as pos, user_id as value,
         case when event_id % 3 = 0 then null else ts end as event_ts, props
  from events cross join (select unnest([0, 1, 2]) as lag)),
poll_outputs as (
  select * from listed where not (seed = 'signup' and poll_no % 6 = 0)),
d as (
  select o.seed, o.poll_no, o.pos, o.value, md5(cast(to_json({{'k0': o.value}}) as varchar)) as key_hash,
         coalesce(o.event_ts, p.poll_ts) as discovered_ts
  from poll_outputs o join polls p on o.seed = p.seed and o.poll_no = p.poll_no),
n as (
  select seed, poll_no, pos, value, key_hash, discovered_ts,
         row_number() over (partition by seed, poll_no order by discovered_ts, pos) as emit_no
  from (select *, row_number() over (partition by seed, key_hash order by poll_no, pos) as rn from d)
  where rn = 1),
c as (
  select p.seed, p.poll_no, p.poll_ts, p.complete as done, s.added_at as start_ts, s.event_ts as seed_ts,
         count(n.value) as n_new,
         case when not p.complete then coalesce(max(p.watermark), min(n.discovered_ts)) end as candidate
  from polls p join seeds s on p.seed = s.seed
  left join n on n.seed = p.seed and n.poll_no = p.poll_no
  group by p.seed, p.poll_no, p.poll_ts, p.complete, s.added_at, s.event_ts),
w as (
  select c.*, max(candidate) over (partition by seed order by poll_no rows unbounded preceding) as wm,
         max(candidate) over (partition by seed order by poll_no
                              rows between unbounded preceding and 1 preceding) as wm_before,
         max(case when n_new > 0 then poll_ts end)
           over (partition by seed order by poll_no rows unbounded preceding) as last_new_ts
  from c),
f as (
  select w.*, greatest(wm, seed_ts) as wm_initial,
         poll_ts - start_ts > to_days(10) as t_total,
         coalesce(poll_ts - last_new_ts > to_days(3), false) as t_idle,
         poll_no >= 20 as t_iter
  from w),
st as (
  select seed, min(case when done or (t_total and t_idle) or t_iter then poll_no end) as stop_at
  from f group by seed)
"""

# The bounded memory in SQL: per seed one list of remembered keys, carried from poll to poll.
BOUNDED_SQL = LOG_SQL + f""",
in_poll as (
  select seed, poll_no, list(key_hash order by discovered_ts, pos) as keys
  from (select *, row_number() over (partition by seed, poll_no, key_hash order by pos) as rn from d)
  where rn = 1 group by seed, poll_no),
memory as (
  select seed, 0 as poll_no, cast([] as varchar[]) as kept, cast([] as varchar[]) as new_keys from seeds
  union all
  select m.seed, m.poll_no + 1,
         list_slice(list_concat(m.kept, x.new_keys),
                    greatest(len(m.kept) + len(x.new_keys) - {CAP}, 0) + 1,
                    len(m.kept) + len(x.new_keys)),
         x.new_keys
  from memory m
  left join in_poll i on i.seed = m.seed and i.poll_no = m.poll_no + 1,
  lateral (select list_filter(coalesce(i.keys, cast([] as varchar[])),
                              lambda k: not list_contains(m.kept, k)) as new_keys) x
  where m.poll_no < (select max(poll_no) from polls)),
b as (
  select o.seed, o.poll_no, o.pos, o.value, o.key_hash, o.discovered_ts
  from (select *, row_number() over (partition by seed, poll_no, key_hash order by pos) as rn from d) o
  join (select seed, poll_no, unnest(new_keys) as key_hash from memory) k
    on o.seed = k.seed and o.poll_no = k.poll_no and o.key_hash = k.key_hash
  where o.rn = 1)
"""


def _stop_sql(stop: str) -> str:
    return LOG_SQL + f"select seed, poll_no, {stop} as stop from f"


ORACLES = {
    "watch_normalize": LOG_SQL + """
select p.seed, p.poll_no, o.pos, o.value, o.event_ts,
       case when not p.complete then p.watermark end as watermark, p.complete as done
from polls p left join poll_outputs o on o.seed = p.seed and o.poll_no = p.poll_no""",
    "watch_discovery_time": LOG_SQL + "select seed, poll_no, pos, value, discovered_ts from d",
    "watch_key_digest": LOG_SQL + """
select seed, poll_no, pos, md5(cast(to_json({'k0': value}) as varchar)) as key_hash,
       md5(cast(to_json({'k0': seed, 'k1': value}) as varchar)) as pair_hash
from poll_outputs""",
    "watch_poll_dedup": LOG_SQL + """
select seed, poll_no, pos, value, event_ts
from (select *, row_number() over (partition by seed, poll_no, value order by pos) as rn from poll_outputs)
where rn = 1""",
    "watch_new_outputs": LOG_SQL + "select seed, poll_no, pos, value, key_hash, discovered_ts from n",
    "watch_new_by_key": LOG_SQL + """
select seed, key, poll_no, pos, value
from (select seed, cast(json_extract_string(props, '$.k') as int) as key, poll_no, pos, props as value,
             row_number() over (partition by seed, cast(json_extract_string(props, '$.k') as int)
                                order by poll_no, pos) as rn
      from poll_outputs)
where rn = 1""",
    "watch_emit_order": LOG_SQL + "select seed, poll_no, pos, value, discovered_ts, emit_no from n",
    "watch_poll_watermark": LOG_SQL + "select seed, poll_no, n_new, candidate, done from c",
    "watch_watermark": LOG_SQL + "select seed, poll_no, wm as watermark from w",
    "watch_watermark_initial": LOG_SQL + "select seed, poll_no, wm_initial as watermark from f",
    "watch_reported_watermark": LOG_SQL + """
select f.seed, f.poll_no, f.n_new,
       greatest(case when f.poll_no = st.stop_at then f.wm_before else f.wm end, f.seed_ts) as watermark,
       coalesce(f.poll_no = st.stop_at, false) as done
from f join st on f.seed = st.seed where st.stop_at is null or f.poll_no <= st.stop_at""",
    "watch_complete_stop": LOG_SQL + """
select n.seed, n.poll_no, n.pos, n.value, x.stop_at
from n join (select seed, min(case when complete then poll_no end) as stop_at from polls group by seed) x
  on n.seed = x.seed
where x.stop_at is null or n.poll_no <= x.stop_at""",
    "term_never": _stop_sql("false"),
    "term_after_total": _stop_sql("t_total"),
    "term_idle": _stop_sql("t_idle"),
    "term_iterations": _stop_sql("t_iter"),
    "term_either": _stop_sql("t_iter or t_total"),
    "term_all": _stop_sql("t_total and t_idle"),
    "term_custom": _stop_sql("n_new = 0 and poll_no % 4 = 0"),
    "watch_stop_at": LOG_SQL + "select seed, stop_at from st",
    "watch_growth": LOG_SQL + """
select n.seed, n.poll_no, n.pos, n.value, n.key_hash, n.discovered_ts
from n join st on n.seed = st.seed where st.stop_at is null or n.poll_no <= st.stop_at""",
    "watch_bounded_seen": BOUNDED_SQL + "select seed, poll_no, pos, value, discovered_ts from b",
    "watch_bounded_growth": BOUNDED_SQL + """,
bc as (
  select p.seed, p.poll_no, p.poll_ts, p.complete as done, s.added_at as start_ts, count(b.value) as n_new
  from polls p join seeds s on p.seed = s.seed
  left join b on b.seed = p.seed and b.poll_no = p.poll_no
  group by p.seed, p.poll_no, p.poll_ts, p.complete, s.added_at),
bw as (
  select bc.*, max(case when n_new > 0 then poll_ts end)
                 over (partition by seed order by poll_no rows unbounded preceding) as last_new_ts
  from bc),
bst as (
  select seed, min(case when done or poll_no >= 20
                          or (poll_ts - start_ts > to_days(10)
                              and coalesce(poll_ts - last_new_ts > to_days(3), false)) then poll_no end) as stop_at
  from bw group by seed)
select b.seed, b.poll_no, b.pos, b.value, b.key_hash, b.discovered_ts
from b join bst on b.seed = bst.seed where bst.stop_at is null or b.poll_no <= bst.stop_at""",
}
