"""Presence, sampling and fleet-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros
from fleetlens.operators import presence as P
from fleetlens.operators import relay as R
from fleetlens.operators.sequence import plan_slices_once
from fleetlens.plans.history import robot_slices, topic_slices
from fleetlens.plans.params import AS_OF, DEADBAND, HEARTBEAT_S, MIN_GAP_S, OFFLINE_AFTER_S, STALE_AFTER_S
from fleetlens.plans.suite import Suite, Tables

SUITE = Suite()
q = SUITE.query

LIMITS = {"offline_after_s": OFFLINE_AFTER_S, "stale_after_s": STALE_AFTER_S}
AS_OF_US = "epoch_us(timestamp '2024-01-31 00:00:00')"
OFF_US, STALE_US = OFFLINE_AFTER_S * 1_000_000, STALE_AFTER_S * 1_000_000


def decide_sql(at: str) -> str:
    return f"""case when not coalesce(link_up, true) and link_us >= coalesce(seen_us, 0) then 'offline'
      when seen_us is null then 'unknown' when {at} - seen_us <= {OFF_US} then 'ok'
      when {at} - seen_us <= {STALE_US} then 'stale' else 'offline' end"""


PRESENCE_SQL = f"""seen as (select robot_id, max(ts_us) as seen_us from fx_status group by 1),
   link as (select robot_id, arg_max(payload = 'online', (ts_us, event_id)) as link_up, max(ts_us) as link_us from fx_lwt
     where ts_us <= {AS_OF_US} group by 1),
   ids as (select id as robot_id from fx_robots),
   presence as (select robot_id, {decide_sql(AS_OF_US)} as presence, make_timestamp(seen_us) as last_seen, link_up as link
     from ids left join seen using (robot_id) left join link using (robot_id))"""


def presence_now(t: Tables):
    robots = t.view("fx_robots").select(F.col("id").alias("robot_id"))
    return P.presence(t.view("fx_status"), t.view("fx_lwt"), AS_OF, robots, **LIMITS)


@q("presence", f"with {PRESENCE_SQL} select * from presence")
def presence(t: Tables):
    return presence_now(t)


TIMELINE_SQL = f"""sig as (select robot_id, ts_us as at_us, 0 as rk, event_id, ts_us as s, cast(null as boolean) as up from fx_status
     union all select robot_id, ts_us, 1, event_id, null, payload = 'online' from fx_lwt where ts_us <= {AS_OF_US}),
   run as (select robot_id, at_us, rk, event_id, last_value(s ignore nulls) over w as seen_us,
      last_value(up ignore nulls) over w as link_up,
      last_value(case when up is not null then at_us end ignore nulls) over w as link_us,
      coalesce(lead(at_us) over (partition by robot_id order by at_us, rk, event_id), {AS_OF_US}) as end_us
     from sig window w as (partition by robot_id order by at_us, rk, event_id rows between unbounded preceding and current row)),
   cut as (select *, unnest(list_distinct([at_us, seen_us + {OFF_US} + 1, seen_us + {STALE_US} + 1])) as p from run),
   piece as (select *, {decide_sql('p')} as presence from cut where p >= at_us and p < end_us),
   marked as (select *, lag(presence) over (partition by robot_id order by p, at_us, rk, event_id) as before from piece),
   timeline as (select robot_id, presence, before, make_timestamp(p) as start_ts,
     make_timestamp(coalesce(lead(p) over w, {AS_OF_US})) as end_ts, lead(p) over w is null as current
     from marked where before is null or before <> presence window w as (partition by robot_id order by p, at_us, rk, event_id))"""


def timeline(t: Tables):
    return P.presence_timeline(t.view("fx_status"), t.view("fx_lwt"), AS_OF, slices=robot_slices(t), **LIMITS)


@q("presence_timeline", f"with {TIMELINE_SQL} select * from timeline")
def presence_timeline(t: Tables):
    return timeline(t)


@q("presence_events", f"""with {TIMELINE_SQL} select robot_id, start_ts as ts, case when presence = 'ok' then 'online' else 'offline' end as kind,
   case when presence = 'ok' then 'info' else 'warn' end as severity,
   presence <> 'ok' and coalesce(before in ('stale', 'offline', 'unknown'), false) as repeat from timeline""")
def presence_events(t: Tables):
    return P.presence_events(timeline(t))


# ------------------------------------------------------------------ sampling

RELAY_SQL = f"""recursive rows as (select event_id, robot_id, topic, ts_us, num, payload,
     row_number() over (partition by robot_id, topic order by ts, event_id) as n from fx_samples),
   walk as (select event_id, robot_id, topic, n, 'change' as decision, ts_us as s_us, num as s_num, payload as s_text from rows where n = 1
     union all select event_id, robot_id, topic, n, d, case when d in ('rate', 'same') then s_us else ts_us end,
        case when d in ('rate', 'same') then s_num else num end, case when d in ('rate', 'same') then s_text else payload end
     from (select r.event_id, r.robot_id, r.topic, r.n, r.ts_us, r.num, r.payload, s_us, s_num, s_text,
        case when r.ts_us - s_us < {MIN_GAP_S * 1_000_000} then 'rate'
             when not case when r.num is not null and s_num is not null then abs(r.num - s_num) <= {DEADBAND}
                           else r.payload = s_text end then 'change'
             when r.ts_us - s_us >= {HEARTBEAT_S * 1_000_000} then 'heartbeat' else 'same' end as d
        from walk w join rows r on r.robot_id = w.robot_id and r.topic = w.topic and r.n = w.n + 1) x)"""

TOPIC = ["robot_id", "topic"]


def relayed(t: Tables):
    rows = t.view("fx_samples").select("event_id", *TOPIC, "ts", "num", "payload")
    return R.relay_decisions(rows, TOPIC, "num", "payload", min_gap_s=MIN_GAP_S,
                             heartbeat_s=HEARTBEAT_S, deadband=DEADBAND, slices=topic_slices(t), unused=("num", "payload"))


@q("relay_sample", f"with {RELAY_SQL} select event_id, robot_id, topic, decision from walk")
def relay_sample(t: Tables):
    return relayed(t).select("event_id", "robot_id", "topic", "decision")


@q("relay_counters", f"""with {RELAY_SQL} select robot_id, count(*) as seen, count(*) filter (decision in ('change', 'heartbeat')) as relayed,
   count(*) filter (decision = 'heartbeat') as heartbeats, count(*) filter (decision = 'rate') as skipped_rate,
   count(*) filter (decision = 'same') as skipped_same from walk group by 1""")
def relay_counters(t: Tables):
    return R.relay_counters(relayed(t), ["robot_id"])


@q("throttle", f"""with recursive rows as (select event_id, robot_id, topic, ts_us,
     row_number() over (partition by robot_id, topic order by ts, event_id) as n from fx_samples),
   walk as (select event_id, robot_id, topic, n, ts_us as s_us, true as kept from rows where n = 1
     union all select r.event_id, r.robot_id, r.topic, r.n,
        case when r.ts_us - s_us >= {MIN_GAP_S * 1_000_000} then r.ts_us else s_us end, r.ts_us - s_us >= {MIN_GAP_S * 1_000_000}
     from walk w join rows r on r.robot_id = w.robot_id and r.topic = w.topic and r.n = w.n + 1)
   select event_id, robot_id, topic from walk where kept""")
def throttle(t: Tables):
    return R.throttle(t.view("fx_samples"), TOPIC, MIN_GAP_S, slices=topic_slices(t)).select("event_id", "robot_id", "topic")


PROFILE_SQL = """c as (select *, lag(payload) over w as before, row_number() over w as n from fx_samples
     window w as (partition by robot_id, topic order by ts, event_id)),
   profile as (select robot_id, topic, count(*) as samples, round(avg(strlen(payload)), 6) as avg_bytes,
     count(*) filter (n > 1 and payload <> before) as changes, false as is_binary, arg_max(payload, event_id) as last_value,
     case when count(*) > 1 then (count(*) - 1) / greatest((max(ts_us) - min(ts_us)) / 1e6, 1e-6) else 0.0 end as hz
     from c group by 1, 2)"""


def profile(t: Tables):
    return R.topic_profile(t.view("fx_samples"), TOPIC, slices=topic_slices(t))


@q("topic_profile", f"with {PROFILE_SQL} select * replace (round(hz, 9) as hz) from profile")
def topic_profile(t: Tables):
    return profile(t).withColumn("hz", F.round("hz", 9))


@q("topic_profile_binary", """with c as (select topic, ts, event_id, octet_length(payload) as n, try(decode(payload)) is null as bad from fx_payloads)
   select topic, count(*) as samples, round(avg(n), 6) as avg_bytes, bool_or(bad) as is_binary from c group by 1""")
def topic_profile_binary(t: Tables):
    slices = plan_slices_once(t.path + "|payload", t.view("fx_payloads"), ["topic"], micros("ts"))
    return R.topic_profile(t.view("fx_payloads"), ["topic"], binary=~F.is_valid_utf8("payload"), slices=slices).select(
        "topic", "samples", "avg_bytes", "is_binary")


@q("relay_cost", f"""with {PROFILE_SQL}, r as (select robot_id, sum(case when samples > 1 then least(hz, 5.0) * changes / (samples - 1)
     else least(hz, 5.0) end) as x from profile group by 1)
   select robot_id, round(x, 9) as rows_per_s, round(x * 170 * 86400 / 1e9, 9) as gb_per_day,
     round(x * 170 * 86400 / 1e9 * 30, 9) as gb_per_month from r""")
def relay_cost(t: Tables):
    cost = R.relay_cost(profile(t), keys=["robot_id"])
    return cost.select("robot_id", *[F.round(c, 9).alias(c) for c in ("rows_per_s", "gb_per_day", "gb_per_month")])


FIELD_OF = {"chassis/bat_pct": "battery", "chassis/vel/linear": "v", "chassis/motor/1/temp_c": "temp"}


@q("map_fields", """select robot_id, arg_max(num, event_id) filter (topic = 'chassis/bat_pct') as battery,
   arg_max(num, event_id) filter (topic = 'chassis/motor/1/temp_c') as temp,
   arg_max(num, event_id) filter (topic = 'chassis/vel/linear') as v
   from fx_samples where topic in ('chassis/bat_pct', 'chassis/vel/linear', 'chassis/motor/1/temp_c') group by 1""")
def map_fields(t: Tables):
    return R.map_fields(t.view("fx_samples"), FIELD_OF)
