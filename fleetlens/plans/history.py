"""History, catalogue and incident queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros, seconds_between
from fleetlens.operators import history as H
from fleetlens.operators import state as S
from fleetlens.operators.sequence import plan_slices_once
from fleetlens.plans.params import AS_OF, DAY, MONTH_START, OUTAGE_S
from fleetlens.plans.suite import Suite, Tables

SUITE = Suite()
q = SUITE.query

STATE_FIELDS = ["battery", "state", "v", "w", "temp", "wifi", "odom", "errors"]

#: Archived state rows: every field carried forward along the robot's messages.
TELEMETRY_SQL = """telemetry as (
  select event_id, robot_id, ts, ts_us,
    last_value(case when battery is not null then least(greatest(battery, 0.0e0), 100.0e0) end ignore nulls) over w as battery,
    last_value(state ignore nulls) over w as state,
    coalesce(last_value(v ignore nulls) over w, 0.0e0) as v,
    coalesce(last_value(w ignore nulls) over w, 0.0e0) as w,
    last_value(temp ignore nulls) over w as temp,
    last_value(wifi ignore nulls) over w as wifi,
    last_value(odom ignore nulls) over w as odom,
    last_value(errors ignore nulls) over w as errors
  from fx_status window w as (partition by robot_id order by ts, event_id
                              rows between unbounded preceding and current row))"""


def robot_slices(t: Tables):
    """Cut plan for ordered scans per robot; None while every robot fits in one task."""
    return plan_slices_once(t.path + "|robot", t.view("fx_events"), "robot_id", micros("ts"))


def topic_slices(t: Tables):
    return plan_slices_once(t.path + "|topic", t.view("fx_samples"), ["robot_id", "topic"], micros("ts"))


def telemetry(t: Tables):
    return S.locf_state(t.view("fx_status"), STATE_FIELDS, slices=robot_slices(t))


@q("history_bucketed", f"""with {TELEMETRY_SQL}
   select robot_id, make_timestamp(cast(floor(ts_us / 86400000000.0e0) * 86400000000 as bigint)) as ts,
          round(avg(battery), 6) as battery, round(avg(v), 6) as v, round(max(abs(w)), 6) as w_peak,
          round(avg(temp), 6) as temp, count(*) as samples
   from telemetry group by 1, 2""")
def history_bucketed(t: Tables):
    return H.history_bucketed(telemetry(t), DAY)


@q("locf_state", f"with {TELEMETRY_SQL} select * exclude (ts_us) from telemetry")
def locf_state(t: Tables):
    return telemetry(t).drop("ts_us")


@q("scan_archive", """select robot_id, ts, battery, state from fx_status
   where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-25 12:00:00'""")
def scan_archive(t: Tables):
    return H.scan_archive(t.view("fx_status"), "2024-01-05 00:00:00", "2024-01-25 12:00:00").select(
        "robot_id", "ts", "battery", "state")


@q("history_raw", """select robot_id, ts, battery, state, v, w, temp, wifi, odom from fx_status
   where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00'
   order by ts, event_id limit 5000""")
def history_raw(t: Tables):
    rows = H.scan_archive(t.view("fx_status"), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return H.oldest(rows, "ts", "event_id", limit=5000).select(
        "robot_id", "ts", "battery", "state", "v", "w", "temp", "wifi", "odom")


@q("history_default_window", """select robot_id, ts, battery, state from fx_status
   where ts >= timestamp '2024-01-20 11:00:00' and ts < timestamp '2024-01-20 12:00:00'""")
def history_default_window(t: Tables):
    return H.history_raw(t.view("fx_status"), "2024-01-20 12:00:00").select("robot_id", "ts", "battery", "state")


@q("topic_history_raw", """select robot_id, ts, num, payload from fx_samples
   where topic = 'chassis/bat_pct' and ts >= timestamp '2024-01-10 00:00:00'
     and ts < timestamp '2024-01-20 00:00:00' order by ts, event_id limit 5000""")
def topic_history_raw(t: Tables):
    rows = H.scan_archive(t.view("fx_samples"), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return H.oldest(rows.filter("topic = 'chassis/bat_pct'"), "ts", "event_id", limit=5000).select(
        "robot_id", "ts", "num", "payload")


@q("topic_bucketed", """select robot_id, topic, make_timestamp(cast(floor(ts_us / 7200000000.0e0) * 7200000000 as bigint)) as ts,
   round(avg(num), 6) as num, min(num) as lo, max(num) as hi, count(*) as samples
   from fx_samples group by 1, 2, 3""")
def topic_bucketed(t: Tables):
    return H.topic_bucketed(t.view("fx_samples"), 7200)


@q("auto_bucket", """select robot_id, make_timestamp(cast(floor(ts_us / 518400000.0e0) * 518400000 as bigint)) as ts,
   round(avg(battery), 6) as battery, round(avg(v), 6) as v, round(max(abs(w)), 6) as w_peak,
   round(avg(temp), 6) as temp, count(*) as samples from fx_status
   where ts >= timestamp '2024-01-01 00:00:00' and ts < timestamp '2024-01-31 00:00:00'
   group by 1, 2""")
def auto_bucket(t: Tables):
    width = H.auto_bucket(0, 30 * DAY, 5000)
    return H.history_bucketed(H.scan_archive(t.view("fx_status"), MONTH_START, AS_OF), width)


@q("events_filter", """select id, robot_id, ts, kind, severity, detail from fx_audit
   where kind = 'error' and severity = 'critical' and ts >= timestamp '2024-01-03 00:00:00'
     and ts < timestamp '2024-01-29 00:00:00' order by ts desc, id desc limit 500""")
def events_filter(t: Tables):
    return H.events_filter(t.view("fx_audit"), kind="error", severity="critical",
                           start="2024-01-03 00:00:00", end="2024-01-29 00:00:00").select(
        "id", "robot_id", "ts", "kind", "severity", "detail")


@q("alert_history", """select id, rule_name, robot_id, severity, message, value, started_at, resolved_at
   from fx_alerts order by started_at desc, id desc limit 100""")
def alert_history(t: Tables):
    return H.alert_log_window(t.view("fx_alerts")).drop("rule_id")


@q("alerts_recent_duration", """select started_at, resolved_at,
   (epoch_us(resolved_at) - epoch_us(started_at)) / 1e6 as duration_s, robot_id, severity, message
   from fx_alerts order by started_at desc, id desc limit 100""")
def alerts_recent_duration(t: Tables):
    return H.with_duration(H.newest(t.view("fx_alerts"), "started_at", "id", limit=100)).select(
        "started_at", "resolved_at", "duration_s", "robot_id", "severity", "message")


@q("alerts_open", "select * from fx_alerts where resolved_at is null order by started_at, id")
def alerts_open(t: Tables):
    return t.view("fx_alerts").filter("resolved_at is null").orderBy("started_at", "id")


@q("alerts_by_rule", """select rule_name, severity, count(*) as fired,
   round(avg((epoch_us(resolved_at) - epoch_us(started_at)) / 1e6), 1) as avg_duration_s
   from fx_alerts group by 1, 2""")
def alerts_by_rule(t: Tables):
    return H.alerts_by_rule(t.view("fx_alerts"))


@q("latest_samples", """select ts, robot_id, topic, num, payload from fx_samples
   order by ts desc, event_id desc limit 200""")
def latest_samples(t: Tables):
    return H.newest(t.view("fx_samples"), "ts", "event_id", limit=200).select("ts", "robot_id", "topic", "num", "payload")


@q("topic_trend", """select robot_id, ts, num from fx_samples where topic = 'chassis/motor/1/temp_c'
   and ts > timestamp '2024-01-21 00:00:00' order by robot_id, ts""")
def topic_trend(t: Tables):
    return (t.view("fx_samples").filter("topic = 'chassis/motor/1/temp_c'")
            .filter(F.col("ts") > H.time_literal("2024-01-21 00:00:00"))
            .select("robot_id", "ts", "num").orderBy("robot_id", "ts"))


CATALOG_SQL = """catalog as (select robot_id, topic, count(*) as samples,
   arg_max(substring(payload, 1, 200), event_id) as last_value, min(ts) as first_seen, max(ts) as last_seen,
   max(case when flag = 0 then ts end) as last_changed from fx_samples group by 1, 2)"""


@q("catalog", f"with {CATALOG_SQL} select * from catalog")
def catalog(t: Tables):
    return H.catalog(t.view("fx_samples"))


@q("catalog_browse", f"""with {CATALOG_SQL} select robot_id, topic, samples, last_value, first_seen, last_seen,
   (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last_seen)) / 1e6 as age_s,
   (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last_seen)) / 1e6 < 6 as fresh
   from catalog where contains(lower(topic), 'chassis')""")
def catalog_browse(t: Tables):
    return H.catalog_browse(H.catalog(t.view("fx_samples")), AS_OF, " Chassis ").drop("last_changed")


@q("silent_vs_steady", f"""with {CATALOG_SQL}, aged as (select robot_id, topic,
   (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last_seen)) / 1e6 as seen,
   (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last_changed)) / 1e6 as changed from catalog)
   select robot_id, topic, case when seen > 259200 then 'silent'
     when coalesce(changed > 259200, true) then 'steady' else 'active' end as liveness from aged""")
def silent_vs_steady(t: Tables):
    return H.liveness(H.catalog(t.view("fx_samples")), AS_OF, 3 * DAY).select("robot_id", "topic", "liveness")


@q("stale_topics", """select robot_id, topic, max(ts) as last_seen from fx_samples group by 1, 2
   having (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 > greatest(3 * 86400, 30)""")
def stale_topics(t: Tables):
    limit_s = max(3 * DAY, 30)
    last = t.view("fx_samples").groupBy("robot_id", "topic").agg(F.max("ts").alias("last_seen"))
    return last.filter(seconds_between(H.time_literal(AS_OF), "last_seen") > limit_s)


@q("incident_window", """with win as (select id as incident_id, robot_id, started_at + interval 24 year as t0,
     started_at + interval 24 year + interval 6 hour as t1 from fx_alerts where severity = 'critical')
   select incident_id, s.robot_id, ts, topic, coalesce(cast(num as varchar), payload) as shown
   from fx_samples s join win on s.robot_id = win.robot_id and ts between t0 and t1""")
def incident_window(t: Tables):
    wins = t.view("fx_alerts").filter("severity = 'critical'").select(
        F.col("id").alias("incident_id"), "robot_id",
        F.expr("started_at + interval 24 year").alias("t0"),
        F.expr("started_at + interval 24 year + interval 6 hour").alias("t1"))
    return H.incident_window(t.view("fx_samples"), wins).select("incident_id", "robot_id", "ts", "topic", "shown")


@q("incident_timeline", """select robot_id, ts, kind, severity, detail as content from fx_audit
   where ts > timestamp '2024-01-20 00:00:00'
   union all select robot_id, started_at, 'alert', severity, message from fx_alerts
   where started_at > timestamp '1999-01-01 00:00:00'""")
def incident_timeline(t: Tables):
    return H.incident_timeline(
        t.view("fx_audit").filter(F.col("ts") > H.time_literal("2024-01-20 00:00:00")),
        t.view("fx_alerts").filter(F.col("started_at") > H.time_literal("1999-01-01 00:00:00")),
    ).orderBy("robot_id", "ts")


@q("enroll_audit", """select ts, robot_id, kind, detail from fx_audit where kind in ('enroll', 'revoke')
   order by ts desc""")
def enroll_audit(t: Tables):
    return t.view("fx_audit").filter(F.col("kind").isin("enroll", "revoke")).select(
        "ts", "robot_id", "kind", "detail").orderBy(F.col("ts").desc())


@q("sample_gaps", """select event_id, robot_id, topic, ts,
   (ts_us - lag(ts_us) over (partition by robot_id, topic order by ts, event_id)) / 1e6 as gap_s from fx_samples""")
def sample_gaps(t: Tables):
    return H.sample_gaps(t.view("fx_samples"), ["robot_id", "topic"], slices=topic_slices(t)).select(
        "event_id", "robot_id", "topic", "ts", "gap_s")


@q("gap_stats", """with g as (select robot_id, topic,
   (ts_us - lag(ts_us) over (partition by robot_id, topic order by ts, event_id)) / 1e6 as gap_s from fx_samples)
   select robot_id, topic, count(*) as samples, round(avg(gap_s), 2) as avg_gap_s, round(max(gap_s), 2) as max_gap_s
   from g where gap_s is not null group by 1, 2""")
def gap_stats(t: Tables):
    keys = ["robot_id", "topic"]
    return H.gap_stats(H.sample_gaps(t.view("fx_samples"), keys, slices=topic_slices(t)), keys)


@q("outage_sessions", f"""with g as (select robot_id, ts, lag(ts) over w as prev,
     (ts_us - lag(ts_us) over w) / 1e6 as gap_s from fx_samples
   window w as (partition by robot_id order by ts, event_id))
   select robot_id, prev as outage_start, ts as outage_end, gap_s from g where gap_s > {OUTAGE_S}""")
def outage_sessions(t: Tables):
    gaps = H.sample_gaps(t.view("fx_samples"), ["robot_id"], slices=robot_slices(t))
    return H.outages(gaps, OUTAGE_S).select("robot_id", "outage_start", "outage_end", "gap_s")


@q("robot_volume", """select robot_id, count(*) as samples, count(distinct topic) as topics, min(ts) as first_ts,
   max(ts) as last_ts from fx_samples group by 1""")
def robot_volume(t: Tables):
    return H.robot_volume(t.view("fx_samples"))


@q("loudest_topics", f"""with {CATALOG_SQL} select topic, cast(sum(samples) as bigint) as samples,
   max(last_seen) as last_seen from catalog group by 1 order by 2 desc, 1 limit 15""")
def loudest_topics(t: Tables):
    return H.loudest_topics(H.catalog(t.view("fx_samples")))


@q("chart_summary", """select robot_id, topic, cast(hours as int) as hours, count(*) as samples, count(num) as points,
   min(num) as lo, max(num) as hi, round(avg(num), 6) as mean
   from fx_samples, (select unnest([1, 6, 24, 168]) as hours) h
   where (epoch_us(timestamp '2024-01-31 00:00:00') - ts_us) / 1e6 / 3600 <= hours group by 1, 2, 3""")
def chart_summary(t: Tables):
    return H.chart_summary(t.view("fx_samples"), AS_OF, [1, 6, 24, 168])


@q("table_counts", """select 'robots' as table_name, count(*) as rows from fx_robots
   union all select 'telemetry', count(*) from fx_status union all select 'topic_samples', count(*) from fx_samples
   union all select 'topic_catalog', count(*) from (select distinct robot_id, topic from fx_samples)
   union all select 'events', count(*) from fx_audit union all select 'alerts', count(*) from fx_alerts
   union all select 'push_subscriptions', count(*) from fx_push""")
def table_counts(t: Tables):
    return H.table_counts({
        "robots": t.view("fx_robots"), "telemetry": t.view("fx_status"), "topic_samples": t.view("fx_samples"),
        "topic_catalog": t.view("fx_samples").select("robot_id", "topic").distinct(),
        "events": t.view("fx_audit"), "alerts": t.view("fx_alerts"), "push_subscriptions": t.view("fx_push")})


@q("state_transitions", """with s as (select robot_id, ts, state, lag(state) over (partition by robot_id order by ts, event_id)
     as from_state from fx_status)
   select robot_id, ts, from_state, state as to_state,
     case when state in ('error', 'estop') then 'warn' else 'info' end as severity
   from s where from_state is not null and from_state <> state""")
def state_transitions(t: Tables):
    return S.state_transitions(t.view("fx_status"), slices=robot_slices(t)).select(
        "robot_id", "ts", "from_state", "to_state", "severity")


@q("error_transitions", """with s as (select robot_id, ts, errors, lag(errors) over w as before, row_number() over w as n
     from fx_status window w as (partition by robot_id order by ts, event_id))
   select robot_id, ts, errors, errors = '' as cleared, case when errors = '' then 'info' else 'critical' end as severity
   from s where errors <> coalesce(before, '') and (errors <> '' or n > 1)""")
def error_transitions(t: Tables):
    return S.error_transitions(t.view("fx_status"), slices=robot_slices(t)).select(
        "robot_id", "ts", "errors", "cleared", "severity")


@q("change_only", """with s as (select event_id, robot_id, topic, payload, lag(payload) over w as before, row_number() over w as n
     from fx_samples window w as (partition by robot_id, topic order by ts, event_id))
   select event_id, robot_id, topic, payload from s where n = 1 or payload <> before""")
def change_only(t: Tables):
    return S.change_only(t.view("fx_samples"), ["robot_id", "topic"], "payload", slices=topic_slices(t)).select(
        "event_id", "robot_id", "topic", "payload")
