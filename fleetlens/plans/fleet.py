"""Fleet view, registry, access, storage and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import secrets as X
from fleetlens.functions import topics as TP
from fleetlens.functions.scalars import micros
from fleetlens.operators import fleet as FL
from fleetlens.operators import history as H
from fleetlens.operators import state as S
from fleetlens.operators import storage as ST
from fleetlens.operators.sequence import plan_slices_once
from fleetlens.plans.history import CATALOG_SQL, TELEMETRY_SQL, robot_slices, telemetry
from fleetlens.plans.live import PRESENCE_SQL, presence_now
from fleetlens.plans.params import AS_OF, DAY, EGRESS_WINDOW_S, LOGIN_WINDOW_S, RETENTION_DAYS
from fleetlens.plans.suite import Suite, Tables
from fleetlens.sources import messages as M
from fleetlens.sources import recording as RC
from fleetlens.sources import sinks as K

SUITE = Suite()
q = SUITE.query

LATEST_SQL = f"""{TELEMETRY_SQL}, latest as (select t.*, rx_count from telemetry t join (select robot_id, max(event_id) as event_id,
   count(*) as rx_count from telemetry group by 1) m using (robot_id, event_id))"""
SNAPSHOT_SQL = f"""{LATEST_SQL}, {PRESENCE_SQL}, snapshot as (select p.robot_id, presence, last_seen, link, battery,
   case when presence = 'ok' then state else presence end as state, presence = 'ok' as online, round_even(v, 3) as v, round_even(w, 3) as w,
   temp, wifi, odom, errors, round((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last_seen)) / 1e6, 2) as age_s,
   coalesce(rx_count, 0) as rx_count from presence p left join latest l on p.robot_id = l.robot_id)"""


def latest(t: Tables):
    return FL.latest_state(telemetry(t))


def snapshot(t: Tables):
    return FL.fleet_snapshot(latest(t).drop("event_id", "ts_us"), presence_now(t), AS_OF)


@q("fleet_snapshot", f"with {SNAPSHOT_SQL} select * from snapshot")
def fleet_snapshot(t: Tables):
    return snapshot(t)


@q("fleet_summary", f"""with {LATEST_SQL}, {PRESENCE_SQL}, j as (select * from presence p left join latest l on p.robot_id = l.robot_id)
   select count(*) as total, count(*) filter (presence = 'ok') as online, count(*) filter (presence = 'stale') as stale,
     count(*) filter (presence = 'unknown') as unknown, count(*) filter (presence = 'offline') as offline,
     count(*) filter (presence = 'ok' and (abs(v) > 0.02 or abs(w) > 0.02)) as moving,
     count(*) filter (presence = 'ok' and state = 'charging') as charging,
     count(*) filter (presence = 'ok' and (errors <> '' or state in ('error', 'estop'))) as faulted,
     round(avg(battery) filter (presence = 'ok'), 1) as avg_battery, round(min(battery) filter (presence = 'ok'), 1) as min_battery,
     cast(coalesce(sum(rx_count), 0) as bigint) as messages from j""")
def fleet_summary(t: Tables):
    return FL.fleet_summary(latest(t), presence_now(t))


@q("fleet_board", f"""with {SNAPSHOT_SQL}, n as (select id as robot_id, name from fx_robots)
   select robot_id, name, online, state, battery, case when battery < 15 then 'crit' when battery < 30 then 'low' else '' end as band
   from snapshot join n using (robot_id) where battery < 30 and contains(lower(robot_id || ' ' || name), 'amr-')""")
def fleet_board(t: Tables):
    names = t.view("fx_robots").select(F.col("id").alias("robot_id"), "name")
    board = FL.fleet_board(snapshot(t).join(names, "robot_id"), "low", " AMR-")
    return board.select("robot_id", "name", "online", "state", "battery", "band")


TRAIL_SQL = f"""{TELEMETRY_SQL}, trail as (select robot_id, event_id, ts, round(battery, 1) as battery, round(v, 3) as v,
   row_number() over (partition by robot_id order by ts desc, event_id desc) as n from telemetry)"""


def trail(t: Tables, n: int):
    rows = telemetry(t).select("robot_id", "event_id", "ts", F.round("battery", 1).alias("battery"), F.round("v", 3).alias("v"))
    return FL.last_points(rows, n)


@q("last_n_trail", f"with {TRAIL_SQL} select * from trail where n <= 24")
def last_n_trail(t: Tables):
    return trail(t, 24)


@q("robot_detail", f"""with {TRAIL_SQL}, {SNAPSHOT_SQL.replace(TELEMETRY_SQL + ', ', '')}, a as (select robot_id, count(*) as points,
     string_agg(coalesce(cast(battery as varchar), '-') || '/' || cast(v as varchar), ' ' order by ts) as trail from trail where n <= 24 group by 1)
   select s.robot_id, presence, state, coalesce(points, 0) as points, trail from snapshot s left join a on a.robot_id = s.robot_id""")
def robot_detail(t: Tables):
    detail = FL.robot_detail(trail(t, 24), snapshot(t))
    text = F.transform("trail", lambda p: F.concat_ws("/", F.coalesce(p["battery"].cast("string"), F.lit("-")), p["v"].cast("string")))
    return detail.select("robot_id", "presence", "state", F.coalesce(F.size("trail"), F.lit(0)).cast("long").alias("points"),
                         F.array_join(text, " ").alias("trail"))


#: State with pose and mission, carried forward; a mission given as an object also sets or clears the progress.
POSE_FIELDS = ["battery", "state", "x", "y", "yaw", "v", "w", "mission", "progress"]
POSE_SQL = """msg as (select event_id, split_part(topic, '/', 2) as robot_id, recv_ts as ts, cast(payload as json) as j from fx_poses),
   said as (select event_id, robot_id, ts, cast(j->>'$.battery' as double) as battery, j->>'$.state' as state,
     cast(coalesce(j->>'$.pose.x', j->>'$.x') as double) as x, cast(coalesce(j->>'$.pose.y', j->>'$.y') as double) as y,
     cast(coalesce(j->>'$.pose.yaw', j->>'$.yaw') as double) as yaw, cast(j->>'$.v' as double) as v, cast(null as double) as w,
     coalesce(json_type(j->'$.mission') = 'OBJECT', false) as reset,
     case when json_type(j->'$.mission') = 'OBJECT' then coalesce(j->>'$.mission.id', j->>'$.mission.name') else j->>'$.mission' end as mission,
     cast(j->>'$.mission.progress' as double) as progress from msg),
   pose as (select event_id, robot_id, ts, last_value(case when battery is not null then least(greatest(battery, 0.0e0), 100.0e0) end ignore nulls) over w as battery,
     last_value(state ignore nulls) over w as state, coalesce(last_value(x ignore nulls) over w, 0.0e0) as x,
     coalesce(last_value(y ignore nulls) over w, 0.0e0) as y, coalesce(last_value(yaw ignore nulls) over w, 0.0e0) as yaw,
     coalesce(last_value(v ignore nulls) over w, 0.0e0) as v, coalesce(last_value(said.w ignore nulls) over w, 0.0e0) as w,
     last_value(case when reset or mission is not null then {'m': mission} end ignore nulls) over w as held,
     last_value(case when reset then {'p': progress} end ignore nulls) over w as reached
     from said window w as (partition by robot_id order by ts, event_id rows between unbounded preceding and current row)),
   posed as (select * exclude (held, reached), held.m as mission, reached.p as progress from pose)"""


def pose_messages(t: Tables):
    rows = M.parse_status(M.route_messages(t.view("fx_poses"))).filter("not dropped").withColumnRenamed("recv_ts", "ts")
    return rows.select("event_id", "robot_id", "ts", *POSE_FIELDS, "mission_reset")


def posed(t: Tables):
    return S.locf_state(pose_messages(t), POSE_FIELDS, slices=robot_slices(t)).drop("mission_reset")


@q("pose_state", f"with {POSE_SQL} select * from posed")
def pose_state(t: Tables):
    """Archived rows with pose, mission and progress, each the last known."""
    return posed(t)


@q("pose_board", f"""with {POSE_SQL}, n as (select robot_id, count(*) as rev from posed group by 1)
   select p.robot_id, round_even(x, 3) as x, round_even(y, 3) as y, round_even(yaw, 3) as yaw, mission, progress, rev from posed p join n on n.robot_id = p.robot_id
   qualify row_number() over (partition by p.robot_id order by ts desc, event_id desc) = 1""")
def pose_board(t: Tables):
    """Where every robot is, what it is on, how far it has got, and its revision."""
    last = FL.latest_state(posed(t))
    return last.select("robot_id", *[F.bround(c, 3).alias(c) for c in ("x", "y", "yaw")], "mission", "progress", F.col("rx_count").alias("rev"))


@q("pose_trail", f"""with {POSE_SQL}, n as (select robot_id, ts, event_id, round_even(x, 3) as x, round_even(y, 3) as y, round_even(v, 3) as v,
     round_even(battery, 1) as battery, row_number() over (partition by robot_id order by ts desc, event_id desc) as n from posed)
   select * from n where n <= 240""")
def pose_trail(t: Tables):
    """The last 240 points of every robot's way."""
    return FL.pose_trail(posed(t))


@q("battery_sparkline", """with b as (select robot_id, ts, event_id, battery, lag(battery) over w as before, row_number() over w as i
     from fx_status where battery is not null window w as (partition by robot_id order by ts, event_id)),
   c as (select *, row_number() over (partition by robot_id order by ts desc, event_id desc) as n from b where i = 1 or before <> battery)
   select robot_id, count(*) as points, arg_min(battery, event_id) as first, arg_max(battery, event_id) as last,
     case when count(*) < 3 then '' when arg_max(battery, event_id) < arg_min(battery, event_id) then 'falling' else 'steady' end as trend
   from c where n <= 60 group by 1""")
def battery_sparkline(t: Tables):
    return FL.battery_sparkline(t.view("fx_status"), slices=robot_slices(t))


@q("fleet_delta", f"""with now as (select robot_id, count(*) as rev from fx_status group by 1),
   seen as (select robot_id, count(*) as seen_rev from fx_status where ts < timestamp '2024-01-29 00:00:00' group by 1
     union all select id, 1 from fx_robots where id like 'ghost-%')
   select robot_id, rev, seen_rev, case when rev is null then 'removed' else 'changed' end as change
   from now full join seen using (robot_id) where rev is distinct from seen_rev""")
def fleet_delta(t: Tables):
    status = t.view("fx_status")
    now = status.groupBy("robot_id").agg(F.count(F.lit(1)).alias("rx_count"))
    seen = status.filter(F.col("ts") < H.time_literal("2024-01-29 00:00:00")).groupBy("robot_id").agg(F.count(F.lit(1)).alias("seen_rev"))
    ghosts = t.view("fx_robots").filter("id like 'ghost-%'").select(F.col("id").alias("robot_id"), F.lit(1).cast("long").alias("seen_rev"))
    return FL.fleet_delta(now, seen.unionByName(ghosts))


@q("revisions", "select event_id, robot_id, row_number() over (partition by robot_id order by ts, event_id) as rev from fx_status")
def revisions(t: Tables):
    return S.number_rows(t.view("fx_status"), "robot_id", ["ts", "event_id"], "rev", robot_slices(t)).select("event_id", "robot_id", "rev")


@q("login_rate_limit", f"""with s as (select *, sum(case when ok then 1 else 0 end) over (partition by client order by ts, event_id) as wins from fx_logins),
   e as (select *, wins - case when ok then 1 else 0 end as epoch from s),
   f as (select *, cast(sum(case when ok then 0 else 1 end) over (partition by client, epoch order by ts_us
     range between {LOGIN_WINDOW_S * 1000000 - 1} preceding and current row) - case when ok then 0 else 1 end as bigint) as failures from e)
   select event_id, client, ok, failures, failures >= 10 as limited from f""")
def login_rate_limit(t: Tables):
    slices = plan_slices_once(t.path + "|logins", t.view("fx_logins"), ["client"], micros("ts"))
    return FL.login_rate_limit(t.view("fx_logins"), LOGIN_WINDOW_S, 10, slices=slices).select(
        "event_id", "client", "ok", "failures", "limited")


# ------------------------------------------------------------------ registry and access

@q("credential_state", """select id, name, case when revoked_at is not null then 'revoked' when secret_hash is not null then 'credentialed'
   else 'none' end as credential from fx_robots""")
def credential_state(t: Tables):
    return H.credential_state(t.view("fx_robots")).select("id", "name", "credential")


TOKEN_SQL = """t as (select robot_id as id, arg_max(token, (created_at, token)) as pending_token,
     arg_max(expires_at, (created_at, token)) as token_expires from fx_tokens
   where used_at is null and expires_at > timestamp '2024-01-25 00:00:00' group by 1)"""


@q("robots_with_token", f"""with {TOKEN_SQL} select id, name, revoked_at, secret_hash is not null as enrolled, pending_token, token_expires,
     case when revoked_at is not null then 'revoked' when secret_hash is not null then 'credentialed'
          when pending_token is not null then 'pending' else 'none' end as credential
   from fx_robots left join t using (id)""")
def robots_with_token(t: Tables):
    rows = FL.robots_with_token(t.view("fx_robots"), t.view("fx_tokens"), "2024-01-25 00:00:00")
    return H.credential_state(rows, F.col("pending_token").isNotNull()).select(
        "id", "name", "revoked_at", F.col("secret_hash").isNotNull().alias("enrolled"), "pending_token", "token_expires", "credential")


@q("robots_live", f"""with {SNAPSHOT_SQL} select id, name, online, state, battery from fx_robots left join snapshot on id = robot_id""")
def robots_live(t: Tables):
    live = snapshot(t).select(F.col("robot_id").alias("id"), "online", "state", "battery")
    return t.view("fx_robots").select("id", "name").join(live, "id", "left")


@q("token_status", """select claim_id, upper(trim(c.token)) as token, case when t.token is null then 'unknown' when used_at is not null then 'used'
     when expires_at < timestamp '2024-01-15 00:00:00' then 'expired' else 'valid' end as verdict
   from fx_token_claims c left join fx_tokens t on t.token = upper(trim(c.token))""")
def token_status(t: Tables):
    return FL.token_status(t.view("fx_token_claims"), t.view("fx_tokens"), "2024-01-15 00:00:00").select("claim_id", "token", "verdict")


@q("credential_audit", """select event_id, username, case when id is null then 'unknown' when revoked_at is not null then 'revoked'
     when secret_hash is null then 'no credential' when sha256(secret) = secret_hash then 'accepted' else 'wrong secret' end as verdict
   from fx_connects left join fx_robots on id = username""")
def credential_audit(t: Tables):
    return FL.credential_audit(t.view("fx_connects"), t.view("fx_robots")).select("event_id", "username", "verdict")


@q("acl_audit", """with p as (select *, string_split(topic, '/') as l from fx_publishes)
   select username, action, count(*) as attempts, count(*) filter (not (username <> '' and action = 'publish' and len(l) = 3 and l[1] = 'fleet'
     and l[2] = username and l[3] in ('status', 'lwt', 'samples', 'raw'))) as denied from p group by 1, 2""")
def acl_audit(t: Tables):
    rows = t.view("fx_publishes").withColumn("allowed", TP.publish_allowed("username", "topic", "action"))
    return rows.groupBy("username", "action").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("allowed")).alias("denied"))


@q("unknown_publishers", """with p as (select distinct username as robot_id from fx_connects)
   select robot_id, 'unregistered' as problem from p where robot_id not in (select id from fx_robots)
   union all select id, 'silent' from fx_robots where id not in (select robot_id from p)""")
def unknown_publishers(t: Tables):
    return FL.unknown_publishers(t.view("fx_connects").select(F.col("username").alias("robot_id")), t.view("fx_robots"))


FILTERS = ["#", "fleet/#", "fleet/+/status", "+/+/raw", "fleet/+", "fleet/#/status", "fleet/amr-000001/status", "+", "+/amr-000001/#"]


@q("topic_match", """with t as (select event_id, topic, string_split(topic, '/') as l from fx_publishes)
   select event_id, true as m0, l[1] = 'fleet' as m1, len(l) = 3 and l[1] = 'fleet' and l[3] = 'status' as m2,
     len(l) = 3 and l[3] = 'raw' as m3, len(l) = 2 and l[1] = 'fleet' as m4, false as m5, topic = 'fleet/amr-000001/status' as m6,
     len(l) = 1 as m7, len(l) >= 2 and l[2] = 'amr-000001' as m8 from t""")
def topic_match(t: Tables):
    return t.view("fx_publishes").select("event_id", *[TP.topic_matches("topic", f).alias(f"m{i}") for i, f in enumerate(FILTERS)])


@q("relay_filter", """select event_id, topic from fx_samples where not (topic like 'diag/%' or topic = 'diag')
   and (topic like 'chassis/%' or topic = 'chassis' or topic = 'nav/progress')""")
def relay_filter(t: Tables):
    return t.view("fx_samples").filter(TP.should_relay("topic", ["chassis/#", "nav/+"], ["diag/#", "$SYS/#"])).select("event_id", "topic")


@q("live_values", f"""with {LATEST_SQL}, f as (select robot_id, unnest([{{'key': 'battery', 'value': cast(battery as varchar)}},
     {{'key': 'state', 'value': state}}, {{'key': 'temp', 'value': cast(temp as varchar)}}]) as p from latest)
   select robot_id, p.key as key, p.value as value from f
   union all select robot_id, topic, arg_max(coalesce(cast(num as varchar), payload), event_id) from fx_samples group by 1, 2""")
def live_values(t: Tables):
    return FL.live_values(latest(t), t.view("fx_samples"), ["battery", "state", "temp"])


@q("latest_topic_value", """select robot_id, topic, num, payload, ts as seen_at from fx_samples
   qualify row_number() over (partition by robot_id, topic order by ts desc, event_id desc) = 1""")
def latest_topic_value(t: Tables):
    return FL.latest_topic_value(t.view("fx_samples"))


@q("retained_values", """with m as (select topic, arg_max(payload, event_id) as payload from (
     select event_id, recv_ts, topic, case when event_id % 2 = 0 and topic like '%lwt' then '' else payload end as payload from fx_messages) group by 1)
   select * from m where payload <> ''""")
def retained_values(t: Tables):
    rows = t.view("fx_messages").withColumn("payload", F.expr(
        "case when event_id % 2 = 0 and topic like '%lwt' then '' else payload end")).withColumnRenamed("recv_ts", "ts")
    return FL.retained_values(rows)


@q("push_devices", """select substring(endpoint, 1, 50) || '…' as endpoint, label, created_at, last_ok, failures from fx_push""")
def push_devices(t: Tables):
    return FL.push_devices(t.view("fx_push"), 50).select("endpoint", "label", "created_at", "last_ok", "failures").orderBy("created_at")


@q("push_subscriptions_upsert", """with n as (select endpoint, arg_max(p256dh, arrival) as p, arg_max(auth, arrival) as a,
     arg_max(label, arrival) filter (label is not null) as l from fx_resubscribes group by 1)
   select endpoint, coalesce(p, p256dh) as p256dh, coalesce(a, auth) as auth, coalesce(l, label) as label,
     cast(case when p is not null then 0 else failures end as int) as failures, created_at from fx_push full join n using (endpoint)""")
def push_subscriptions_upsert(t: Tables):
    return FL.upsert_subscriptions(t.view("fx_push"), t.view("fx_resubscribes"))


@q("prune_dead_endpoints", """select endpoint, label, timestamp '2024-01-31 00:00:00' as last_ok from fx_push
   where endpoint not in (select endpoint from fx_deliveries where status_code in (404, 410))""")
def prune_dead_endpoints(t: Tables):
    return FL.prune_dead_endpoints(t.view("fx_push"), t.view("fx_deliveries"), AS_OF).select("endpoint", "label", "last_ok")


# ------------------------------------------------------------------ traffic and storage

RATE_SQL = f"""s as (select *, body_bytes + case when kind = 'http' then 200 else 0 end as bytes from fx_requests),
   a as (select ts_us as at_us, cast(sum(bytes) as bigint) as bytes from s group by 1),
   r as (select at_us, bytes, sum(bytes) over w / greatest((at_us - min(at_us) over w) / 1e6, 1.0) as rate_bps from a
     window w as (order by at_us range between {EGRESS_WINDOW_S * 1000000} preceding and current row))"""


@q("egress_rate", f"with {RATE_SQL} select at_us, bytes, round(rate_bps, 6) as rate_bps from r")
def egress_rate(t: Tables):
    return ST.egress_rate(t.view("fx_requests"), EGRESS_WINDOW_S).withColumn("rate_bps", F.round("rate_bps", 6))


@q("egress_meter", f"""with {RATE_SQL}, p as (select max(rate_bps) as peak, arg_max(rate_bps, at_us) as rate from r),
   t as (select cast(sum(bytes) filter (kind = 'http') as bigint) as http_bytes, cast(sum(bytes) filter (kind = 'ws') as bigint) as ws_bytes,
     count(*) filter (kind = 'http') as http_requests, count(*) filter (kind = 'ws') as ws_frames, cast(sum(bytes) as bigint) as total_bytes,
     greatest((max(ts_us) - min(ts_us)) / 1e6, 1.0) as up from s)
   select http_bytes, ws_bytes, http_requests, ws_frames, total_bytes, round(rate, 1) as rate_bps, round(peak, 1) as peak_bps,
     round(total_bytes / up, 1) as avg_bps, round(rate * 86400 / 1e9, 3) as gb_day, round(rate * 86400 * 30 / 1e9, 2) as gb_month from t, p""")
def egress_meter(t: Tables):
    return ST.egress_meter(t.view("fx_requests"), EGRESS_WINDOW_S)


@q("throughput_verdict", """with b as (select session, floor(ts_us / 432000000000.0e0) as b, sum(bytes) / 432000.0e0 as r from fx_transfers group by 1, 2),
   k as (select *, row_number() over (partition by session order by b) as i, row_number() over (partition by session order by b desc) as j from b),
   h as (select session, count(*) as buckets, avg(r) filter (i <= 2) as head, avg(r) filter (j <= 2) as tail from k group by 1),
   d as (select *, case when head <> 0 then (1 - tail / head) * 100 else 0 end as drop_pct from h)
   select session, buckets, round(drop_pct, 6) as drop_pct, case when buckets < 4 then 'inconclusive' when drop_pct > 25 then 'throttled'
     else 'no-throttle' end as verdict from d""")
def throughput_verdict(t: Tables):
    return ST.throughput_verdict(t.view("fx_transfers"), 5 * DAY)


@q("transfer_rates", """select size_bytes, max(bytes / seconds) as best, median(bytes / seconds) as median from fx_transfers group by 1""")
def transfer_rates(t: Tables):
    rates = t.view("fx_transfers").select("size_bytes", (F.col("bytes") / F.col("seconds")).alias("rate"))
    slices = plan_slices_once(t.path + "|transfers", rates, ["size_bytes"], F.col("rate"))
    return ST.transfer_rates(t.view("fx_transfers"), slices=slices)


@q("storage_by_partition", "select cast(ts as date) as day, count(*) as rows, true as stored from fx_samples group by 1")
def storage_by_partition(t: Tables):
    path = K.scratch_path(t.spark, "samples")
    K.write_archive(t.view("fx_samples").select("robot_id", "topic", "ts", "num", "payload", "flag"), path)
    days = ST.storage_by_day(t.spark.read.parquet(path))
    return days.select("day", "rows", (F.col("bytes") > 0).alias("stored"))


@q("bytes_per_row")
def bytes_per_row(t: Tables):
    return ST.bytes_per_row(ST.storage_by_file(t.table("lineitem")))


@q("storage_projection", f"""with p as (select robot_id, count(*) / greatest((max(ts_us) - min(ts_us)) / 1e6, 1.0) as rate,
     avg(80 + strlen(payload) + strlen(topic)) as size from fx_samples group by 1)
   select robot_id, round(rate, 8) as rows_per_s, round(rate * size * 86400, 4) as bytes_per_day,
     round(rate * size * 86400 * 30 / 1e9, 9) as gb_per_month, round(rate * size * 86400 * {RETENTION_DAYS} / 1e9, 9) as gb_at_retention from p""")
def storage_projection(t: Tables):
    size = F.lit(80) + F.octet_length("payload") + F.octet_length("topic")
    return ST.storage_projection(t.view("fx_samples"), size, RETENTION_DAYS, ["robot_id"])


@q("retention_plan", f"""with p as (select cast(ts as date) as day, count(*) as rows, 'telemetry' as table_name from fx_status group by 1
     union all select cast(ts as date), count(*), 'topic_samples' from fx_samples group by 1)
   select *, day < date '2024-01-31' - {RETENTION_DAYS} as expired from p""")
def retention_plan(t: Tables):
    return ST.retention_plan({"telemetry": t.view("fx_status"), "topic_samples": t.view("fx_samples")}, AS_OF[:10], RETENTION_DAYS)


@q("emergency_retention", """with r as (select *, sum(case when free_pct > 15 then 1 else 0 end) over w as relief,
     sum(case when free_pct <= 5 then 1 else 0 end) over w as nth from fx_disk window w as (partition by volume order by ts, event_id)),
   d as (select day, row_number() over (order by day) as nth from (select distinct cast(ts as date) as day from fx_status))
   select volume, ts, 'critical' as severity, free_pct, day as dropped_day from r left join d using (nth) where free_pct <= 5
   union all select volume, ts, 'warn', free_pct, null from (select * from r where free_pct > 5 and free_pct <= 15
     qualify row_number() over (partition by volume, relief order by ts, event_id) = 1)""")
def emergency_retention(t: Tables):
    slices = plan_slices_once(t.path + "|disk", t.view("fx_disk"), ["volume"], micros("ts"))
    days = t.view("fx_status").select(F.to_date("ts").alias("day")).distinct()
    return ST.emergency_retention(t.view("fx_disk"), days, slices=slices)


@q("size_retention", """with s as (select name, size, sum(size) over (order by seq desc) as newer from fx_files)
   select name, size, newer <= 500000 as kept from s""")
def size_retention(t: Tables):
    files = t.view("fx_files").withColumn("folder", F.lit("recordings"))
    slices = plan_slices_once(t.path + "|files", files, ["folder"], F.col("seq"))
    return ST.size_retention(files, 500_000, ["folder"], slices).select("name", "size", "kept")


SECRET_ALTS = {"w": "[\\p{L}\\p{N}_-]", "m": "[\\p{L}\\p{N}_.+-]", "d": "[\\p{L}\\p{N}_.]"}
_PATTERN_SQL = ", ".join(f"('{label}', '{p}')" for label, p in {
    **X.PATTERNS, "tailnet url": f"{SECRET_ALTS['w']}+\\.ts\\.net",
    "email": f"{SECRET_ALTS['m']}+@{SECRET_ALTS['w']}+\\.{SECRET_ALTS['d']}+"}.items())


@q("secret_scan", rf"""with p(label, pat) as (values {_PATTERN_SQL}),
   m as (select doc_id, label, regexp_extract_all(text, pat) as hits, string_split_regex(text, pat) as gaps from documents, p),
   i as (select *, unnest(generate_series(1, len(hits))) as n from m where len(hits) > 0)
   select doc_id, label, hits[n] as hit, cast(1 + len(string_split(array_to_string(gaps[1:n], '') || array_to_string(hits[1:n-1], ''), chr(10))) - 1 as int) as line
   from i where hits[n] not in ('XXXX-XXXX-XXXX', 'tskey-auth-XXXXX', 'tskey-auth-XXXX')""")
def secret_scan(t: Tables):
    return X.secret_scan(t.table("documents"), "doc_id")


# ------------------------------------------------------------------ sinks (written, then read back)

@q("write_telemetry", f"""with {TELEMETRY_SQL} select robot_id, ts, battery, state, v, w, temp, wifi, odom, cast(ts as date) as day from telemetry""")
def write_telemetry(t: Tables):
    path = K.scratch_path(t.spark, "telemetry")
    K.write_archive(telemetry(t).select("robot_id", "ts", "battery", "state", "v", "w", "temp", "wifi", "odom"), path)
    return t.spark.read.parquet(path)


@q("write_topic_samples", """select robot_id, topic, ts, num, payload, flag, cast(ts as date) as day from fx_samples""")
def write_topic_samples(t: Tables):
    path = K.scratch_path(t.spark, "samples")
    K.write_archive(t.view("fx_samples").select("robot_id", "topic", "ts", "num", "payload", "flag"), path)
    return t.spark.read.parquet(path)


@q("scan_written_days", """select robot_id, topic, ts, num, payload, flag, cast(ts as date) as day from fx_samples
   where ts >= timestamp '2024-01-03 06:00:00' and ts < timestamp '2024-01-28 00:00:00'""")
def scan_written_days(t: Tables):
    path = K.scratch_path(t.spark, "samples")
    K.write_archive(t.view("fx_samples").select("robot_id", "topic", "ts", "num", "payload", "flag"), path)
    return H.scan_archive(t.spark.read.parquet(path), "2024-01-03 06:00:00", "2024-01-28 00:00:00")


@q("append_events", "select id, robot_id, ts, kind, severity, detail from fx_audit")
def append_events(t: Tables):
    path = K.scratch_path(t.spark, "events")
    audit = t.view("fx_audit")
    K.append_events(audit.filter("severity = 'critical'"), path)
    K.append_events(audit.filter("severity <> 'critical'"), path)
    return t.spark.read.parquet(path)


@q("apply_retention", f"""select cast(ts as date) as day, count(*) as rows from fx_status
   where cast(ts as date) >= date '2024-01-31' - {RETENTION_DAYS} group by 1""")
def apply_retention(t: Tables):
    path = K.scratch_path(t.spark, "retained")
    K.write_archive(t.view("fx_status").select("robot_id", "ts", "battery"), path)
    K.apply_retention(t.spark, path, AS_OF[:10], RETENTION_DAYS)
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


@q("sweep_retention", f"""select case when event_id % 5 = 0 then null else cast(ts as date) end as day, count(*) as rows from fx_status
   where cast(ts as date) >= date '2024-01-31' - {RETENTION_DAYS} group by 1""")
def sweep_retention(t: Tables):
    """Retention of an archive in which every fifth row has lost its time and lies in the folder without a day."""
    path, lost = K.scratch_path(t.spark, "swept"), F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    K.write_archive(t.view("fx_status").select("robot_id", lost.alias("ts"), F.col("ts").alias("recv_ts"), "battery"), path)
    K.apply_retention(t.spark, path, AS_OF[:10], RETENTION_DAYS, "recv_ts")
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))


@q("merge_catalog", f"with {CATALOG_SQL} select * from catalog")
def merge_catalog(t: Tables):
    rows = t.view("fx_samples")
    cut = H.time_literal("2024-01-16 00:00:00")
    return K.merge_catalog(H.catalog(rows.filter(F.col("ts") < cut)), H.catalog(rows.filter(F.col("ts") >= cut)))


@q("touch_last_seen", """select id, name, max(ts) as last_seen from fx_robots left join fx_status on id = robot_id group by 1, 2""")
def touch_last_seen(t: Tables):
    return K.touch_last_seen(t.view("fx_robots"), t.view("fx_status")).select("id", "name", "last_seen")


@q("write_recording", "select topic as n, count(*) as samples from fx_samples group by 1")
def write_recording(t: Tables):
    path = K.scratch_path(t.spark, "recording")
    RC.write_recording(RC.as_lines(t.view("fx_samples")), path, rows_per_file=20_000)
    return RC.read_recording(t.spark, path).groupBy("n").agg(F.count(F.lit(1)).alias("samples"))


@q("read_recording", """select ts_us / 1e6 as t, topic as n, cast(event_id as varchar) as v from fx_samples where event_id % 50 <> 0""")
def read_recording(t: Tables):
    path = K.scratch_path(t.spark, "torn")
    lines = t.view("fx_samples").select("event_id", F.to_json(F.struct(
        (F.col("ts_us") / 1e6).alias("t"), F.col("topic").alias("n"), F.col("event_id").alias("v"))).alias("line"))
    torn = F.when(F.col("event_id") % 50 == 0, F.expr("left(line, 20)")).otherwise(F.col("line"))
    lines.select(torn.alias("line")).write.option("compression", "gzip").text(path)
    return RC.read_recording(t.spark, path)


def _snapshot_tables(t: Tables):
    return {"robots": t.view("fx_robots"), "alerts": t.view("fx_alerts"), "events": t.view("fx_audit"),
            "telemetry": t.view("fx_status"), "topic_samples": t.view("fx_samples")}


@q("snapshot_export", """select 'robots' as table_name, count(*) as rows from fx_robots union all select 'alerts', count(*) from fx_alerts
   union all select 'events', count(*) from fx_audit union all select 'telemetry', 0 union all select 'topic_samples', 0""")
def snapshot_export(t: Tables):
    target = K.snapshot_export(_snapshot_tables(t), K.scratch_path(t.spark, "snapshots"), "20240131-000000", with_history=False)
    return H.table_counts(K.snapshot_restore(t.spark, target))


@q("snapshot_restore", "select event_id, robot_id, topic, ts, ts_us, num, payload, flag from fx_samples")
def snapshot_restore(t: Tables):
    root = K.scratch_path(t.spark, "snapshots")
    K.snapshot_export(_snapshot_tables(t), root, "20240131-000000")
    newest = K.snapshot_list(t.spark, root)[-1]
    return K.snapshot_restore(t.spark, f"{root}/{newest}")["topic_samples"]
