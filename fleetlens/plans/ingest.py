"""Message decoding, redelivery, clock correction and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import scalars as C
from fleetlens.operators import quality as Q
from fleetlens.operators import state as S
from fleetlens.plans.history import robot_slices
from fleetlens.plans.suite import Suite, Tables
from fleetlens.sources import messages as M

SUITE = Suite()
q = SUITE.query

ROUTED_SQL = """routed as (select *, split_part(topic, '/', 2) as robot_id,
   case split_part(topic, '/', 3) when 'lwt' then 'lwt' when 'status' then 'status'
        when 'samples' then 'samples' when 'raw' then 'samples' end as lane
   from fx_messages where len(string_split(topic, '/')) >= 3)"""


def lane(t: Tables, name: str):
    return M.route_messages(t.view("fx_messages")).filter(F.col("lane") == name)


@q("route_messages", f"with {ROUTED_SQL} select event_id, robot_id, lane from routed where lane is not null")
def route_messages(t: Tables):
    return M.route_messages(t.view("fx_messages")).select("event_id", "robot_id", "lane")


@q("filter_payload_size", "select event_id, topic from fx_messages where strlen(payload) <= 120")
def filter_payload_size(t: Tables):
    return M.limit_payload(t.view("fx_messages"), max_bytes=120).select("event_id", "topic")


@q("decode_lwt", f"""with {ROUTED_SQL} select event_id, robot_id,
   lower(trim(trim(payload), '"')) in ('online', '1', 'true', 'up') as up from routed where lane = 'lwt'""")
def decode_lwt(t: Tables):
    return lane(t, "lwt").select("event_id", "robot_id", M.link_up("payload").alias("up"))


NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _num(path: str, alias: str | None = None) -> str:
    one = f"j->>'{path}'"
    pick = f"coalesce({one}, j->>'{alias}')" if alias else one
    return f"case when regexp_matches({pick}, {NUMBER}) then cast({pick} as double) end"


STATUS_SQL = f"""{ROUTED_SQL}, parsed as (select event_id, robot_id,
     case when json_valid(payload) and json_type(case when json_valid(payload) then payload else 'null' end) = 'OBJECT'
          then cast(payload as json) end as j from routed where lane = 'status'),
   status as (select event_id, coalesce(nullif(j->>'$.id', ''), robot_id) as robot_id, j is null as dropped,
     nullif(j->>'$.name', '') as name, coalesce(nullif(j->>'$.state', ''), nullif(j->>'$.status', '')) as state,
     case when {_num('$.battery', '$.batt')} is not null
          then greatest(0.0, least(100.0, {_num('$.battery', '$.batt')})) end as battery,
     {_num('$.pose.x', '$.x')} as x, {_num('$.pose.y', '$.y')} as y, {_num('$.pose.yaw', '$.theta')} as yaw,
     {_num('$.vel.v', '$.linear')} as v, {_num('$.vel.w', '$.angular')} as w,
     coalesce(j->>'$.mission.id', j->>'$.mission') as mission, {_num('$.mission.progress')} as progress,
     case when j->>'$.error' = '' then '' else coalesce(
        array_to_string(cast(json_extract(j, '$.errors') as varchar[]), ','), j->>'$.error') end as errors,
     {_num('$.temp', '$.temperature')} as temp, {_num('$.wifi', '$.rssi')} as wifi, {_num('$.odom', '$.odom_m')} as odom,
     case when j is null then null else coalesce('gripper=' || (j->>'$.gripper'), '') end as extra from parsed)"""


def status_rows(t: Tables, extra_keys=None):
    return M.parse_status(lane(t, "status"), extra_keys=extra_keys)


@q("parse_status", f"with {STATUS_SQL} select * from status")
def parse_status(t: Tables):
    entries = F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return status_rows(t).select(
        "event_id", "robot_id", "dropped", "name", "state", "battery", "x", "y", "yaw", "v", "w", "mission", "progress",
        F.array_join("errors", ",").alias("errors"), "temp", "wifi", "odom",
        F.array_join(F.array_sort(entries), ",").alias("extra"))


@q("extra_merge", f"""with {STATUS_SQL} select robot_id, 'gripper' as key, arg_max(substring(extra, 9), event_id) as value
   from status where extra <> '' group by 1""")
def extra_merge(t: Tables):
    return S.latest_extra(status_rows(t).filter("not dropped").withColumnRenamed("recv_ts", "ts"))


@q("extra_history", f"""with {STATUS_SQL}, x as (select robot_id, event_id, substring(extra, 9) as value from status where extra <> '')
   select robot_id, event_id, 'gripper' as key, value from x
   qualify value is distinct from lag(value) over (partition by robot_id order by event_id)""")
def extra_history(t: Tables):
    rows = S.merge_extra(status_rows(t).filter("not dropped").withColumnRenamed("recv_ts", "ts"))
    return rows.select("robot_id", "event_id", "key", "value")


BATCH_SQL = f"""{ROUTED_SQL}, body as (select event_id, robot_id, epoch_us(recv_ts) as recv_us, cast(payload as json) as j
     from routed where lane = 'samples'),
   batch as (select *, case json_type(j) when 'ARRAY' then j else json_extract(j, '$.b') end as b,
       case when json_type(j) = 'OBJECT' then cast(round(cast(j->>'$.ts' as double) * 1e6) as bigint) end as sent_us from body),
   item as (select * exclude (j), unnest(cast(b as json[])) as i, generate_subscripts(cast(b as json[]), 1) - 1 as pos from batch
     where b is not null),
   good as (select *, coalesce(json_type(i) = 'ARRAY' and json_array_length(i) >= 3
       and json_type(i, '$[0]') = 'VARCHAR' and (i->>'$[0]') <> '', false) as ok from item)"""


def batch_rows(t: Tables):
    return M.parse_batches(lane(t, "samples"))


@q("explode_samples", f"""with {BATCH_SQL} select event_id, robot_id, cast(pos as int) as pos, i->>'$[0]' as sample_topic,
   case when coalesce(cast(i->>'$[1]' as double), 0) <> 0 then cast(round(cast(i->>'$[1]' as double) * 1e6) as bigint)
        else recv_us end as raw_us,
   case when i->>'$[2]' = 'on' then 1.0 when json_type(i, '$[2]') = 'OBJECT' then null
        else cast(i->>'$[2]' as double) end as num,
   coalesce(try_cast(i->>'$[3]' as int), 0) as flag from good where ok""")
def explode_samples(t: Tables):
    return M.explode_samples(batch_rows(t)).select(
        "event_id", "robot_id", "pos", "sample_topic", "raw_us", "num", "flag")


@q("bad_items", f"""with {BATCH_SQL} select robot_id, count(*) as bad_items from good where not ok group by 1""")
def bad_items(t: Tables):
    return M.explode_items(batch_rows(t)).filter("dropped").groupBy("robot_id").agg(F.count(F.lit(1)).alias("bad_items"))


# ------------------------------------------------------------------ redelivered batches

DEDUP_SQL = """b as (select *, cast(payload as json) as j, epoch_us(recv_ts) as recv_us from fx_batches),
   e as (select topic, robot_id, recv_ts, recv_us, j->>'$.boot' as boot, cast(j->>'$.seq' as bigint) as seq,
      cast(round(cast(j->>'$.ts' as double) * 1e6) as bigint) as sent_us,
      cast(json_extract(j, '$.b') as json[]) as items from b),
   k as (select *, sent_us - recv_us as skew_us from e
      qualify boot is null or row_number() over (partition by robot_id, boot, seq order by recv_ts, topic) = 1)"""


def batches(t: Tables):
    df = t.view("fx_batches").select("topic", "recv_ts", "payload")
    return M.batch_headers(M.route_messages(df))


def unique_batches(t: Tables):
    return Q.measure_skew(Q.dedup_batches(batches(t)))


@q("dedup_batches", f"with {DEDUP_SQL} select topic, robot_id, recv_ts, boot, seq, cast(len(items) as int) as n from k")
def dedup_batches(t: Tables):
    return Q.dedup_batches(batches(t)).select("topic", "robot_id", "recv_ts", "boot", "seq", F.col("n_items").alias("n"))


@q("measure_skew", f"""with {DEDUP_SQL} select robot_id, recv_ts, skew_us, cast(trunc(skew_us / 1000.0e0) as int) as skew_ms from k""")
def measure_skew(t: Tables):
    return unique_batches(t).select("robot_id", "recv_ts", "skew_us", "skew_ms")


CORRECT_SQL = f"""{DEDUP_SQL}, r as (select robot_id, recv_ts, recv_us, skew_us, unnest(items) as i from k),
   s as (select *, cast(round(cast(i->>'$[1]' as double) * 1e6) as bigint)
      - case when abs(skew_us) >= 2000000 then skew_us else 0 end as stamp from r),
   c as (select *, stamp < recv_us - 604800000000 or stamp > recv_us + 300000000 as clamped from s)"""


def corrected(t: Tables):
    return Q.correct_timestamps(M.explode_samples(M.batch_items(unique_batches(t))))


@q("correct_timestamps", f"""with {CORRECT_SQL} select robot_id, recv_ts, cast(trunc(skew_us / 1000.0e0) as int) as skew_ms,
   i->>'$[0]' as topic, case when i->>'$[2]' = 'true' then 1.0 when i->>'$[2]' = 'false' then 0.0
        else cast(i->>'$[2]' as double) end as num, cast(i->>'$[3]' as int) as flag, clamped,
   make_timestamp(case when clamped then recv_us else stamp end) as ts from c""")
def correct_timestamps(t: Tables):
    return corrected(t).select("robot_id", "recv_ts", "skew_ms", F.col("sample_topic").alias("topic"), "num", "flag",
                               "clamped", "ts")


@q("late_data", f"""with {CORRECT_SQL} select robot_id, cast(floor((recv_us - case when clamped then recv_us else stamp end)
   / 3600000000.0e0) as bigint) as hours_late, count(*) as samples, count(*) filter (clamped) as clamped from c group by 1, 2""")
def late_data(t: Tables):
    late = F.floor((F.col("recv_us") - C.micros("ts")) / F.lit(3.6e9))
    return corrected(t).groupBy("robot_id", late.alias("hours_late")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("clamped").alias("clamped"))


CLOCK = "arg_min(skew_us, (recv_ts, topic))"


@q("clock_events", f"""with {DEDUP_SQL} select robot_id, min(recv_ts) as ts, 'clock' as kind, 'warn' as severity,
   round({CLOCK} / 1e6, 2) as skew_s from k where abs(skew_us) >= 2000000 group by 1""")
def clock_events(t: Tables):
    return Q.clock_events(unique_batches(t))


@q("bad_clock_robots", f"""with {DEDUP_SQL} select robot_id, min(recv_ts) as first_bad, count(*) as bad_batches,
   max(abs(skew_us)) / 1e6 as worst_s from k where abs(skew_us) >= 2000000 group by 1""")
def bad_clock_robots(t: Tables):
    return unique_batches(t).filter(Q.needs_correction()).groupBy("robot_id").agg(
        F.min("recv_ts").alias("first_bad"), F.count(F.lit(1)).alias("bad_batches"),
        (F.max(F.abs("skew_us")) / 1e6).alias("worst_s"))


@q("clock_skew_table", f"""with {DEDUP_SQL}, l as (select robot_id, arg_max(skew_us, (recv_ts, topic)) / 1e6 as skew_s from k
   where skew_us is not null group by 1)
   select robot_id, skew_s, abs(skew_s) as off_by_s, case when skew_s > 0 then 'fast' else 'slow' end as direction
   from l where abs(skew_s) >= 2""")
def clock_skew_table(t: Tables):
    return Q.clock_skew_table(unique_batches(t))


@q("duplicate_counts", f"""with {DEDUP_SQL}, per as (select robot_id, boot, seq, count(*) as copies, sum(len(items)) as a,
     arg_min(len(items), (recv_ts, topic)) as kept from e where boot is not null group by 1, 2, 3)
   select robot_id, count(*) as batches, cast(sum(kept) as bigint) as samples, cast(sum(copies - 1) as bigint) as duplicate_batches,
     cast(sum(a - kept) as bigint) as duplicate_samples, cast(0 as bigint) as conflicting_duplicates from per group by 1""")
def duplicate_counts(t: Tables):
    return Q.duplicate_counts(batches(t))


@q("ingest_counters", f"""with {STATUS_SQL}, {BATCH_SQL.replace(ROUTED_SQL + ', ', '')},
   env as (select *, json_type((select j from body where body.event_id = batch.event_id)) = 'OBJECT' as o,
      (select j->>'$.boot' from body where body.event_id = batch.event_id) as boot from batch)
   select (select count(*) filter (not dropped) from status) as accepted,
     (select count(*) filter (dropped) from status) as bad_status,
     (select count(*) from batch where b is null) as bad_batches,
     (select count(*) from env where o and b is not null and boot is null) as unversioned,
     cast(0 as bigint) as duplicate_batches, cast(0 as bigint) as duplicate_samples,
     (select count(*) from good where not ok) as bad_items, (select count(*) from good where ok) as samples,
     (select count(*) from good where ok and (
        case when coalesce(cast(i->>'$[1]' as double), 0) <> 0 then cast(round(cast(i->>'$[1]' as double) * 1e6) as bigint)
             else recv_us end - case when abs(sent_us - recv_us) >= 2000000 then sent_us - recv_us else 0 end)
        not between recv_us - 604800000000 and recv_us + 300000000) as clamped""")
def ingest_counters(t: Tables):
    b = M.batch_headers(lane(t, "samples"))
    rows = Q.correct_timestamps(M.explode_items(M.batch_items(Q.measure_skew(b.filter("n_items is not null")))))
    return Q.ingest_counters(status_rows(t), b, rows)


OUTAGE_SQL = """mixed as (select robot_id, ts, event_id, 1 as kind, null as up from fx_samples union all
     select robot_id, ts, event_id, 0, payload = 'online' from fx_lwt),
   stated as (select *, coalesce(last_value(up ignore nulls) over (partition by robot_id order by ts, kind, event_id
     rows between unbounded preceding and current row), true) as state from mixed),
   edged as (select *, case when not state and coalesce(lag(state) over (partition by robot_id order by ts, kind, event_id), true) then ts end as start from stated),
   outage as (select *, last_value(start ignore nulls) over (partition by robot_id order by ts, kind, event_id
     rows between unbounded preceding and current row) as down_since from edged)"""


def link_switches(t: Tables):
    return t.view("fx_lwt").select("robot_id", "ts", "event_id", (F.col("payload") == "online").alias("up"))


@q("overflow_by_outage", f"""with {OUTAGE_SQL} select robot_id, down_since, least(count(*), 3) as kept, greatest(count(*) - 3, 0) as lost
   from outage where kind = 1 and not state group by 1, 2""")
def overflow_by_outage(t: Tables):
    """Rows that a buffer of three keeps and loses in every outage of a robot's link."""
    return Q.overflow_by_outage(t.view("fx_samples"), link_switches(t), 3, robot_slices(t))


@q("outage_kept", f"""with {OUTAGE_SQL} select robot_id, down_since, ts, event_id from outage where kind = 1 and not state
   qualify row_number() over (partition by robot_id, down_since order by ts desc, event_id desc) <= 3""")
def outage_kept(t: Tables):
    """The rows that are still in the buffer when each outage ends."""
    return Q.overflow(Q.outage_rows(t.view("fx_samples"), link_switches(t), robot_slices(t)), ["robot_id", "down_since"], ["ts", "event_id"], 3)


@q("overflow_accounting", """select robot_id, least(count(*), 40) as kept, greatest(count(*) - 40, 0) as lost
   from fx_samples group by 1""")
def overflow_accounting(t: Tables):
    return Q.overflow_accounting(t.view("fx_samples"), ["robot_id"], 40)


@q("overflow_kept", """select event_id, robot_id from fx_samples
   qualify row_number() over (partition by robot_id order by ts desc, event_id desc) <= 40""")
def overflow_kept(t: Tables):
    return Q.overflow(t.view("fx_samples"), ["robot_id"], ["ts", "event_id"], 40).select("event_id", "robot_id")


# ------------------------------------------------------------------ values

@q("decode_payload", r"""with d as (select event_id, payload, try(decode(payload)) as txt from fx_payloads)
   select event_id, txt is null as is_binary, txt is not null and json_valid(trim(txt)) as is_json,
     case when txt is null then '<' || octet_length(payload) || ' bytes binary>'
          when json_valid(trim(txt)) then case when json_type(trim(txt)) = 'DOUBLE' then regexp_replace(trim(txt), '[.]0$', '')
               else cast(json(trim(txt)) as varchar) end else trim(txt) end as value from d""")
def decode_payload(t: Tables):
    return M.decode_payload(t.view("fx_payloads")).select("event_id", "is_binary", "is_json", "value")


@q("flatten_messages", """with leaf as (select event_id, replace(replace(replace(substring(fullkey, 2), '.', '/'), '[', '/'), ']', '') as path,
     type, atom, json_array_length(value) as n, path as parent from (
       select event_id, fullkey, path, type, atom, value from fx_nested, json_tree(cast(body as json))))
   select event_id, path, value from (
     select event_id, path, case when type = 'NULL' then 'null' when type = 'DOUBLE' then regexp_replace(cast(atom as varchar), '[.]0$', '')
       else cast(atom as varchar) end as value from leaf
       where type not in ('OBJECT', 'ARRAY') and parent not like '%.nine' and len(string_split(path, '/')) <= 7
     union all select event_id, path || '/len', cast(n as varchar) from leaf where type = 'ARRAY' and n > 8)""")
def flatten_messages(t: Tables):
    return M.flatten_json(t.view("fx_nested"), ["event_id"])


@q("to_numeric", rf"""with s as (select event_id, trim(raw) as s from fx_values)
   select event_id, case when s = '' or length(s) > 32 then null when lower(s) in ('true', '1', 'on', 'yes', 't') then 1.0
     when lower(s) in ('false', '0', 'off', 'no', 'f') then 0.0
     when regexp_matches(s, {NUMBER}) and isfinite(try_cast(s as double)) then try_cast(s as double) end as num from s""")
def to_numeric(t: Tables):
    return t.view("fx_values").select("event_id", C.to_numeric("raw").alias("num"))


@q("finite_or_default", rf"""select event_id, coalesce(case when regexp_matches(trim(raw), {NUMBER}) and isfinite(try_cast(trim(raw) as double))
   then try_cast(trim(raw) as double) end, -1.0) as num from fx_values""")
def finite_or_default(t: Tables):
    return t.view("fx_values").select("event_id", C.finite_or_default("raw", -1.0).alias("num"))


@q("parse_time_args", rf"""select event_id, case when regexp_matches(raw, {NUMBER}) then make_timestamp(cast(round(cast(raw as double) * 1e6) as bigint))
   when regexp_matches(raw, '^[0-9]{{4}}-') then cast(try_cast(raw as timestamptz) at time zone 'UTC' as timestamp) end as ts from fx_time_args""")
def parse_time_args(t: Tables):
    return t.view("fx_time_args").select("event_id", C.parse_time("raw").alias("ts"))


@q("bucket_start", """select event_id, make_timestamp(ts_us - ts_us % 7200000000) as two_hours,
   make_timestamp(ts_us - ts_us % 1500000) as one_and_half_s from fx_events""")
def bucket_start(t: Tables):
    return t.view("fx_events").select("event_id", C.bucket_start("ts", 7200).alias("two_hours"),
                                      C.bucket_start("ts", 1.5).alias("one_and_half_s"))


@q("human_bytes", """with n as (select o_orderkey, o_totalprice * o_custkey as n from orders),
   s as (select *, case when n < 1048576 then 1 when n < 1073741824 then 2 when n < 1099511627776 then 3 else 4 end as p from n),
   u as (select *, n / pow(1024.0, p) as x from s)
   select o_orderkey, case when n < 1024 then cast(floor(n) as bigint) || ' B'
     when x < 10 then format('{:.2f}', round(x, 2)) || ' ' || ['KB', 'MB', 'GB', 'TB'][p]
     else format('{:.1f}', round(x, 1)) || ' ' || ['KB', 'MB', 'GB', 'TB'][p] end as shown from u""")
def human_bytes(t: Tables):
    return t.table("orders").select("o_orderkey", C.human_bytes(F.col("o_totalprice") * F.col("o_custkey")).alias("shown"))


@q("human_age", """select event_id, case when value < 60 then format('{:.0f}', round(value, 0)) || 's'
   when value < 3600 then format('{:.0f}', round(value / 60, 0)) || ' min' else format('{:.1f}', round(value / 3600, 1)) || ' h' end as shown
   from (select event_id, value * value as value from events)""")
def human_age(t: Tables):
    return t.table("events").select("event_id", C.human_age(F.col("value") * F.col("value")).alias("shown"))


@q("format_time", "select event_id, strftime(ts, '%m-%d %H:%M:%S') as shown from events")
def format_time(t: Tables):
    return t.table("events").select("event_id", C.format_time("ts").alias("shown"))


@q("truncate_text", "select doc_id, substring(text, 1, 200) as head, length(substring(text, 1, 500)) as kept from documents")
def truncate_text(t: Tables):
    return t.table("documents").select("doc_id", C.truncate_text("text", 200).alias("head"),
                                       F.length(C.truncate_text("text", 500)).cast("bigint").alias("kept"))


@q("same_value", """with s as (select event_id, num, payload, lag(num) over w as pn, lag(payload) over w as pp, lag(event_id) over w as pe
     from fx_samples window w as (partition by robot_id, topic order by ts, event_id))
   select event_id, case when num is not null and pn is not null then abs(num - pn) <= 5
     else payload is not distinct from pp end as same from s where pe is not null""")
def same_value(t: Tables):
    from fleetlens.operators.sequence import drop_slice, lag, scan
    from fleetlens.plans.history import topic_slices
    rows = scan(t.view("fx_samples"), ["robot_id", "topic"], ["ts", "event_id"],
                {"pn": lag("num"), "pp": lag("payload"), "pe": lag("event_id")}, C.micros("ts"), topic_slices(t))
    return drop_slice(rows).filter("pe is not null").select(
        "event_id", C.same_value("num", "pn", "payload", "pp", 5.0).alias("same"))


@q("sha256_hex", "select event_id, sha256(props) as digest from events")
def sha256_hex(t: Tables):
    return t.table("events").select("event_id", C.sha256_hex("props").alias("digest"))


@q("epoch_math", """select o_orderkey, (epoch_us(timestamp '1999-01-01 00:00:00') - epoch_us(o_orderdate)) / 1e6 as age_s,
   coalesce(nullif(o_orderstatus, 'P'), 'open') as status, greatest(o_totalprice, 1000.0e0) as floor_price,
   abs(o_totalprice - 200000.0e0) as off from orders""")
def epoch_math(t: Tables):
    return t.table("orders").select(
        "o_orderkey", C.seconds_between(F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), "o_orderdate").alias("age_s"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("open")).alias("status"),
        F.greatest("o_totalprice", F.lit(1000.0)).alias("floor_price"), F.abs(F.col("o_totalprice") - 200000.0).alias("off"))


@q("robot_id_check", r"""with s as (select c_custkey, nullif(substring(regexp_replace(regexp_replace(lower(trim(c_name || ' ' || c_mktsegment)),
     '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63), '') as slug from customer)
   select c_custkey, slug, regexp_matches(slug, '^[a-z0-9][a-z0-9_-]{1,62}$') as valid from s""")
def robot_id_check(t: Tables):
    s = C.slug(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return t.table("customer").select("c_custkey", s.alias("slug"), C.valid_robot_id(s).alias("valid"))
