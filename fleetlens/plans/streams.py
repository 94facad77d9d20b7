"""Streaming queries over the given tables, run with all available input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import alerts as A
from fleetlens.operators import presence as P
from fleetlens.plans.alerts import TIME_LOG_SQL, WALK_SQL, robot_names, rules
from fleetlens.plans.fleet import POSE_FIELDS, POSE_SQL, pose_messages
from fleetlens.plans.history import CATALOG_SQL, TELEMETRY_SQL
from fleetlens.plans.ingest import CORRECT_SQL, DEDUP_SQL
from fleetlens.plans.live import LIMITS, RELAY_SQL, TIMELINE_SQL
from fleetlens.plans.params import AS_OF, DEADBAND, HEARTBEAT_S, MIN_GAP_S, OUTAGE_S
from fleetlens.plans.suite import Suite, Tables
from fleetlens.sources import messages as M
from fleetlens.sources import sinks as K
from fleetlens.streaming import jobs as J
from fleetlens.streaming import revisions as R

SUITE = Suite()
q = SUITE.query


class StreamTables(Tables):
    """The same views, with ``events`` read as a file stream."""

    def table(self, name: str) -> DataFrame:
        rows = super().table(name)
        return J.read_stream(self.spark, self.path, rows, f"{name}.parquet") if name == "events" else rows


def live(t: Tables) -> StreamTables:
    s = StreamTables(t.spark, t.path)
    s.tag = f"{t.tag}_live"
    return s


def batch_messages(t: Tables) -> DataFrame:
    """Relayed batches as arriving files: written once, then read as a stream."""
    rows = t.view("fx_batches").select("topic", "payload", "recv_ts")
    path = K.scratch_path(t.spark, "inbox")
    rows.repartitionByRange(4, "recv_ts").write.parquet(path)
    return J.read_stream(t.spark, path, rows, files_per_trigger=4)


@q("stream_dedup_batches", f"with {DEDUP_SQL} select topic, robot_id, recv_ts, boot, seq, cast(len(items) as int) as n from k")
def stream_dedup_batches(t: Tables):
    out = J.dedup_stream(M.batch_headers(M.route_messages(batch_messages(t))))
    path = J.run_once(out.select("topic", "robot_id", "recv_ts", "boot", "seq", F.col("n_items").alias("n")), "dedup", idle_batches=False)
    return t.spark.read.parquet(path)


@q("stream_ingest", f"""with {CORRECT_SQL} select robot_id, i->>'$[0]' as topic, recv_ts, clamped, cast(i->>'$[3]' as int) as flag,
   case when i->>'$[2]' = 'true' then 1.0 when i->>'$[2]' = 'false' then 0.0 else cast(i->>'$[2]' as double) end as num,
   make_timestamp(case when clamped then recv_us else stamp end) as ts from c""")
def stream_ingest(t: Tables):
    path = J.run_once(J.ingest_stream(batch_messages(t)), "samples", ["day"], idle_batches=False)
    return t.spark.read.parquet(path).select("robot_id", "topic", "recv_ts", "clamped", "flag", "num", "ts")


@q("stream_tumbling_counts", """select robot_id, make_timestamp(ts_us - ts_us % 86400000000) as ts, count(*) as samples,
   round(avg(num), 6) as num from fx_samples group by 1, 2""")
def stream_tumbling_counts(t: Tables):
    path = J.run_parts(live(t).view("fx_samples"), "tumbling", lambda rows: J.tumbling_counts(rows, "1 day"))
    return J.sum_parts(t.spark.read.parquet(path).drop("b"))


@q("stream_activity_sessions", f"""with g as (select robot_id, event_id, ts, ts_us, case when ts_us - lag(ts_us) over w < {OUTAGE_S * 1000000} then 0 else 1 end as new
     from fx_samples window w as (partition by robot_id order by ts, event_id)),
   s as (select robot_id, ts, sum(new) over (partition by robot_id order by ts, event_id) as n from g)
   select robot_id, count(*) as samples, min(ts) as first_ts, max(ts) as last_ts from s group by robot_id, n""")
def stream_activity_sessions(t: Tables):
    """All sessions, the ones that may still grow included."""
    path = J.run_parts(live(t).view("fx_samples"), "sessions", lambda rows: J.activity_stretches(rows, f"{OUTAGE_S} seconds"))
    return J.join_stretches(t.spark.read.parquet(path).drop("b"), OUTAGE_S)


@q("stream_relay_sample", f"with {RELAY_SQL} select event_id, robot_id, topic, decision from walk")
def stream_relay_sample(t: Tables):
    out = J.relay_stream(live(t).view("fx_samples"), MIN_GAP_S, HEARTBEAT_S, DEADBAND)
    return t.spark.read.parquet(J.run_once(out, "relay"))


@q("stream_locf_state", f"with {TELEMETRY_SQL} select * exclude (ts_us) from telemetry")
def stream_locf_state(t: Tables):
    return t.spark.read.parquet(J.run_once(J.state_stream(live(t).view("fx_status")), "state"))


@q("stream_pose_state", f"with {POSE_SQL} select * from posed")
def stream_pose_state(t: Tables):
    """Pose, mission and progress of a live job."""
    return t.spark.read.parquet(J.run_once(J.state_stream(pose_messages(live(t)), POSE_FIELDS), "poses"))


@q("stream_presence", f"""with {TIMELINE_SQL} select robot_id, presence, before, start_ts from timeline""")
def stream_presence(t: Tables):
    """The timeline of a live job, the silence that timers report included, as far as AS_OF."""
    s = live(t)
    data, lwt = s.view("fx_status"), s.view("fx_lwt")
    path = J.run_once(J.presence_stream(data, lwt, disorder="2 hours", **LIMITS), "presence")
    return J.open_tail(t.spark.read.parquet(path), J.signals(t.view("fx_status"), t.view("fx_lwt")), AS_OF, **LIMITS)


def newest_first(t: Tables, rows: DataFrame, at: str, files: int = 4) -> DataFrame:
    """``rows`` as files that a stream takes in turn, the newest rows first."""
    path = K.scratch_path(t.spark, "newest-first")
    rows.repartitionByRange(files, F.desc(at)).sortWithinPartitions(F.desc(at)).write.parquet(path)
    return J.read_stream(t.spark, path, rows)


def late_presence(t: Tables) -> R.Revisions:
    revisions = R.presence_revisions(K.scratch_path(t.spark, "presence"), **LIMITS)
    R.run_revisions(newest_first(t, P.signals(t.view("fx_status"), t.view("fx_lwt")), "at_us"), revisions)
    return revisions


@q("stream_presence_late", f"with {TIMELINE_SQL} select robot_id, presence, before, start_ts, end_ts, current from timeline")
def stream_presence_late(t: Tables):
    """The timeline when signals come newest first: every late one revises what was said."""
    return R.presence_at(late_presence(t), t.spark, AS_OF)


@q("stream_alert_log", f"""with {TIME_LOG_SQL} select rule_id, robot_id, rule_name, severity, message, value, started_at, resolved_at from log""")
def stream_alert_log(t: Tables):
    """Open and resolved alerts of running streams; hold times end by the clock, without a further row."""
    s = live(t)
    archive = J.run_once(J.state_stream(s.view("fx_status")), "state")
    state = J.read_archive(t.spark, archive)
    subjects = A.field_subjects(state, A.watched_fields(rules(t))).unionByName(A.topic_subjects(s.view("fx_samples")))
    alerts = R.alert_revisions(K.scratch_path(t.spark, "alerts"))
    R.run_revisions(R.hit_rows(A.with_hits(A.bind_rules(subjects, rules(t)))), alerts)
    quiet = A.presence_intervals(R.presence_at(late_presence(t), t.spark, AS_OF), rules(t)).withColumns({
        "value": F.lit(None).cast("double"), "raw": F.lit(None).cast("string")})
    found = R.alerts_at(alerts, t.spark, AS_OF).unionByName(quiet)
    return A.alert_log(found, rules(t), robot_names(t)).select(
        "rule_id", "robot_id", "rule_name", "severity", "message", "value", "started_at", "resolved_at")


@q("stream_alerts", f"with {WALK_SQL} select rule_id, robot_id, ts, num, mark from walk where mark is not null")
def stream_alerts(t: Tables):
    s = live(t)
    archive = J.run_once(J.state_stream(s.view("fx_status")), "state")
    state = J.read_archive(t.spark, archive)
    subjects = A.field_subjects(state, A.watched_fields(rules(t))).unionByName(A.topic_subjects(s.view("fx_samples")))
    hits = A.with_hits(A.bind_rules(subjects, rules(t)))
    return t.spark.read.parquet(J.run_once(J.alert_stream(hits), "alerts"))


@q("stream_merge_catalog", f"with {CATALOG_SQL} select * from catalog")
def stream_merge_catalog(t: Tables):
    root = K.scratch_path(t.spark, "catalog")
    J.catalog_job(live(t).view("fx_samples"), root).awaitTermination()
    return K.read_latest(t.spark, root)
