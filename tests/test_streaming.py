"""Streams fed in several micro-batches give the batch result."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros
from fleetlens.operators import history as H
from fleetlens.operators import presence as P
from fleetlens.operators import quality as Q
from fleetlens.operators import relay as R
from fleetlens.operators import state as S
from fleetlens.sources import messages as M
from fleetlens.sources import sinks as K
from fleetlens.streaming import jobs as J
from fleetlens.streaming.processors import STATE_FIELDS

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def feed(spark, tables):
    """A view as a stream of time-ordered files, one per micro-batch."""

    def make(view, files=4):
        rows = tables.view(view)
        path = K.scratch_path(spark, f"feed-{view}")
        n = rows.count()
        # the same cuts in time for every view, so that two feeds stay in step
        part = F.least(F.floor((F.dayofyear("ts") - 1) * files / 30), F.lit(files - 1))
        for i in range(files):
            rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
        assert spark.read.parquet(path).count() == n
        return J.read_stream(spark, path, rows)

    return make


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def test_relay(spark, tables, feed):
    limits = {"min_gap_s": 12 * 3600, "heartbeat_s": 3 * 86400, "deadband": 5.0}
    got = spark.read.parquet(J.run_once(J.relay_stream(feed("fx_samples"), **limits), "relay"))
    want = R.relay_decisions(tables.view("fx_samples"), ["robot_id", "topic"], "num", "payload", **limits)
    assert same(got, want.select(*got.columns))


def test_state(spark, tables, feed):
    got = spark.read.parquet(J.run_once(J.state_stream(feed("fx_status")), "state"))
    want = S.locf_state(tables.view("fx_status"), STATE_FIELDS)
    assert same(got, want.select(*got.columns))


def test_presence(spark, tables, feed):
    data, lwt = feed("fx_status", 3), feed("fx_lwt", 3)
    limits = {"offline_after_s": 6 * 3600, "stale_after_s": 60 * 3600}
    out = J.presence_stream(data, lwt, disorder="10 days", **limits)
    got = spark.read.parquet(J.run_once(out, "presence"))
    known = J.signals(tables.view("fx_status"), tables.view("fx_lwt"))
    last = known.filter(F.col("at_us") <= F.unix_micros(F.lit(AS_OF).cast("timestamp"))).groupBy("robot_id").agg(F.max("at_us").alias("l"))
    want = P.presence_timeline(tables.view("fx_status"), tables.view("fx_lwt"), AS_OF, **limits).select(
        "robot_id", micros("start_ts").alias("at_us"), "presence")
    pick = lambda df: df.join(last, "robot_id").filter("at_us <= l").select("robot_id", "at_us", "presence")
    assert same(pick(got), pick(want))


def test_timers_report_silence(spark):
    base = 1_705_000_000
    rows = [("quiet", 0), ("busy", 0)] + [("busy", s) for s in range(10, 400, 10)]
    schema = "robot_id string, ts_us long, event_id long"
    path = K.scratch_path(spark, "silence")
    for cut in (range(0, 100), range(100, 401)):
        part = [(r, (base + s) * 1_000_000, s) for r, s in rows if s in cut]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    data = J.read_stream(spark, path, spark.createDataFrame([], schema))
    lwt = spark.createDataFrame([], "robot_id string, ts_us long, event_id long, payload string")
    lwt_path = K.scratch_path(spark, "no-lwt")
    lwt.write.parquet(lwt_path)
    out = J.presence_stream(data, J.read_stream(spark, lwt_path, lwt), 15, 100, disorder="0 seconds")
    got = spark.read.parquet(J.run_once(out, "silence")).filter("robot_id = 'quiet'").orderBy("at_us").collect()
    assert [(r.at_us - base * 1_000_000, r.presence) for r in got] == [(0, "ok"), (15_000_001, "stale"), (100_000_001, "offline")]


def test_catalog(spark, tables, feed):
    root = K.scratch_path(spark, "catalog")
    J.catalog_job(feed("fx_samples"), root).awaitTermination()
    assert same(K.read_latest(spark, root), H.catalog(tables.view("fx_samples")))
    assert len(K.list_children(spark, root)) == 4


@pytest.fixture(scope="module")
def newest_first(spark):
    """A view as files that arrive newest first, each in descending order."""

    def make(rows, order, files=5):
        path = K.scratch_path(spark, "newest-first")
        cut = rows.withColumn("_p", F.ntile(files).over(Window.orderBy(F.col(order).desc())))
        for i in range(1, files + 1):
            cut.filter(F.col("_p") == i).drop("_p").coalesce(1).orderBy(F.col(order).desc()).write.mode("append").parquet(path)
            time.sleep(1.1)  # file sources take files in order of their time stamps
        return J.read_stream(spark, path, rows)

    return make


def test_late_batches_are_never_lost(spark, tables, newest_first):
    raw = tables.view("fx_batches").select("topic", "payload", "recv_ts")
    got = spark.read.parquet(J.run_once(J.ingest_stream(newest_first(raw, "recv_ts")), "late", idle_batches=False))
    batches = M.batch_headers(M.route_messages(raw))
    want = M.explode_samples(M.batch_items(Q.measure_skew(Q.dedup_batches(batches))))
    assert got.count() == want.count()
    key = lambda df, topic: sorted(map(tuple, df.select("robot_id", topic, "num").collect()), key=repr)
    assert key(got, "topic") == key(want, "sample_topic")


def test_first_copy_wins_inside_a_micro_batch(spark, tables, newest_first):
    raw = tables.view("fx_batches").select("topic", "payload", "recv_ts")
    got = spark.read.parquet(J.run_once(J.ingest_stream(newest_first(raw, "recv_ts", files=1)), "reversed", idle_batches=False))
    batches = M.batch_headers(M.route_messages(raw))
    want = Q.correct_timestamps(M.explode_samples(M.batch_items(Q.measure_skew(Q.dedup_batches(batches)))))
    key = lambda df, topic: sorted(map(tuple, df.select("robot_id", topic, "ts", "num", "recv_ts").collect()), key=repr)
    assert key(got, "topic") == key(want, "sample_topic")


def test_windows_and_sessions_count_late_rows(spark, tables, newest_first):
    samples = tables.view("fx_samples")
    path = J.run_parts(newest_first(samples, "ts"), "late-counts", lambda rows: J.tumbling_counts(rows, "1 day"))
    assert J.sum_parts(spark.read.parquet(path).drop("b")).agg(F.sum("samples")).first()[0] == samples.count()
    gap = 36 * 3600
    path = J.run_parts(newest_first(samples, "ts"), "late-sessions", lambda rows: J.activity_stretches(rows, f"{gap} seconds"))
    got = J.join_stretches(spark.read.parquet(path).drop("b"), gap)
    whole = J.join_stretches(samples.select("robot_id", F.lit(1).cast("long").alias("samples"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts")), gap)
    assert same(got, whole)


def test_tumbling(spark, tables, feed):
    path = J.run_parts(feed("fx_samples"), "tumbling", lambda rows: J.tumbling_counts(rows, "1 day"))
    got = J.sum_parts(spark.read.parquet(path).drop("b"))
    want = tables.view("fx_samples").groupBy("robot_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("num"), 6).alias("num"))
    assert same(got, want)
