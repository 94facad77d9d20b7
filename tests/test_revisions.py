"""Results of streams that rows of any age revise equal the batch operators, in any order of arrival."""

import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from fleetlens.operators import alerts as A
from fleetlens.operators import presence as P
from fleetlens.sources import sinks as K
from fleetlens.streaming import jobs as J
from fleetlens.streaming import revisions as R

AS_OF = "2024-02-10 00:00:00"
BASE = 1_704_067_200  # 2024-01-01
LIMITS = {"offline_after_s": 3600, "stale_after_s": 5 * 3600}
SIGNALS = "robot_id string, at_us long, rank int, event_id long, seen_us long, up boolean"
HITS = """rule_id int, robot_id string, ts timestamp_ntz, event_id long, num double, raw string, op string, limit double,
    clear_value double, hit boolean, hold boolean, for_seconds double, cooldown_min double, _at_us long"""


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def signals(seed, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = (BASE + rng.randrange(0, 20 * 86400, 1200)) * 1_000_000  # many at one instant
        link = rng.random() < 0.25
        rows.append((rng.choice("ab"), at, int(link), i, None if link else at, rng.random() < 0.5 if link else None))
    return rows


def hits(spark, seed, n=150):
    rng, rows = random.Random(seed), []
    rules = {1: ("lt", 20.0, 30.0, 7200.0), 2: ("gt", 50.0, None, 0.0), 3: ("gt", 30.0, 60.0, 3600.0)}  # the last one is strict
    for i in range(n):
        rule = rng.choice(list(rules))
        op, limit, clear, hold_s = rules[rule]
        rows.append((rule, rng.choice("ab"), BASE + rng.randrange(0, 20 * 86400, 1800), i, rng.choice([None, 10.0, 25.0, 40.0, 70.0]), op, limit, clear, hold_s))
    df = spark.createDataFrame(rows, "rule_id int, robot_id string, s long, event_id long, num double, op string, limit double, clear_value double, for_seconds double")
    df = df.withColumns({"ts": F.timestamp_seconds("s").cast("timestamp_ntz"), "raw": F.col("num").cast("string"), "cooldown_min": F.lit(0.0),
                         "limit2": F.lit(None).cast("double"), "text_value": F.lit(None).cast("string")})
    return [tuple(r) for r in R.hit_rows(A.with_hits(df)).collect()]


def arrivals(rows, at, how, seed):
    """Rows in four parts: newest first, oldest first, or mixed."""
    rows = sorted(rows, key=lambda r: r[at], reverse=how == "newest first")
    if how == "mixed":
        random.Random(seed).shuffle(rows)
    cut = -(-len(rows) // 4)
    return [rows[i : i + cut] for i in range(0, len(rows), cut)]


@pytest.mark.parametrize("how,seed", [("newest first", 1), ("mixed", 2), ("oldest first", 3)])
def test_presence(spark, how, seed):
    rows = signals(seed)
    found = R.presence_revisions(K.scratch_path(spark, "presence"), **LIMITS)
    for i, part in enumerate(arrivals(rows, 1, how, seed)):
        found.take(spark.createDataFrame(part, SIGNALS), i)
        if i == 1:
            found.compact(spark, i)
        if i == 2:
            found.take(spark.createDataFrame(part, SIGNALS), i)  # a retry
    at = F.unix_micros(F.lit(AS_OF).cast("timestamp"))
    want = P.timeline_of(P.presence_changes(spark.createDataFrame(rows, SIGNALS), at, **LIMITS), at)
    assert same(R.presence_at(found, spark, AS_OF), want)


@pytest.mark.parametrize("how,seed", [("newest first", 1), ("mixed", 2), ("oldest first", 3)])
def test_alerts(spark, how, seed):
    rows = hits(spark, seed)
    found = R.alert_revisions(K.scratch_path(spark, "alerts"))
    for i, part in enumerate(arrivals(rows, 13, how, seed)):
        found.take(spark.createDataFrame(part, HITS), i)
        if i == 1:
            found.compact(spark, i)
    want = A.alert_intervals_by_time(spark.createDataFrame(rows, HITS).drop("_at_us"), AS_OF)
    assert same(R.alerts_at(found, spark, AS_OF), want)


def test_a_hold_time_ends_without_a_further_row(spark):
    found = R.alert_revisions(K.scratch_path(spark, "alerts"))
    row = lambda s, i, hit: (1, "a", BASE + s, i, 1.0, "1.0", "lt", 5.0, None, hit, hit, 600.0, 0.0)
    take = lambda b, *rows: found.take(spark.createDataFrame(list(rows), HITS.replace("ts timestamp_ntz", "ts long").replace(", _at_us long", "")).withColumns(
        {"_at_us": F.col("ts") * 1_000_000, "ts": F.timestamp_seconds("ts").cast("timestamp_ntz")}), b)
    take(0, row(0, 1, True))
    assert R.alerts_at(found, spark, "2024-01-01 00:09:00").count() == 0
    assert [r.resolved_at for r in R.alerts_at(found, spark, "2024-01-01 00:11:00").collect()] == [None]
    take(1, row(300, 2, False))  # it comes late, after the alert was told
    assert R.alerts_at(found, spark, "2024-01-01 00:11:00").count() == 0


def test_nothing_arrived(spark):
    found = R.presence_revisions(K.scratch_path(spark, "presence"), **LIMITS)
    found.take(spark.createDataFrame([], SIGNALS), 0)
    assert found.current(spark) is None


def test_a_rule_added_between_two_files_acts_from_the_second(spark):
    """Rules are read anew in every micro-batch; a rule switched off ends its alert."""
    rules, inbox, root = (K.scratch_path(spark, n) for n in ("rules", "inbox", "alerts"))
    columns = """rule_id int, scope string, source string, key string, op string, value double, value2 double, text_value string,
        for_seconds double, clear_value double, severity string, cooldown_min double, enabled boolean, valid_from timestamp_ntz"""

    def add(rule_id, limit, enabled, day):
        row = spark.sql(f"""select {rule_id} rule_id, string(null) scope, 'topic' source, 't' key, 'gt' op, {limit}D value, double(null) value2, string(null) text_value,
            0D for_seconds, double(null) clear_value, 'warn' severity, 0D cooldown_min, {enabled} enabled, timestamp_ntz'2024-01-{day:02}' valid_from""")
        row.coalesce(1).write.mode("append").parquet(rules)

    def arrive(*rows):
        values = ", ".join(f"('a', timestamp_ntz'2024-01-{day:02}', {i}L, 'topic', 't', {num}D, '{num}')" for i, day, num in rows)
        spark.sql(f"select * from values {values} as r(robot_id, ts, event_id, source, key, num, raw)").coalesce(1).write.mode("append").parquet(inbox)

    found = R.alert_revisions(root)
    run = lambda: R.run_revisions(J.read_stream(spark, inbox, spark.read.parquet(inbox)), found, R.bound_by(lambda: spark.read.schema(columns).parquet(rules)))
    add(1, 10, True, 1)
    arrive((1, 2, 50.0))
    run()
    add(2, 20, True, 3)  # while the stream rests between two files
    add(1, 10, False, 5)
    arrive((2, 4, 60.0), (3, 6, 70.0))
    run()
    got = sorted((r.rule_id, r.started_at.day, r.resolved_at and r.resolved_at.day) for r in R.alerts_at(found, spark, AS_OF).collect())
    assert got == [(1, 2, 6), (2, 4, None)]


def test_streams_start_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from fleetlens.session import build_session
from fleetlens.sources import sinks as K
from fleetlens.streaming import jobs as J
spark = build_session("local[2]", 2)
kind = "robot_id string, topic string, event_id long, ts timestamp_ntz, num double, payload string"
path = K.scratch_path(spark, "rows")
spark.sql("select 'a' robot_id, 't' topic, 1L event_id, timestamp_ntz'2024-01-01' ts, 1.0D num, '1' payload").write.parquet(path)
rows = J.read_stream(spark, path, spark.createDataFrame([], kind))
print("rows", spark.read.parquet(J.run_once(J.relay_stream(rows), "relay")).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-3000:]
