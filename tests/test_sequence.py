"""Cutting a busy key into slices must not change any result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros
from fleetlens.operators import alerts as A
from fleetlens.operators import fleet as FL
from fleetlens.operators import history as H
from fleetlens.operators import presence as P
from fleetlens.operators import relay as R
from fleetlens.operators import state as S
from fleetlens.operators import storage as ST
from fleetlens.operators.sequence import lag, last_known, lead, next_known, plan_slices, running, scan

ORDER = ["ts", "event_id"]


def rows(df):
    cols = sorted(c for c in df.columns if not c.startswith("_"))
    return sorted(df.select(*cols).collect(), key=repr)


def one_hot(df, column, name="amr-000001"):
    """A third of all rows on one key."""
    return df.withColumn(column, F.when(F.col("event_id") % 3 == 0, name).otherwise(F.col(column)))


def test_every_step_equals_the_plain_window(tables):
    df = one_hot(tables.view("fx_status"), "robot_id")
    slices = plan_slices(df, "robot_id", micros("ts"), target_rows=100)
    assert slices is not None and slices.hot.count() >= 1
    steps = {
        "a": lag("battery"), "b": lead("battery"), "c": last_known("battery"), "d": next_known("battery"),
        "e": running(F.when(F.col("state") == "idle", 1)), "f": lag("state"), "g": next_known(F.when(F.col("errors") != "", F.col("ts"))),
    }
    plain = scan(df, "robot_id", ORDER, steps)
    cut = scan(df, "robot_id", ORDER, steps, micros("ts"), slices)
    assert cut.select("_slice").distinct().count() > 10
    assert rows(plain) == rows(cut)


def test_no_hot_key_means_no_slices(tables):
    assert plan_slices(tables.view("fx_status"), "robot_id", micros("ts")) is None


def test_operators_agree_when_cut(tables):
    status = one_hot(tables.view("fx_status"), "robot_id")
    lwt = one_hot(tables.view("fx_lwt"), "robot_id")
    samples = one_hot(tables.view("fx_samples"), "robot_id")
    cut = plan_slices(status, "robot_id", micros("ts"), target_rows=150)
    fields = ["battery", "state", "v", "w", "temp", "wifi", "odom", "errors"]
    for run in (
        lambda s: S.locf_state(status, fields, slices=s),
        lambda s: S.state_transitions(status, slices=s),
        lambda s: S.error_transitions(status, slices=s),
        lambda s: S.change_only(samples, ["robot_id", "topic"], "payload", slices=s),
        lambda s: H.sample_gaps(samples, ["robot_id", "topic"], slices=s),
        lambda s: FL.battery_sparkline(status, slices=s),
        lambda s: R.topic_profile(samples, ["robot_id", "topic"], slices=s),
        lambda s: P.presence_timeline(status, lwt, "2024-01-31 00:00:00", 6 * 3600, 60 * 3600, slices=s),
        lambda s: P.presence_timeline(status, lwt, "2024-01-31 00:00:00", 600, 3600, slices=s),
    ):
        assert rows(run(None)) == rows(run(cut))


def test_login_limit_and_medians_when_cut(tables):
    logins = tables.view("fx_logins").withColumn("client", F.when(F.col("event_id") % 3 == 0, "10.0.0.1").otherwise(F.col("client")))
    cut = plan_slices(logins, "client", micros("ts"), target_rows=200)
    a = FL.login_rate_limit(logins, 86400.0, 5)
    assert rows(a) == rows(FL.login_rate_limit(logins, 86400.0, 5, slices=cut))
    moves = tables.view("fx_transfers")
    rates = moves.select("size_bytes", (F.col("bytes") / F.col("seconds")).alias("r"))
    cut = plan_slices(rates, "size_bytes", F.col("r"), target_rows=100)
    assert cut is not None and rows(ST.transfer_rates(moves)) == rows(ST.transfer_rates(moves, slices=cut))


def test_size_retention_when_cut(tables):
    files = tables.view("fx_files").withColumn("folder", F.lit("x"))
    cut = plan_slices(files, "folder", F.col("seq"), target_rows=50)
    assert rows(ST.size_retention(files, 500_000, ["folder"])) == rows(ST.size_retention(files, 500_000, ["folder"], cut))


# ------------------------------------------------------------------ order-dependent operators

def greedy(seq, gap, beat, band):
    """Sampling, one row after the other."""
    sent, out = None, []
    for at, num, text in seq:
        if sent is not None and at - sent[0] < gap:
            out.append("rate")
            continue
        if sent is not None:
            same = abs(num - sent[1]) <= band if num is not None and sent[1] is not None else text == sent[2]
            if same and (beat == 0 or at - sent[0] < beat):
                out.append("same")
                continue
            out.append("heartbeat" if same else "change")
        else:
            out.append("change")
        sent = (at, num, text)
    return out


def series(spark, seed, keys=4, n=250):
    rng = random.Random(seed)
    data, event = [], 0
    for k in range(keys):
        at = 1_700_000_000_000_000 + rng.randrange(10**6)
        for _ in range(n if k else 3 * n):
            at += rng.choice([100_000, 300_000, 1_000_000, 20_000_000])
            num = rng.choice([None, 1.0, 1.5, 2.0, 9.0])
            data.append((event, f"r{k}", "t", at, num, rng.choice("ab")))
            event += 1
    df = spark.createDataFrame(data, "event_id long, robot_id string, topic string, at long, num double, payload string")
    return data, df.withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz")).repartition(5)


def test_sampling_equals_sequential(spark):
    for seed, beat in ((1, 5.0), (2, 0.0), (3, 60.0)):
        data, df = series(spark, seed)
        want = {}
        for key in {d[1] for d in data}:
            mine = [d for d in data if d[1] == key]
            for d, decision in zip(mine, greedy([(d[3], d[4], d[5]) for d in mine], 500_000, int(beat * 1e6), 0.5)):
                want[d[0]] = decision
        cut = plan_slices(df, ["robot_id", "topic"], micros("ts"), target_rows=60)
        assert cut is not None
        for s in (None, cut):
            got = R.relay_decisions(df, ["robot_id", "topic"], "num", "payload", min_gap_s=0.5, heartbeat_s=beat, deadband=0.5, slices=s)
            assert {r.event_id: r.decision for r in got.select("event_id", "decision").collect()} == want


def test_throttle_equals_sequential(spark):
    data, df = series(spark, 7)
    want = set()
    for key in {d[1] for d in data}:
        mine = [d for d in data if d[1] == key]
        want |= {d[0] for d, x in zip(mine, greedy([(d[3], i, "") for i, d in enumerate(mine)], 1_500_000, 0, -1)) if x != "rate"}
    cut = plan_slices(df, ["robot_id"], micros("ts"), target_rows=60)
    for s in (None, cut):
        assert {r.event_id for r in R.throttle(df, ["robot_id", "topic"], 1.5, slices=s).collect()} == want


def test_jobs_do_not_grow_with_slices_on_periodic_data(spark):
    """Every row a second apart: chains from different rows never meet, the worst case for guessed entry states."""
    df = spark.range(4000).selectExpr("'r' as robot_id", "'t' as topic", "id as event_id", "cast(timestamp_seconds(1700000000 + id) as timestamp_ntz) as ts",
                                      "cast(id % 7 as double) as num", "cast(id % 7 as string) as payload").repartition(4)
    limits = {"min_gap_s": 3.0, "heartbeat_s": 11.0, "deadband": 1.5}
    want = {r.event_id: r.decision for r in R.relay_decisions(df, ["robot_id", "topic"], "num", "payload", **limits).collect()}
    jobs, context = [], spark.sparkContext
    for rows_in_slice in (500, 100):
        cut = plan_slices(df, ["robot_id", "topic"], micros("ts"), target_rows=rows_in_slice)
        context.setJobGroup(f"slices of {rows_in_slice}", "")
        got = R.relay_decisions(df, ["robot_id", "topic"], "num", "payload", slices=cut, **limits).collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"slices of {rows_in_slice}")))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert {r.event_id: r.decision for r in got} == want
    assert jobs[1] <= jobs[0] + 2 and jobs[0] < 40


def machine(rows_, for_s, cool_s):
    """Alert states, one row after the other -> (start, stop) pairs and reminder times."""
    pending, firing, sent, pairs, reminders = None, False, None, [], []
    for at, hit, hold in rows_:
        if firing:
            if not hold:
                firing, pending = False, None
                pairs[-1][1] = at
            elif cool_s > 0 and at - sent >= cool_s * 1e6:
                sent = at
                reminders.append(at)
        elif hit:
            if pending is None:
                pending = at
            elif at - pending >= for_s * 1e6:
                firing, sent, pending = True, at, None
                pairs.append([at, None])
        else:
            pending = None
    return pairs, reminders


def test_alerts_equal_sequential(spark):
    rng = random.Random(5)
    data, event = [], 0
    rules_ = {1: ("lt", 20.0, 30.0, 3.0), 2: ("lt", 30.0, 20.0, 2.0), 3: ("gt", 25.0, None, 0.0)}
    for rule, (op, limit, clear, for_s) in rules_.items():
        for robot in range(8):
            at = 1_700_000_000_000_000
            for _ in range(400 if robot == 0 else 60):
                at += rng.choice([500_000, 1_000_000, 2_000_000])
                num = rng.choice([None, 10.0, 18.0, 22.0, 28.0, 35.0]) if rng.random() < 0.7 else 15.0
                data.append((rule, f"r{robot}", event, at, num, op, limit, clear, for_s))
                event += 1
    df = spark.createDataFrame(data, "rule_id int, robot_id string, event_id long, at long, num double, op string, limit double,"
                                     " clear_value double, for_seconds double")
    df = df.selectExpr("*", "cast(timestamp_micros(at) as timestamp_ntz) ts", "cast(num as string) raw",
                       "cast(null as double) limit2", "cast(null as string) text_value", "cast(0.1 as double) cooldown_min")
    hits = A.with_hits(df).repartition(4)
    want, want_again = set(), set()
    for rule, (op, limit, clear, for_s) in rules_.items():
        for robot in range(8):
            def over(x, level):
                return x is not None and (x < level if op == "lt" else x > level)
            mine = [(d[3], over(d[4], limit), over(d[4], clear if clear is not None else limit))
                    for d in data if d[0] == rule and d[1] == f"r{robot}"]
            pairs, again = machine(mine, for_s, 6.0)
            want |= {(rule, f"r{robot}", a, b) for a, b in pairs}
            want_again |= {(rule, f"r{robot}", a) for a in again}
    cut = plan_slices(hits, ["rule_id", "robot_id"], micros("ts"), target_rows=80)
    assert cut is not None and len(want) > 50 and want_again
    for s in (None, cut):
        got = A.alert_intervals(hits, s).select("rule_id", "robot_id", micros("started_at"), micros("resolved_at")).collect()
        assert {tuple(r) for r in got} == want
        got = A.reminders(hits, s).select("rule_id", "robot_id", micros("ts")).collect()
        assert {tuple(r) for r in got} == want_again


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_by_time_equal_a_ticking_clock(spark, seed):
    rng = random.Random(seed)
    base, end = dt.datetime(2024, 1, 1), 400
    events, want = [], set()
    for robot in ("a", "b", "c", "d"):
        for_s, at = rng.choice([0, 7, 30]), 0
        mine = []
        while at < end - 1:
            at += rng.choice([1, 1, 3, 20, 60])
            hit = rng.random() < 0.5
            mine.append((at, hit, hit or rng.random() < 0.4))
        mine = [m for m in mine if m[0] < end]
        events += [(1, robot, i, base + dt.timedelta(seconds=t), float(i), str(i), h, k, float(for_s)) for i, (t, h, k) in enumerate(mine)]
        pending, firing, started, value = None, False, None, None
        for tick in range(end):
            row = [(i, m) for i, m in enumerate(mine) if m[0] <= tick][-1:]
            if not row:
                continue
            i, (t, hit, hold) = row[0]
            if firing and not hold:
                want.add((robot, started, t, value))
                firing = False
            pending = (pending if pending is not None else t) if hit else None
            if not firing and pending is not None and tick - pending >= for_s:
                firing, started, value = True, tick, float(i)
        if firing:
            want.add((robot, started, None, value))
    df = spark.createDataFrame(events, "rule_id int, robot_id string, event_id long, ts timestamp_ntz, num double, raw string, hit boolean, hold boolean, for_seconds double")
    df = df.withColumns({"op": F.lit("lt"), "limit": F.lit(1.0), "clear_value": F.lit(None).cast("double")})
    cut = plan_slices(df, ["rule_id", "robot_id"], micros("ts"), target_rows=15)
    for slices in (None, cut):
        got = A.alert_intervals_by_time(df, "2024-01-01 00:06:40", slices).collect()
        sec = lambda x: None if x is None else int((x - base).total_seconds())
        assert {(r.robot_id, sec(r.started_at), sec(r.resolved_at), r.value) for r in got} == want
