"""What the review of round 3 found."""

import random
import re

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from fleetlens.operators import alerts as A
from fleetlens.operators import storage as ST
from fleetlens.sources import sinks as K
from fleetlens.streaming import jobs as J
from fleetlens.streaming.processors import DATA, LINK_DOWN, LINK_UNKNOWN, LINK_UP, AlertProcessor, FirstDelivery, PresenceProcessor


def test_a_stream_over_an_archive_takes_many_small_files_at_once(spark):
    path = K.scratch_path(spark, "many-files")
    spark.range(40, numPartitions=40).write.parquet(path)
    sizes = []
    (J.read_archive(spark, path).writeStream.foreachBatch(lambda rows, _: sizes.append(rows.count()))
     .option("checkpointLocation", K.scratch_path(spark, "many-files-checkpoint")).trigger(availableNow=True).start().awaitTermination())
    assert sizes == [40]


def test_rules_are_described_with_their_alerts(spark, tables):
    from fleetlens.plans.suite import Tables

    t = Tables(spark, SMALL)
    got = {r.rule_id: r.alerts for r in entry.queries()["describe_rule"](spark, SMALL).collect()}
    logged = {r.k: r["count"] for r in t.view("fx_alerts").groupBy((F.col("rule_id") % 8).alias("k")).count().collect()}
    assert got and got == {i: logged.get(i % 8, 0) for i in got}


def frames(rows, window_us):
    """Trailing rates, every frame summed anew."""
    total = {}
    for at, size in rows:
        total[at] = total.get(at, 0) + size
    out = {}
    for at in total:
        inside = [x for x in total if at - window_us <= x <= at]
        out[at] = (total[at], sum(total[x] for x in inside) / max((at - min(inside)) / 1e6, 1.0))
    return out


def test_trailing_rates_are_running_sums(spark):
    rng = random.Random(3)
    rows = [(10**15 + rng.choice([0, 1, 59, 60, 61, 120, 121, 300, 4000]) * 10**6 + rng.randrange(3), rng.randrange(1000)) for _ in range(400)]
    rows += [(10**15 + i * 250_000, 10) for i in range(600)]
    sent = spark.createDataFrame(rows, "at long, body_bytes long").select(F.timestamp_micros("at").alias("ts"), F.lit("ws").alias("kind"), "body_bytes")
    for target in (ST.RATE_ROWS, 50):  # in one piece, in slices
        df = ST.egress_rate(sent, 60.0, target)
        got = {r.at_us: (r.bytes, r.rate_bps) for r in df.collect()}
        assert got == frames(rows, 60_000_000)
        assert "RangeFrame" not in df._jdf.queryExecution().toString().replace("specifiedwindowframe(RangeFrame, unboundedpreceding", "")


HITS = ("rule_id int, robot_id string, ts timestamp_ntz, event_id long, num double, raw string, op string, limit double, clear_value double, "
        "hit boolean, hold boolean, for_seconds double, cooldown_min double")


def sorts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bSort \[", plan))


def test_alert_scans_sort_once(spark):
    rows = spark.createDataFrame([], HITS)
    strict = sorts(A._strict_intervals(rows, None))
    assert sorts(A.alert_intervals(rows)) == strict + 1
    assert sorts(A.alert_intervals_by_time(rows, None)) == strict + 1


def test_tasks_of_the_fleet_queries_read_little(spark, tables):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_sampling_keeps_texts_out_of_python(spark):
    got = entry.queries()["relay_sample"](spark, SMALL)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert made and "payload" not in made[0]


class Clock:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


class CountedMap:
    """Map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_deliveries_are_remembered_by_blocks():
    state, keep = CountedMap(), FirstDelivery(["boot", "seq", "recv_us", "topic"], 1000)
    keep.init(state)
    rows = lambda seqs, at: [Row(boot="b", seq=s, recv_us=at + s, topic="t") for s in seqs]
    told = lambda seqs, ms: [r.seq for r in keep.handleInputRows(("r",), rows(seqs, ms), Clock(ms))]
    assert told([*range(200), 7], 5) == list(range(200)) and state.calls == 2
    assert told([3, 700, 150], 900) == [700]  # a later micro-batch
    assert told([3, 700], 1005) == [3]  # 3 is forgotten, 700 is not
    free = [Row(boot=None, seq=None, recv_us=1, topic="t")] * 2
    assert len(list(keep.handleInputRows(("r",), free, Clock(0)))) == 2


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_parsed_once(spark):
    from fleetlens.operators import quality as Q
    from fleetlens.sources import messages as M

    raw = spark.range(5).selectExpr("concat('fleet/r/', id) as topic", "cast(null as timestamp_ntz) as recv_ts", "concat('{}', id) as payload")
    headers = M.batch_headers(M.route_messages(raw)).filter("boot is not null and seq is not null")
    assert optimized(headers).count("parseJson") == 1
    items = Q.correct_timestamps(M.explode_samples(M.batch_items(Q.measure_skew(headers))))
    assert optimized(items).count("parseJson") == 2  # headers, then what they have kept


def test_topics_are_split_once(spark, tables):
    from fleetlens.plans import ingest

    assert optimized(ingest.lane(tables, "status")).count("split(") == 1


def test_watched_extra_keys_are_looked_up_alone(spark, tables):
    from fleetlens.sources import messages as M

    bodies = ['{"gripper":"open","x":1,"other":2}', '{"gripper":null}', '{"gripper":{"a":[1]},"it\'s":3}', '{"battery":3}', '{}', "[1]", "no"]
    rows = M.route_messages(spark.createDataFrame([("fleet/r/status", b) for b in bodies], "topic string, payload string"))
    for only in (["gripper"], ["gripper", "other", "battery"], ["it's"], []):
        got = M.parse_status(rows, extra_keys=only).select("payload", "extra").collect()
        said = lambda e: None if e is None else {k: v for k, v in e.items() if k in only}
        want = {r.payload: said(r.extra) for r in M.parse_status(rows).select("payload", "extra").collect()}
        assert {r.payload: said(r.extra) for r in got} == want
    assert "cast" not in optimized(M.parse_status(rows, extra_keys=["gripper"]).select("extra")).lower()


def test_ages_are_found_once_for_all_rules(spark, tables):
    r = A.load_rules(tables.view("fx_rules"))
    plan = optimized(A.age_rows(tables.view("fx_status"), r))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and "rule_id" not in windows[0]


class CountedValue:
    """Value state that counts its calls."""

    def __init__(self):
        self.held, self.calls = None, 0

    def getValueState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


def test_alerts_of_many_robots_are_one_record_of_state():
    rng = random.Random(13)
    state, alerts = CountedValue(), AlertProcessor()
    alerts.init(state)
    names = ["rule_id", "robot_id", "event_id", "at_us", "num", "hit", "hold", "for_seconds", "cool_us"]
    got, want, now = [], [], {}
    for part in range(3):
        rows = []
        for i in range(600):
            hit = rng.random() < 0.6
            rows.append((rng.randrange(4), f"r{rng.randrange(20)}", i, (part * 300 + rng.randrange(300)) * 10**6, rng.choice([None, "1.5", "NaN"]),
                         hit, hit or rng.random() < 0.3, 5.0, 20 * 10**6))
        for rule, robot, _, at, num, *row in sorted(rows, key=lambda r: (r[3], r[2])):
            now[rule, robot], (mark,) = A.alert_step(now.get((rule, robot)), (at, *row))
            if mark:
                want.append((rule, robot, at, num, mark))
        state.calls = 0
        halves = iter([pd.DataFrame(rows[:250], columns=names), pd.DataFrame(rows[250:], columns=names)])
        for out in alerts.handleInputRows((7,), halves, None):
            got += [tuple(None if v is None or v != v else v for v in r) for r in out.itertuples(index=False)]
        assert state.calls <= 3
    assert got == want and {m for *_, m in got} == {"start", "stop", "repeat"}


OFF_US, STALE_US = 20_000_000, 90_000_000


class Follower:
    """Presence of one robot, signal by signal."""

    def __init__(self):
        self.at = self.seen = self.up = self.link = self.told = None

    def look(self, at):
        self.at = at
        if self.up is False and self.link >= (self.seen or 0):
            now = "offline"
        elif self.seen is None:
            now = "unknown"
        else:
            now = "ok" if at - self.seen <= OFF_US else "stale" if at - self.seen <= STALE_US else "offline"
        before, self.told = self.told, now
        return [(at, now, before)] if now != before else []

    def wait(self, end):
        cuts = [] if self.seen is None else [c for c in (self.seen + OFF_US + 1, self.seen + STALE_US + 1) if self.at < c < end]
        return [row for c in cuts for row in self.look(c)]

    def take(self, at, kind):
        rows = self.wait(at)
        if kind == DATA:
            self.seen = at
        elif kind != LINK_UNKNOWN:
            self.up, self.link = kind == LINK_UP, at
        return rows + self.look(at)


class CountedTimers(CountedValue):
    def __init__(self):
        super().__init__()
        self.timers = set()

    def listTimers(self):
        self.calls += 1
        return sorted(self.timers)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Marks:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_presence_of_many_robots_is_one_record_of_state():
    rng = random.Random(19)
    state, presence = CountedTimers(), PresenceProcessor(OFF_US / 1e6, STALE_US / 1e6)
    presence.init(state)
    robots, got, want = {}, [], []
    told = lambda out: [tuple(None if v != v else v for v in r) for f in out for r in f.itertuples(index=False)]
    for part in range(6):
        rows = []
        for i in range(900):
            at = (part * 600 + rng.randrange(0, 900, 10)) * 10**6 + rng.choice([0, 1, 2])  # later parts hold earlier rows, too
            rows.append((rng.choice([None, *(f"r{k}" for k in range(10 + 10 * part))]), at, rng.choice([DATA] * 4 + [LINK_DOWN, LINK_UP, LINK_UNKNOWN]), i))
        for robot, at, kind, _ in sorted(rows, key=lambda r: (r[1], r[2] > DATA, r[3])):
            f = robots.setdefault(robot, Follower())
            want += [(robot, *r) for r in f.take(at, kind)]
        frame = pd.DataFrame(rows, columns=["robot_id", "at_us", "kind", "event_id"])
        state.calls = 0
        got += told(presence.handleInputRows((7,), iter([frame[:250], frame[250:]]), None))
        assert state.calls <= 6
        mark = (part * 600 + 650) * 1000
        state.calls = 0
        for t in [t for t in state.listTimers() if t <= mark]:
            got += told(presence.handleExpiredTimer((7,), Marks(mark), Marks(t)))
        assert state.calls <= 7 and all(t > mark for t in state.timers)
        want += [(robot, *r) for robot, f in robots.items() for r in f.wait(mark * 1000 + 1)]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want) and {p for _, _, p, _ in got} == {"unknown", "ok", "stale", "offline"}


def test_presence_takes_odd_times(spark):
    far = 253_402_300_799_000_000
    schema = "robot_id string, ts_us long, event_id long"
    made = {"data": spark.createDataFrame([("a", 10**15, 1), ("a", None, 2), ("b", far, None)], schema),
            "lwt": spark.createDataFrame([("a", 10**15 + 1, 3, None)], schema + ", payload string")}
    feeds = []
    for name, rows in made.items():
        path = K.scratch_path(spark, f"odd-{name}")
        rows.coalesce(1).write.parquet(path)
        feeds.append(J.read_stream(spark, path, rows))
    got = spark.read.parquet(J.run_once(J.presence_stream(*feeds, 6, 60, disorder="0 seconds"), "odd"))
    assert sorted(map(tuple, got.select("robot_id", "at_us", "presence").collect())) == [
        ("a", 10**15, "ok"), ("a", 10**15 + 6_000_001, "stale"), ("a", 10**15 + 60_000_001, "offline"), ("b", far, "ok")]
