"""Decision rules on small tables: presence, redelivery, skew, clamping, rights, parsing."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as C
from fleetlens.functions import secrets as X
from fleetlens.functions import topics as TP
from fleetlens.operators import alerts as A
from fleetlens.operators import history as H
from fleetlens.operators import presence as P
from fleetlens.operators import quality as Q
from fleetlens.sources import messages as M

NOW = 1_705_000_000


def signals_at(spark, data, links):
    """data: (robot, seconds ago); links: (robot, seconds ago, text)."""
    d = spark.createDataFrame([(r, (NOW - s) * 1_000_000, i) for i, (r, s) in enumerate(data)] or [("x", 0, 0)],
                              "robot_id string, ts_us long, event_id long").filter("ts_us > 0")
    k = spark.createDataFrame([(r, (NOW - s) * 1_000_000, i, t) for i, (r, s, t) in enumerate(links)] or [("x", 0, 0, "")],
                              "robot_id string, ts_us long, event_id long, payload string").filter("ts_us > 0")
    return d, k


def as_of(spark):
    return spark.sql(f"select cast(timestamp_seconds({NOW}) as string)").first()[0]


@pytest.mark.parametrize("data,links,want", [
    ([("r", 0)], [], "ok"),
    ([("r", 5)], [], "ok"),
    ([("r", 10)], [], "stale"),
    ([("r", 100)], [], "offline"),
    ([], [("r", 1, "online")], "unknown"),
    ([("r", 2)], [("r", 1, "offline")], "offline"),
    ([("r", 1)], [("r", 2, "offline")], "ok"),
    ([("r", 1)], [("r", 1, "offline")], "offline"),
    ([("r", 12)], [("r", 11, "online")], "stale"),
    ([("r", 3)], [("r", 2, "offline"), ("r", 1, '"UP"')], "ok"),
])
def test_presence(spark, data, links, want):
    d, k = signals_at(spark, data, links)
    assert P.presence(d, k, as_of(spark), None, 5, 30).first()["presence"] == want
    last = P.presence_timeline(d, k, as_of(spark), 5, 30).filter("current").first()
    # the timeline closes at as_of, where nothing can change any more
    assert (last["presence"] if last else None) == want or any(s == 0 for _, s in data)


def messages(spark, rows):
    return spark.createDataFrame([(t, json.dumps(b) if not isinstance(b, str) else b, NOW + s) for t, b, s in rows],
                                 "topic string, payload string, at long").select(
        "topic", "payload", F.timestamp_seconds("at").cast("timestamp_ntz").alias("recv_ts"))


def batches(spark, rows):
    return M.parse_batches(M.route_messages(messages(spark, rows)))


def body(boot, seq, items, ts=None):
    out = {"v": 1, "boot": boot, "seq": seq, "b": items}
    return out if ts is None else {**out, "ts": ts}


def test_redelivery(spark):
    one = [["t/a", 1.0, 5, 0]]
    df = batches(spark, [
        ("fleet/r1/samples", body("aaa", 1, one), 0), ("fleet/r1/raw", body("aaa", 1, one), 1),
        ("fleet/r1/samples", body("aaa", 2, one), 2), ("fleet/r1/samples", body("bbb", 1, one), 3),
        ("fleet/r2/samples", body("aaa", 1, one), 4), ("fleet/r9/raw", {"b": [["t/x", 1.0, 1]]}, 5),
        ("fleet/r9/raw", {"b": [["t/x", 1.0, 1]]}, 5)])
    kept = Q.dedup_batches(df)
    assert kept.count() == 6
    assert kept.filter("robot_id = 'r1' and boot = 'aaa' and seq = 1").first()["topic"] == "fleet/r1/samples"
    counts = {r.robot_id: r for r in Q.duplicate_counts(df).collect()}
    assert counts["r1"].duplicate_batches == 1 and counts["r1"].duplicate_samples == 1
    assert counts["r1"].conflicting_duplicates == 0


def test_skew_is_measured_per_batch(spark):
    df = Q.measure_skew(batches(spark, [
        ("fleet/c1/samples", body("b", 1, [["t", NOW, 1, 0]], NOW), 0),
        ("fleet/c2/samples", body("b", 1, [["t", NOW + 300, 1, 0]], NOW + 300), 0),
        ("fleet/c3/samples", body("b", 1, [["t", NOW - 7200, 1, 0]], NOW), 0),
        ("fleet/c4/samples", {"b": [["t", NOW, 1]]}, 0),
        ("fleet/c5/samples", body("b", 1, [["t", NOW, 1, 0]], "soon"), 0)]))
    got = {r.robot_id: r.skew_ms for r in df.collect()}
    assert got == {"c1": 0, "c2": 300_000, "c3": 0, "c4": None, "c5": None}


def corrected(spark, robot, raw_s, sent_s):
    df = batches(spark, [(f"fleet/{robot}/samples", body("b", 1, [["t/a", raw_s, 1, 0]], sent_s), 0)])
    return Q.correct_timestamps(M.explode_samples(Q.measure_skew(df))).select("clamped", "skew_ms", C.micros("ts").alias("us")).first()


@pytest.mark.parametrize("raw,sent,want,clamped", [
    (NOW, NOW + 0.3, NOW, False), (NOW + 300, NOW + 300, NOW, False), (NOW + 315_360_000, None, NOW, True),
    (NOW - 3600, NOW + 0.1, NOW - 3600, False), (NOW - 30 * 86400, None, NOW, True), (0, None, NOW, False),
    (NOW + 299, None, NOW + 299, False), (NOW + 301, None, NOW, True)])
def test_correction_and_clamp(spark, raw, sent, want, clamped):
    row = corrected(spark, "r", raw, sent)
    assert (row.us, row.clamped) == (want * 1_000_000, clamped)


def test_one_clock_event_per_robot(spark):
    df = Q.measure_skew(batches(spark, [("fleet/n/samples", body("b", i, [["t", NOW, 1, 0]], NOW + 100 + i), i) for i in range(5)]))
    assert [(r.robot_id, r.skew_s, r.severity) for r in Q.clock_events(df).collect()] == [("n", 100.0, "warn")]


def test_odd_bodies(spark):
    df = batches(spark, [("fleet/a/samples", "{", 0), ("fleet/b/samples", {"x": 1}, 0), ("fleet/c/samples", "[]", 0),
                         ("fleet/d/samples", [["t", None, "on", "x"], 7, ["", 1, 2], ["t"], ["u", "5", {"k": 1}]], 0),
                         ("fleet/short", "{}", 0), ("fleet/e/cmd", "{}", 0)])
    assert {r.robot_id: r["items"] is None for r in df.collect()} == {"a": True, "b": True, "c": False, "d": False}
    rows = M.explode_items(df).select("robot_id", "dropped", "sample_topic", "num", "flag", "raw_us", "value").collect()
    assert sorted(r.dropped for r in rows) == [False, False, True, True, True]
    good = {r.sample_topic: r for r in rows if not r.dropped}
    assert (good["t"].num, good["t"].flag, good["t"].raw_us) == (1.0, 0, NOW * 1_000_000)
    assert (good["u"].num, good["u"].raw_us, good["u"].value) == (None, 5_000_000, '{"k":1}')


def test_status_aliases(spark):
    df = M.parse_status(M.route_messages(messages(spark, [
        ("fleet/a/status", {"batt": "150", "status": "idle", "theta": 1, "error": "E1", "mission": {"name": "m", "progress": 0.5}}, 0),
        ("fleet/b/status", {"id": "bb", "battery": None, "batt": 5, "errors": [], "extra1": {"k": 1}, "temp": True}, 0),
        ("fleet/c/status", "[1]", 0)])))
    a, b, c = df.orderBy("recv_ts", "topic").collect()
    assert (a.battery, a.state, a.yaw, a.errors, a.mission, a.progress) == (100.0, "idle", 1.0, ["E1"], "m", 0.5)
    assert (b.robot_id, b.battery, b.errors, b.extra, b.temp) == ("bb", None, [], {"extra1": '{"k":1}'}, 1.0)
    assert c.dropped


@pytest.mark.parametrize("user,topic,action,want", [
    ("carA", "fleet/carA/samples", "publish", True), ("carA", "fleet/carA/raw", "publish", True),
    ("carA", "fleet/carA/status", "publish", True), ("carA", "fleet/carB/status", "publish", False),
    ("carA", "fleet/carA/cmd", "subscribe", False), ("carA", "fleet/carA/samples", "subscribe", False),
    ("carA", "fleet/+/status", "subscribe", False), ("carA", "#", "subscribe", False),
    ("", "fleet/carA/status", "publish", False), ("carA", "fleet/carA/status/x", "publish", False)])
def test_publish_rights(spark, user, topic, action, want):
    df = spark.createDataFrame([(user, topic, action)], "u string, t string, a string")
    assert df.select(TP.publish_allowed("u", "t", "a")).first()[0] is want


# filter: the topics of TOPICS that it covers by the MQTT rules, without and with the guard for topics that start with $
TOPICS = ["a", "a/b", "a/b/c", "$SYS/x", "$SYS", "a/", "/a", "", "a.b/c", "b/a"]
COVERED = {
    "#": (set(TOPICS), {"$SYS/x", "$SYS"}), "+": ({"a", "$SYS", ""}, {"$SYS"}), "a/#": ({"a", "a/", "a/b", "a/b/c"}, set()),
    "a/+": ({"a/b", "a/"}, set()), "+/b": ({"a/b"}, set()), "a/#/b": (set(), set()), "$SYS/#": ({"$SYS", "$SYS/x"}, set()),
    "+/x": ({"$SYS/x"}, {"$SYS/x"}), "a/b/c": ({"a/b/c"}, set()), "+/+": ({"a/b", "$SYS/x", "a/", "/a", "a.b/c", "b/a"}, {"$SYS/x"}),
    "/+": ({"/a"}, set()), "a.b/c": ({"a.b/c"}, set()), "#/a": (set(), set()),
}


def test_topic_filters(spark):
    df = spark.createDataFrame([(t,) for t in TOPICS], "t string")
    for f, (covered, guarded) in COVERED.items():
        for guard in (True, False):
            got = {r.t for r in df.filter(TP.topic_matches("t", f, guard)).collect()}
            assert got == (covered - guarded if guard else covered), (f, guard)


@pytest.mark.parametrize("raw,want", [
    ("true", 1.0), (" ON ", 1.0), ("F", 0.0), ("no", 0.0), ("", None), ("  ", None), ("nan", None), ("inf", None),
    ("1e400", None), ("1d", None), ("1f", None), ("1_0", None), (" 5 ", 5.0), (".5", 0.5), ("5.", 5.0), ("0x10", None),
    ("+7", 7.0), ("1" * 33, None), ("\t3\n", 3.0)])
def test_to_numeric(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(C.to_numeric("x")).first()[0] == want


def test_times_and_buckets(spark):
    df = spark.createDataFrame([("1700000000.5",), ("2024-01-05T06:07:08Z",), ("2024-01-05",), ("x",)], "x string")
    got = [None if r[0] is None else str(r[0]) for r in df.select(C.parse_time("x")).collect()]
    assert got == ["2023-11-14 22:13:20.500000", "2024-01-05 06:07:08", "2024-01-05 00:00:00", None]
    assert H.auto_bucket(0, 3600, 5000) is None and H.auto_bucket(0, 30 * 86400, 5000) == 518.4
    assert H.auto_bucket(0, 7 * 3600, 50_000) == 1.0


def test_flatten(spark):
    deep = {"v": 1}
    for _ in range(8):
        deep = {"n": deep}
    doc = {"a": [1, 2], "long": list(range(9)), "edge": list(range(8)), "n": None, "e": {}, "l": [], "s": "x", "deep": deep, "b": True}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, body string")
    got = {r.path: r.value for r in M.flatten_json(df, ["id"]).collect()}
    want = {"/a/0": "1", "/a/1": "2", "/long/len": "9", "/n": "null", "/s": '"x"', "/b": "true",
            **{f"/edge/{i}": str(i) for i in range(8)}}
    assert got == want


def test_messages_and_broken_templates(spark):
    df = spark.createDataFrame(
        [("{robot} {value} < {limit}", "lt"), ("{robot} {oops}", "lt"), ("  ", "inside"), (None, "eq")], "template string, op string")
    text = A.alert_message(F.lit("Amr"), F.lit("id"), F.lit("battery"), F.lit("12.5"), F.lit(20.0), F.lit(30.0), F.lit("low"),
                           F.lit("warn"), F.col("op"), F.lit("x"), F.col("template"))
    assert [r[0] for r in df.select(text).collect()] == [
        "Amr 12.5 < 20.0", "Amr battery=12.5 below 20.0", "Amr battery=12.5 inside 20.0~30.0", "Amr battery=12.5 (eq x)"]


def test_secrets_keep_line_numbers(spark):
    text = "one\nmail a.b@x.org and 100.64.1.2\n\nkey ABCD-2345-WXYZ, XXXX-XXXX-XXXX\nprivate_key\n := é@f.de"
    got = {(r.label, r.hit, r.line) for r in X.secret_scan(spark.createDataFrame([(1, text)], "id int, text string"), "id").collect()}
    assert got == {("email", "a.b@x.org", 2), ("tailnet ip", "100.64.1.2", 2), ("enroll token", "ABCD-2345-WXYZ", 4),
                   ("private key", "private_key\n :", 5), ("email", "é@f.de", 6)}
