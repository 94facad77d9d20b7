"""Live fleet view, registry joins and access reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros, sha256_hex, strip
from fleetlens.operators.history import time_literal
from fleetlens.operators.presence import OFFLINE, OK, STALE, UNKNOWN
from fleetlens.operators.sequence import Slices, drop_slice, lag, running, scan
from fleetlens.operators.state import FAULT_STATES
from fleetlens.session import broadcast_if_small

# Thresholds of the dashboard.
MOVING_ABOVE = 0.02
BATTERY_LOW, BATTERY_CRITICAL = 30.0, 15.0
TRAIL_POINTS, SPARK_POINTS = 240, 60


def latest_state(telemetry: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Newest archived row per robot with the number of rows received."""
    fields = [c for c in telemetry.columns if c != "robot_id"]
    last = telemetry.groupBy("robot_id").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("l"),
                                             F.count(F.lit(1)).alias("rx_count"))
    return last.select("robot_id", "l.*", "rx_count")


def fleet_snapshot(latest: DataFrame, presence: DataFrame, as_of: str) -> DataFrame:
    """One display row per robot; the state reads as the presence unless the robot is ok."""
    joined = presence.join(latest.drop("ts"), "robot_id", "left")
    age = (micros(time_literal(as_of)) - micros("last_seen")) / F.lit(1e6)
    return joined.withColumns({
        "online": F.col("presence") == OK,
        "state": F.when(F.col("presence") == OK, F.col("state")).otherwise(F.col("presence")),
        "v": F.bround("v", 3), "w": F.bround("w", 3), "age_s": F.round(age, 2),
        "rx_count": F.coalesce("rx_count", F.lit(0)),
    })


def fleet_summary(latest: DataFrame, presence: DataFrame) -> DataFrame:
    """Fleet-wide counts in one pass; only robots that are ok count as active."""
    rows = presence.join(latest, "robot_id", "left")
    ok = F.col("presence") == OK
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("online"), F.count_if(F.col("presence") == STALE).alias("stale"),
        F.count_if(F.col("presence") == UNKNOWN).alias("unknown"), F.count_if(F.col("presence") == OFFLINE).alias("offline"),
        F.count_if(ok & ((F.abs("v") > MOVING_ABOVE) | (F.abs("w") > MOVING_ABOVE))).alias("moving"),
        F.count_if(ok & (F.col("state") == "charging")).alias("charging"),
        F.count_if(ok & ((F.col("errors") != "") | F.col("state").isin(FAULT_STATES))).alias("faulted"),
        F.round(F.avg(F.when(ok, F.col("battery"))), 1).alias("avg_battery"),
        F.round(F.min(F.when(ok, F.col("battery"))), 1).alias("min_battery"),
        F.coalesce(F.sum("rx_count"), F.lit(0)).alias("messages"))


def fleet_board(snapshot: DataFrame, show: str = "all", search: str = "") -> DataFrame:
    """Dashboard cards: filter, search, battery band; online first."""
    fault = (F.col("errors") != "") | F.col("state").isin(FAULT_STATES)
    wanted = {"all": F.lit(True), "online": F.col("online"), "offline": ~F.col("online"), "fault": fault,
              "low": F.col("battery") < BATTERY_LOW}[show]
    text = F.lower(F.concat_ws(" ", "robot_id", "name"))
    band = F.when(F.col("battery") < BATTERY_CRITICAL, "crit").when(F.col("battery") < BATTERY_LOW, "low").otherwise("")
    return (snapshot.filter(F.coalesce(wanted, F.lit(False)) & text.contains(search.strip().lower()))
            .withColumn("band", band).orderBy(F.col("online").desc(), "robot_id"))


def last_points(df: DataFrame, n: int = TRAIL_POINTS, order=("ts", "event_id")) -> DataFrame:
    """Newest ``n`` rows per robot. The rank limit also runs before the shuffle."""
    newest = Window.partitionBy("robot_id").orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= n)


def pose_trail(telemetry: DataFrame, n: int = TRAIL_POINTS, order=("ts", "event_id")) -> DataFrame:
    """Newest ``n`` points of every robot's way, as a map shows them."""
    shown = [F.bround(c, 3).alias(c) for c in ("x", "y", "v")] + [F.bround("battery", 1).alias("battery")]
    return last_points(telemetry.select("robot_id", *order, *shown), n, order)


def robot_detail(trail: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot row with the trail as an array of at most ``TRAIL_POINTS`` points."""
    points = trail.groupBy("robot_id").agg(F.array_sort(F.collect_list(F.struct("ts", "battery", "v"))).alias("trail"))
    return snapshot.join(points, "robot_id", "left")


def battery_sparkline(df: DataFrame, n: int = SPARK_POINTS, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Last ``n`` distinct battery readings per robot, and whether they fall."""
    known = df.filter("battery is not null")
    steps = {"_before": lag("battery")}
    changed = drop_slice(scan(known, "robot_id", list(order), steps, micros("ts"), slices)).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("battery")))
    last = last_points(changed, n, order)
    at = F.struct(*order)
    return last.groupBy("robot_id").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("battery", at).alias("first"), F.max_by("battery", at).alias("last"),
    ).withColumn("trend", F.when(F.col("points") < 3, "").when(F.col("last") < F.col("first"), "falling").otherwise("steady"))


def fleet_delta(latest: DataFrame, seen: DataFrame) -> DataFrame:
    """What a reader must be told: robots whose revision moved, and robots that left."""
    both = latest.select("robot_id", F.col("rx_count").alias("rev")).join(seen, "robot_id", "full")
    change = (F.when(F.col("rev").isNull(), "removed")
              .when(~F.col("rev").eqNullSafe(F.col("seen_rev")), "changed"))
    return both.withColumn("change", change).filter("change is not null")


def login_rate_limit(attempts: DataFrame, window_s: float, limit: int, order=("ts", "event_id"),
                      slices: Slices | None = None) -> DataFrame:
    """Failures of the same client in the trailing window, since its last success.

    Time is cut into windows of the trailing length; each row is copied into its own and
    the following one, so a task holds two windows of one client and never a whole client.
    Every attempt is replayed with its recorded verdict, limited or not.
    """
    us = micros("ts")
    w = int(window_s * 1e6)
    rows = drop_slice(scan(attempts, "client", list(order), {"_wins": running(F.col("ok").cast("long"))},
                           us, slices))
    # the epoch of an attempt: successes strictly before it
    rows = rows.withColumn("_epoch", F.col("_wins") - F.col("ok").cast("long")).withColumn("_us", us)
    own = F.floor(F.col("_us") / w)
    spread = rows.withColumn("_own", own).withColumn("_win", F.explode(F.array(own, own + 1)))
    trailing = Window.partitionBy("client", "_epoch", "_win").orderBy("_us").rangeBetween(-w + 1, 0)
    counted = spread.withColumn("_n", F.sum((~F.col("ok")).cast("long")).over(trailing)).filter("_win = _own")
    failures = F.col("_n") - (~F.col("ok")).cast("long")
    return counted.withColumns({"failures": failures, "limited": failures >= limit}).drop(
        "_wins", "_epoch", "_us", "_own", "_win", "_n")


# ------------------------------------------------------------------ registry

def robots_with_token(robots: DataFrame, tokens: DataFrame, as_of: str) -> DataFrame:
    """Each robot with its newest unused, unexpired token, if any."""
    usable = tokens.filter(F.col("used_at").isNull() & (F.col("expires_at") > time_literal(as_of)))
    newest = usable.groupBy("robot_id").agg(
        F.max_by(F.struct("token", "expires_at"), F.struct("created_at", "token")).alias("t"))
    joined = robots.join(newest.withColumnRenamed("robot_id", "id"), "id", "left")
    return joined.select("*", F.col("t.token").alias("pending_token"), F.col("t.expires_at").alias("token_expires")).drop("t")


def token_status(claims: DataFrame, tokens: DataFrame, as_of: str) -> DataFrame:
    """Verdict on presented tokens: unknown, used, expired or valid."""
    asked = claims.withColumn("token", F.upper(strip("token")))
    joined = asked.join(tokens.select("token", "used_at", "expires_at", F.lit(True).alias("_known")), "token", "left")
    return joined.withColumn("verdict", F.when(F.col("_known").isNull(), "unknown").when(F.col("used_at").isNotNull(), "used")
                             .when(F.col("expires_at") < time_literal(as_of), "expired").otherwise("valid"))


def credential_audit(connects: DataFrame, robots: DataFrame) -> DataFrame:
    """Would each connection be let in? Unknown, revoked and wrong secrets are refused."""
    known = robots.select(F.col("id").alias("username"), "revoked_at", "secret_hash", F.lit(True).alias("_known"))
    rows = connects.join(known, "username", "left")
    return rows.withColumn("verdict", F.when(F.col("_known").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked")
                           .when(F.col("secret_hash").isNull(), "no credential")
                           .when(sha256_hex("secret") == F.col("secret_hash"), "accepted").otherwise("wrong secret"))


def unknown_publishers(publishers: DataFrame, robots: DataFrame) -> DataFrame:
    """Ids that publish without a registry row, and registered ids that never publish."""
    seen = publishers.select("robot_id").distinct()
    known = robots.select(F.col("id").alias("robot_id"))
    return (seen.join(known, "robot_id", "left_anti").withColumn("problem", F.lit("unregistered"))
            .unionByName(known.join(seen, "robot_id", "left_anti").withColumn("problem", F.lit("silent"))))


def live_values(latest: DataFrame, samples: DataFrame, fields: list[str], order=("ts", "event_id")) -> DataFrame:
    """Current value of every field and topic per robot, in long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    state = latest.select("robot_id", F.explode(pairs).alias("p")).select("robot_id", "p.key", "p.value")
    topics = samples.groupBy("robot_id", F.col("topic").alias("key")).agg(
        F.max_by(F.coalesce(F.col("num").cast("string"), F.col("payload")), F.struct(*order)).alias("value"))
    return state.unionByName(topics)


def latest_topic_value(samples: DataFrame, order=("ts", "event_id")) -> DataFrame:
    return samples.groupBy("robot_id", "topic").agg(F.max_by(F.struct("num", "payload", "ts"), F.struct(*order)).alias("l")).select(
        "robot_id", "topic", "l.num", "l.payload", F.col("l.ts").alias("seen_at"))


def retained_values(messages: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Last payload per topic; an empty payload clears the topic."""
    last = messages.groupBy("topic").agg(F.max_by("payload", F.struct(*order)).alias("payload"))
    return last.filter("payload <> ''")


def push_devices(subs: DataFrame, width: int = 60) -> DataFrame:
    return subs.withColumn("endpoint", F.concat(F.substring("endpoint", 1, width), F.lit("…")))


def upsert_subscriptions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Apply subscriptions in arrival order: new keys win, a missing label keeps the old one."""
    newest = incoming.groupBy("endpoint").agg(
        F.max_by(F.struct("p256dh", "auth"), "arrival").alias("n"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("arrival"))).alias("new_label"))
    both = current.join(newest, "endpoint", "full")
    fresh = F.col("n").isNotNull()
    return both.select(
        "endpoint", F.coalesce(F.col("n.p256dh"), F.col("p256dh")).alias("p256dh"), F.coalesce(F.col("n.auth"), F.col("auth")).alias("auth"),
        F.coalesce("new_label", "label").alias("label"),
        F.when(fresh, F.lit(0)).otherwise(F.col("failures")).alias("failures"), "created_at")


def prune_dead_endpoints(subs: DataFrame, deliveries: DataFrame, at: str) -> DataFrame:
    """Remove endpoints the service reports gone; stamp the others if anything got through."""
    dead = deliveries.filter(F.col("status_code").isin(404, 410)).select("endpoint").distinct()
    any_ok = broadcast_if_small(deliveries.agg(F.bool_or(F.col("status_code") == 200).alias("_ok"), F.lit(1).alias("_one")))
    alive = subs.join(dead, "endpoint", "left_anti").withColumn("_one", F.lit(1)).join(any_ok, "_one", "left")
    return alive.withColumn("last_ok", F.when(F.col("_ok"), time_literal(at)).otherwise(F.col("last_ok"))).drop("_ok", "_one")
