"""Four-state presence: unknown, ok, stale, offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import from_micros
from fleetlens.operators.sequence import Slices, drop_slice, lag, last_known, lead, scan
from fleetlens.sources.messages import link_up

# State names and default limits.
UNKNOWN, OK, STALE, OFFLINE = "unknown", "ok", "stale", "offline"
OFFLINE_AFTER_S = 6.0
STALE_AFTER_S = 60.0


def decide(at_us: Column, seen_us: Column, link: Column, link_us: Column, offline_after_s: float, stale_after_s: float) -> Column:
    """Presence at one instant. An explicit link-down wins, silence comes next."""
    age = at_us - seen_us
    return (F.when((~link) & (link_us >= F.coalesce(seen_us, F.lit(0))), OFFLINE)
            .when(seen_us.isNull(), UNKNOWN)
            .when(age <= int(offline_after_s * 1e6), OK)
            .when(age <= int(stale_after_s * 1e6), STALE)
            .otherwise(OFFLINE))


def signals(data: DataFrame, lwt: DataFrame) -> DataFrame:
    """One ordered stream of data arrivals and last-will messages per robot."""
    seen = data.select("robot_id", F.col("ts_us").alias("at_us"), F.lit(0).alias("rank"), "event_id",
                       F.col("ts_us").alias("seen_us"), F.lit(None).cast("boolean").alias("up"))
    link = lwt.select("robot_id", F.col("ts_us").alias("at_us"), F.lit(1).alias("rank"), "event_id",
                      F.lit(None).cast("long").alias("seen_us"), link_up("payload").alias("up"))
    return seen.unionByName(link)


def presence(data: DataFrame, lwt: DataFrame, as_of: str, robots: DataFrame | None = None,
             offline_after_s: float = OFFLINE_AFTER_S, stale_after_s: float = STALE_AFTER_S) -> DataFrame:
    """Presence of every robot at ``as_of``: two aggregations, no ordered scan."""
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    last = signals(data, lwt).filter(F.col("at_us") <= at).groupBy("robot_id").agg(
        F.max("seen_us").alias("seen_us"),
        F.max(F.when(F.col("up").isNotNull(), F.struct("at_us", "event_id", "up"))).alias("link"))
    if robots is not None:
        last = robots.select("robot_id").join(last, "robot_id", "left")
    up = F.coalesce(F.col("link.up"), F.lit(True))
    return last.select(
        "robot_id", decide(at, F.col("seen_us"), up, F.col("link.at_us"), offline_after_s, stale_after_s).alias("presence"),
        from_micros("seen_us").alias("last_seen"), F.col("link.up").alias("link"))


def presence_timeline(data: DataFrame, lwt: DataFrame, as_of: str, offline_after_s: float = OFFLINE_AFTER_S,
                      stale_after_s: float = STALE_AFTER_S, slices: Slices | None = None) -> DataFrame:
    """Intervals of constant presence per robot, up to ``as_of``."""
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    known = signals(data, lwt).filter(F.col("at_us") <= at)
    return timeline_of(presence_changes(known, at, offline_after_s, stale_after_s, slices), at)


def presence_changes(known: DataFrame, until_us: Column | None, offline_after_s: float, stale_after_s: float,
                     slices: Slices | None = None) -> DataFrame:
    """Changes of presence per robot over ``signals``, each robot's first state included, before ``until_us``.

    Between two signals the state can only decay at two known instants, so each signal yields at most three pieces;
    equal neighbours are merged afterwards. Without ``until_us`` the silence after the last signal is followed to its end.
    """
    order = ["at_us", "rank", "event_id"]
    rows = scan(known, "robot_id", order,
                {"_seen": last_known("seen_us"), "_link": last_known(F.when(F.col("up").isNotNull(), F.struct("up", "at_us"))),
                 "_next": lead("at_us")}, F.col("at_us"), slices)
    end = F.coalesce(F.col("_next"), F.lit(1 << 62) if until_us is None else until_us)
    # the state holds up to and including the limit, so it changes one microsecond later
    to_stale = F.col("_seen") + int(offline_after_s * 1e6) + 1
    to_off = F.col("_seen") + int(stale_after_s * 1e6) + 1
    cuts = F.array_distinct(F.filter(F.array(F.col("at_us"), to_stale, to_off),
                                     lambda c: c.isNotNull() & (c >= F.col("at_us")) & (c < end)))
    up = F.coalesce(F.col("_link.up"), F.lit(True))
    pieces = rows.withColumn("piece_us", F.explode(cuts)).withColumn(
        "presence", decide(F.col("piece_us"), F.col("_seen"), up, F.col("_link.at_us"), offline_after_s, stale_after_s))
    keep = [c for c in ("_slice",) if c in pieces.columns]
    pieces = pieces.select("robot_id", "presence", *CHANGE_ORDER, *keep)
    pieces = scan(pieces, "robot_id", CHANGE_ORDER, {"_before": lag("presence")})
    return pieces.filter(F.col("_before").isNull() | (F.col("_before") != F.col("presence"))).drop("_before")


CHANGE_ORDER = ["piece_us", "at_us", "rank", "event_id"]


def timeline_of(changes: DataFrame, until_us: Column) -> DataFrame:
    """Changes with what was before them and when they ended."""
    changes = drop_slice(scan(changes, "robot_id", CHANGE_ORDER, {"_end": lead("piece_us"), "before": lag("presence")}))
    return changes.select("robot_id", "presence", "before", from_micros("piece_us").alias("start_ts"),
                          from_micros(F.coalesce(F.col("_end"), until_us)).alias("end_ts"),
                          F.col("_end").isNull().alias("current"))


def presence_events(timeline: DataFrame) -> DataFrame:
    """Audit events: online on recovery, offline on every other change.

    ``repeat`` marks the second offline event of one silence (stale, then offline).
    """
    ok = F.col("presence") == OK
    return timeline.select(
        "robot_id", F.col("start_ts").alias("ts"), F.when(ok, "online").otherwise("offline").alias("kind"),
        F.when(ok, "info").otherwise("warn").alias("severity"),
        (~ok & F.coalesce(F.col("before").isin(STALE, OFFLINE, UNKNOWN), F.lit(False))).alias("repeat"))
