"""History, catalogue and incident queries over archived rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import bucket_start, col, micros, seconds_between
from fleetlens.operators.sequence import Slices, drop_slice, lag, scan
from fleetlens.session import broadcast_if_small

# Limits of the query interface.
EVENTS_LIMIT_MAX = 5_000
ALERTS_LIMIT_MAX = 1_000
AUTO_BUCKET_SPAN_S = 6 * 3600
FRESH_SECONDS = 6.0


def clamp_limit(n: int, top: int) -> int:
    return max(1, min(int(n), top))


def time_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def default_window(as_of: str, start: str | None = None, end: str | None = None, span: str = "interval 1 hour") -> tuple[Column, Column]:
    """Bounds of a history request: what is given, else ``span`` up to the end, else up to ``as_of``."""
    stop = time_literal(end or as_of)
    return (time_literal(start) if start else stop - F.expr(span)), stop


def history_raw(df: DataFrame, as_of: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All rows in the requested window, or in the hour before ``as_of``."""
    low, high = default_window(as_of, start, end)
    if "day" in df.columns:
        df = df.filter((F.col("day") >= F.to_date(low)) & (F.col("day") <= F.to_date(high)))
    return df.filter((F.col("ts") >= low) & (F.col("ts") < high))


def scan_archive(df: DataFrame, start: str, end: str, robot_id: str | None = None) -> DataFrame:
    """Rows in [start, end). A ``day`` partition column, when present, is pruned as well."""
    if "day" in df.columns:
        # the end is exclusive: at midnight its day holds nothing
        last = F.to_date(time_literal(end) - F.expr("interval 1 microsecond"))
        df = df.filter((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") <= last))
    df = df.filter((F.col("ts") >= time_literal(start)) & (F.col("ts") < time_literal(end)))
    return df if robot_id is None else df.filter(F.col("robot_id") == robot_id)


def newest(df: DataFrame, *order: str, limit: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def oldest(df: DataFrame, *order: str, limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def auto_bucket(start_s: float, end_s: float, limit: int, bucket_s: float | None = None) -> float | None:
    """Bucket width for a query: given, or derived when the window exceeds six hours.

    ``limit`` is the number of buckets that one robot may have; nothing is cut off.
    """
    span = end_s - start_s
    if bucket_s is None and span > AUTO_BUCKET_SPAN_S:
        return max(span / limit, 1.0)
    return bucket_s


def history_bucketed(df: DataFrame, bucket_s: float, limit: int | None = None) -> DataFrame:
    """Averages per robot and bucket. Partial aggregation runs before the one shuffle."""
    out = df.groupBy("robot_id", bucket_start("ts", bucket_s).alias("ts")).agg(
        F.round(F.avg("battery"), 6).alias("battery"),
        F.round(F.avg("v"), 6).alias("v"),
        F.round(F.max(F.abs("w")), 6).alias("w_peak"),
        F.round(F.avg("temp"), 6).alias("temp"),
        F.count(F.lit(1)).alias("samples"),
    )
    return out if limit is None else oldest(out, "ts", "robot_id", limit=limit)


def topic_bucketed(df: DataFrame, bucket_s: float, limit: int | None = None) -> DataFrame:
    out = df.groupBy("robot_id", "topic", bucket_start("ts", bucket_s).alias("ts")).agg(
        F.round(F.avg("num"), 6).alias("num"),
        F.min("num").alias("lo"),
        F.max("num").alias("hi"),
        F.count(F.lit(1)).alias("samples"),
    )
    return out if limit is None else oldest(out, "ts", "robot_id", "topic", limit=limit)


def events_filter(df: DataFrame, robot_id=None, kind=None, severity=None, start=None, end=None, limit=500) -> DataFrame:
    for column, wanted in (("robot_id", robot_id), ("kind", kind), ("severity", severity)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    if start is not None:
        df = df.filter(F.col("ts") >= time_literal(start))
    if end is not None:
        df = df.filter(F.col("ts") < time_literal(end))
    return newest(df, "ts", "id", limit=clamp_limit(limit, EVENTS_LIMIT_MAX))


def with_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_s", seconds_between("resolved_at", "started_at"))


def alerts_by_rule(df: DataFrame) -> DataFrame:
    return with_duration(df).groupBy("rule_name", "severity").agg(
        F.count(F.lit(1)).alias("fired"), F.round(F.avg("duration_s"), 1).alias("avg_duration_s"))


def incident_window(samples: DataFrame, windows: DataFrame, bin_s: int = 6 * 3600) -> DataFrame:
    """Samples inside given (robot_id, t0, t1) windows, bounds included.

    Windows are laid out over bins of time, so that a sample meets only the windows near it.
    """
    spot = lambda ts: F.floor(micros(ts) / (bin_s * 1_000_000))
    w = broadcast_if_small(windows.filter("t0 <= t1").select(
        "incident_id", "robot_id", "t0", "t1", F.explode(F.sequence(spot("t0"), spot("t1"))).alias("_bin")))
    return (samples.withColumn("_bin", spot("ts")).join(w, ["robot_id", "_bin"])
            .filter(F.col("ts").between(F.col("t0"), F.col("t1")))
            .withColumn("shown", F.coalesce(F.col("num").cast("string"), F.col("payload"))).drop("_bin"))


def incident_timeline(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Audit rows and alerts in one list; the caller filters robot and time first."""
    return events.select("robot_id", "ts", "kind", "severity", F.col("detail").alias("content")).unionByName(
        alerts.select("robot_id", F.col("started_at").alias("ts"), F.lit("alert").alias("kind"), "severity",
                      F.col("message").alias("content")))


def catalog(df: DataFrame) -> DataFrame:
    """One row per (robot, topic): counts, first/last time, last value, last change."""
    changed = F.when(F.col("flag") == 0, F.col("ts"))
    return df.groupBy("robot_id", "topic").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max_by(F.substring("payload", 1, 200), F.struct("ts", "event_id")).alias("last_value"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max(changed).alias("last_changed"),
    )


def catalog_browse(cat: DataFrame, as_of: str, contains: str = "") -> DataFrame:
    age = seconds_between(time_literal(as_of), "last_seen")
    out = cat.withColumns({"age_s": age, "fresh": age < FRESH_SECONDS})
    return out.filter(F.lower("topic").contains(contains.strip().lower())) if contains.strip() else out


def liveness(cat: DataFrame, as_of: str, quiet_s: float) -> DataFrame:
    """steady: still reporting an old value; silent: nothing at all; active: recent change."""
    def old(c):
        return F.coalesce(seconds_between(time_literal(as_of), c) > quiet_s, F.lit(True))
    return cat.withColumn("liveness", F.when(old("last_seen"), "silent").when(old("last_changed"), "steady").otherwise("active"))


def sample_gaps(df: DataFrame, keys, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Seconds since the previous sample of the same key; null for the first."""
    out = drop_slice(scan(df, keys, list(order), {"_prev": lag(micros("ts"))}, micros("ts"), slices))
    return out.withColumn("gap_s", (micros("ts") - F.col("_prev")) / F.lit(1e6)).drop("_prev")


def gap_stats(gaps: DataFrame, keys) -> DataFrame:
    return gaps.filter("gap_s is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg("gap_s"), 2).alias("avg_gap_s"),
        F.round(F.max("gap_s"), 2).alias("max_gap_s"))


def outages(gaps: DataFrame, threshold_s: float) -> DataFrame:
    """Silences longer than the threshold, with start and end."""
    end_us = micros("ts")
    return gaps.filter(F.col("gap_s") > threshold_s).withColumns({
        "outage_start": F.timestamp_micros(end_us - F.round(F.col("gap_s") * 1e6).cast("bigint")).cast("timestamp_ntz"),
        "outage_end": F.col("ts")})


def robot_volume(df: DataFrame) -> DataFrame:
    """Counts per robot; pre-aggregated per topic so the distinct count needs no expand."""
    per_topic = df.groupBy("robot_id", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return per_topic.groupBy("robot_id").agg(
        F.sum("n").alias("samples"), F.count(F.lit(1)).alias("topics"), F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"))


def loudest_topics(cat: DataFrame, n: int = 15) -> DataFrame:
    return (cat.groupBy("topic").agg(F.sum("samples").alias("samples"), F.max("last_seen").alias("last_seen"))
            .orderBy(F.col("samples").desc(), "topic").limit(n))


def chart_summary(df: DataFrame, as_of: str, hours: list[int]) -> DataFrame:
    """Count, numeric min, max and mean for several trailing windows in one pass."""
    age_h = seconds_between(time_literal(as_of), "ts") / 3600
    spans = df.withColumn("hours", F.explode(F.filter(F.array(*[F.lit(h) for h in hours]), lambda h: age_h <= h)))
    return spans.groupBy("robot_id", "topic", "hours").agg(
        F.count(F.lit(1)).alias("samples"), F.count("num").alias("points"), F.min("num").alias("lo"),
        F.max("num").alias("hi"), F.round(F.avg("num"), 6).alias("mean"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alert_log_window(df: DataFrame, robot_id: str | None = None, limit: int = 100) -> DataFrame:
    df = df if robot_id is None else df.filter(F.col("robot_id") == robot_id)
    return newest(df, "started_at", "id", limit=clamp_limit(limit, ALERTS_LIMIT_MAX))


def credential_state(robots: DataFrame, pending=None) -> DataFrame:
    pending = F.lit(False) if pending is None else col(pending)
    return robots.withColumn("credential", F.when(F.col("revoked_at").isNotNull(), "revoked")
                             .when(F.col("secret_hash").isNotNull(), "credentialed")
                             .when(pending, "pending").otherwise("none"))
