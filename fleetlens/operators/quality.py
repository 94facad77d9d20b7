"""Redelivery, clock skew, time correction and ingest accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import col, from_micros, micros
from fleetlens.operators.sequence import Slices, drop_slice, lag, last_known, scan

# Limits of the time correction.
CLOCK_CORRECT_S = 2.0
MAX_BACKFILL_S = 7 * 86400.0
MAX_FUTURE_S = 300.0
INT32_MIN, INT32_MAX = -2_147_483_648, 2_147_483_647


def dedup_batches(batches: DataFrame) -> DataFrame:
    """Keep the first delivery of each (robot, boot, seq); batches without them all pass.

    Works on headers with the payload still packed; unpack the survivors afterwards.
    The rank filter runs before the shuffle too, so a batch redelivered a billion times
    sends one row per task, not a billion.
    """
    versioned = batches.filter(F.col("boot").isNotNull() & F.col("seq").isNotNull())
    first = Window.partitionBy("robot_id", "boot", "seq").orderBy("recv_ts", "topic")
    kept = versioned.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.unionByName(batches.filter(F.col("boot").isNull() | F.col("seq").isNull()))


def measure_skew(batches: DataFrame) -> DataFrame:
    """Vehicle clock minus server clock, once per batch; null without a send time."""
    skew = F.col("sent_us") - F.col("recv_us")
    ms = F.when(skew >= 0, F.floor(skew / 1000)).otherwise(F.ceil(skew / 1000))
    return batches.withColumns({
        "skew_us": skew,
        "skew_ms": F.greatest(F.lit(INT32_MIN), F.least(F.lit(INT32_MAX), F.when(skew.isNotNull(), ms))).cast("int"),
    }).withColumn("skew_ms", F.when(F.col("skew_us").isNotNull(), F.col("skew_ms")))


def needs_correction(skew_us="skew_us", threshold_s: float = CLOCK_CORRECT_S):
    return F.coalesce(F.abs(col(skew_us)) >= threshold_s * 1e6, F.lit(False))


def correct_timestamps(rows: DataFrame, threshold_s: float = CLOCK_CORRECT_S,
                       max_backfill_s: float = MAX_BACKFILL_S, max_future_s: float = MAX_FUTURE_S) -> DataFrame:
    """Shift samples onto the server's clock, then clamp to the sane window around arrival."""
    shift = F.when(needs_correction(threshold_s=threshold_s), F.col("skew_us")).otherwise(F.lit(0))
    stamp = F.col("raw_us") - shift
    clamped = (stamp < F.col("recv_us") - int(max_backfill_s * 1e6)) | (stamp > F.col("recv_us") + int(max_future_s * 1e6))
    return rows.withColumn("clamped", clamped).withColumn("ts", from_micros(F.when(clamped, F.col("recv_us")).otherwise(stamp)))


def clock_events(batches: DataFrame, threshold_s: float = CLOCK_CORRECT_S) -> DataFrame:
    """One event per robot, at its first batch with a skew worth correcting."""
    bad = batches.filter(needs_correction(threshold_s=threshold_s))
    return bad.groupBy("robot_id").agg(
        F.min("recv_ts").alias("ts"),
        F.round(F.min_by("skew_us", F.struct("recv_ts", "topic")) / 1e6, 2).alias("skew_s"),
    ).select("robot_id", "ts", F.lit("clock").alias("kind"), F.lit("warn").alias("severity"), "skew_s")


def clock_skew_table(batches: DataFrame, threshold_s: float = CLOCK_CORRECT_S) -> DataFrame:
    """Latest skew per robot, worst first, where it matters."""
    last = batches.filter("skew_us is not null").groupBy("robot_id").agg(
        (F.max_by("skew_us", F.struct("recv_ts", "topic")) / 1e6).alias("skew_s"))
    return (last.filter(F.abs("skew_s") >= threshold_s)
            .withColumns({"off_by_s": F.abs("skew_s"),
                          "direction": F.when(F.col("skew_s") > 0, "fast").otherwise("slow")})
            .orderBy(F.col("off_by_s").desc(), "robot_id"))


def duplicate_counts(batches: DataFrame) -> DataFrame:
    """Deliveries, redeliveries and redeliveries whose content differs, per robot."""
    per_key = batches.filter("boot is not null and seq is not null").groupBy("robot_id", "boot", "seq").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum("n_items").alias("all_items"),
        F.min_by("n_items", F.struct("recv_ts", "topic")).alias("kept_items"),
        (F.min(F.xxhash64("payload")) != F.max(F.xxhash64("payload"))).alias("conflict"))
    return per_key.groupBy("robot_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("kept_items").alias("samples"),
        F.sum(F.col("copies") - 1).alias("duplicate_batches"),
        F.sum(F.col("all_items") - F.col("kept_items")).alias("duplicate_samples"),
        F.count_if("conflict").alias("conflicting_duplicates"))


def ingest_counters(status: DataFrame, batches: DataFrame, samples: DataFrame) -> DataFrame:
    """Fleet-wide totals over the three lanes; each lane is reduced before they meet."""
    s = status.agg(F.count_if(~F.col("dropped")).alias("accepted"), F.count_if("dropped").alias("bad_status"))
    versioned = batches.filter("n_items is not null")
    b = batches.agg(F.count_if(F.col("n_items").isNull()).alias("bad_batches"),
                    F.count_if(F.col("n_items").isNotNull() & F.col("enveloped")
                               & (F.col("boot").isNull() | F.col("seq").isNull())).alias("unversioned"))
    d = duplicate_counts(versioned).agg(F.coalesce(F.sum("duplicate_batches"), F.lit(0)).alias("duplicate_batches"),
                                        F.coalesce(F.sum("duplicate_samples"), F.lit(0)).alias("duplicate_samples"))
    r = samples.agg(F.count_if("dropped").alias("bad_items"), F.count_if(~F.col("dropped")).alias("samples"),
                    F.count_if(~F.col("dropped") & F.col("clamped")).alias("clamped"))
    one = F.lit(1).alias("_one")
    out = s.select("*", one)
    for part in (b, d, r):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def overflow(df: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """Newest ``capacity`` rows per key; the rank limit also runs before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= capacity).drop("_n")


def overflow_accounting(df: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """How many rows a bounded buffer keeps and loses."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.least(n, F.lit(capacity)).alias("kept"),
                                 F.greatest(n - capacity, F.lit(0)).alias("lost"))


def outage_rows(rows: DataFrame, switches: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Rows (robot_id, ts, event_id) that came while the store was down, with ``down_since``.

    ``switches`` (robot_id, ts, event_id, up) say when it went down and came back; repeats of one state change
    nothing, and at one instant a switch comes before rows. Before the first switch it is up.
    """
    both = rows.select("robot_id", "ts", "event_id", F.lit(1).alias("_kind"), F.lit(None).cast("boolean").alias("_up")).unionByName(
        switches.select("robot_id", "ts", "event_id", F.lit(0).alias("_kind"), F.col("up").alias("_up")))
    order = ["ts", "_kind", "event_id"]
    both = scan(both, "robot_id", order, {"_state": last_known("_up")}, micros("ts"), slices)
    both = scan(both, "robot_id", order, {"_before": lag("_state")}, micros("ts"), slices)
    down = ~F.coalesce("_state", F.lit(True))
    both = both.withColumn("_start", F.when(down & F.coalesce("_before", F.lit(True)), F.col("ts")))
    both = drop_slice(scan(both, "robot_id", order, {"down_since": last_known("_start")}, micros("ts"), slices))
    return both.filter((F.col("_kind") == 1) & down).select("robot_id", "ts", "event_id", "down_since")


def overflow_by_outage(rows: DataFrame, switches: DataFrame, capacity: int, slices: Slices | None = None) -> DataFrame:
    """What a buffer of ``capacity`` rows keeps and loses in each outage; it is emptied when the store comes back."""
    return overflow_accounting(outage_rows(rows, switches, slices), ["robot_id", "down_since"], capacity)
