"""Egress, throughput, storage and retention reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros
from fleetlens.operators.sequence import Slices, drop_slice, lag, last_known, lead, plan_slices, running, scan
from fleetlens.session import broadcast_if_small, cut_lineage

# Meters and guards.
HEADER_BYTES = 200
EGRESS_WINDOW_S = 60.0
DISK_WARN_PCT, DISK_CRITICAL_PCT = 15.0, 5.0
THROTTLED_DROP_PCT = 25.0
#: Instants per slice; all traffic is one sequence.
RATE_ROWS = 250_000


def sent_bytes(requests: DataFrame) -> DataFrame:
    """HTTP bodies get a flat header allowance; frames do not."""
    return requests.withColumn("bytes", F.col("body_bytes") + F.when(F.col("kind") == "http", HEADER_BYTES).otherwise(0))


def egress_rate(requests: DataFrame, window_s: float = EGRESS_WINDOW_S, target_rows: int = RATE_ROWS) -> DataFrame:
    """Trailing byte rate at every instant something was sent.

    Bytes are first summed per instant. An instant adds its bytes when it comes and takes them back just after the
    window, so the trailing sum is a running sum and the start of the window the successor of the last instant that
    has left it; no frame is summed anew. Traffic has no key, so time is cut into slices.
    """
    w = int(window_s * 1e6)
    at = sent_bytes(requests).groupBy(micros("ts").alias("at_us")).agg(F.sum("bytes").alias("bytes"))
    at = cut_lineage(at.withColumn("_all", F.lit(0)))
    slices = plan_slices(at, "_all", F.col("at_us"), target_rows)
    along = scan(at, "_all", ["at_us"], {"_prev": lag("at_us"), "_next": lead("at_us")}, F.col("at_us"), slices)
    comes = F.struct(F.col("at_us").alias("_at"), F.lit(1).alias("_kind"), F.col("bytes").alias("_delta"),
                     F.when(F.col("_prev").isNull(), F.col("at_us")).alias("_from"))
    goes = F.when(F.col("_next").isNotNull(), F.struct(
        (F.col("at_us") + w + 1).alias("_at"), F.lit(0).alias("_kind"), (-F.col("bytes")).alias("_delta"), F.col("_next").alias("_from")))
    marks = drop_slice(along).select("_all", "bytes", F.explode(F.array_compact(F.array(comes, goes))).alias("m")).select("_all", "bytes", "m.*")
    rated = drop_slice(scan(marks, "_all", ["_at", "_kind"], {"_sum": running("_delta"), "_lo": last_known("_from")}, F.col("_at"), slices))
    span_s = F.greatest((F.col("_at") - F.col("_lo")) / F.lit(1e6), F.lit(1.0))
    return rated.filter("_kind = 1").select(F.col("_at").alias("at_us"), "bytes", (F.col("_sum") / span_s).alias("rate_bps"))


def egress_meter(requests: DataFrame, window_s: float = EGRESS_WINDOW_S) -> DataFrame:
    """Totals, current and peak rate, and what they cost per day and month."""
    sent = sent_bytes(requests)
    ws = F.col("kind") == "ws"
    totals = sent.agg(F.sum(F.when(~ws, F.col("bytes"))).alias("http_bytes"), F.sum(F.when(ws, F.col("bytes"))).alias("ws_bytes"),
                      F.count_if(~ws).alias("http_requests"), F.count_if(ws).alias("ws_frames"), F.sum("bytes").alias("total_bytes"),
                      (F.max(micros("ts")) - F.min(micros("ts"))).alias("_span"), F.lit(1).alias("_one"))
    rates = egress_rate(requests, window_s).agg(F.max("rate_bps").alias("_peak"), F.max_by("rate_bps", "at_us").alias("_rate"),
                                                F.lit(1).alias("_one"))
    both = totals.join(rates, "_one")
    uptime = F.greatest(F.col("_span") / F.lit(1e6), F.lit(1.0))
    return both.select(
        "http_bytes", "ws_bytes", "http_requests", "ws_frames", "total_bytes",
        F.round("_rate", 1).alias("rate_bps"), F.round("_peak", 1).alias("peak_bps"),
        F.round(F.col("total_bytes") / uptime, 1).alias("avg_bps"),
        F.round(F.col("_rate") * 86400 / 1e9, 3).alias("gb_day"), F.round(F.col("_rate") * 86400 * 30 / 1e9, 2).alias("gb_month"))


def throughput_verdict(transfers: DataFrame, bucket_s: float) -> DataFrame:
    """Does a session slow down? Mean rate of its first two buckets against its last two."""
    b = int(bucket_s * 1e6)
    buckets = transfers.groupBy("session", F.floor(micros("ts") / b).alias("_b")).agg((F.sum("bytes") / bucket_s).alias("_r"))
    up, down = Window.partitionBy("session").orderBy("_b"), Window.partitionBy("session").orderBy(F.col("_b").desc())
    ranked = buckets.withColumns({"_i": F.row_number().over(up), "_j": F.row_number().over(down)})
    out = ranked.groupBy("session").agg(
        F.count(F.lit(1)).alias("buckets"), F.avg(F.when(F.col("_i") <= 2, F.col("_r"))).alias("_head"),
        F.avg(F.when(F.col("_j") <= 2, F.col("_r"))).alias("_tail"))
    drop = F.when(F.col("_head") != 0, (1 - F.col("_tail") / F.col("_head")) * 100).otherwise(0.0)
    return out.select("session", "buckets", F.round(drop, 6).alias("drop_pct"),
                      F.when(F.col("buckets") < 4, "inconclusive").when(drop > THROTTLED_DROP_PCT, "throttled")
                      .otherwise("no-throttle").alias("verdict"))


def transfer_rates(transfers: DataFrame, key: str = "size_bytes", slices: Slices | None = None) -> DataFrame:
    """Best and exact median rate per transfer size.

    The median is a rank in a running count, so no group is ever held in memory.
    """
    rate = F.col("bytes") / F.col("seconds")
    counts = transfers.groupBy(key, rate.alias("rate")).agg(F.count(F.lit(1)).alias("_n"))
    totals = broadcast_if_small(transfers.groupBy(key).agg(F.count(F.lit(1)).alias("_all")))
    ranked = drop_slice(scan(counts, key, ["rate"], {"_upto": running("_n")}, F.col("rate"), slices)).join(totals, key)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    return ranked.groupBy(key).agg(
        F.max("rate").alias("best"),
        ((F.min(F.when(F.col("_upto") >= low, F.col("rate"))) + F.min(F.when(F.col("_upto") >= high, F.col("rate")))) / 2).alias("median"))


# ------------------------------------------------------------------ storage

def storage_by_file(df: DataFrame) -> DataFrame:
    """Rows and bytes per stored file, largest first. Sizes come from the file metadata."""
    return (df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes")).orderBy(F.col("bytes").desc()))


def storage_by_day(archive: DataFrame) -> DataFrame:
    """Rows, files and bytes of every day folder of an archive, newest first."""
    files = archive.select("day", "_metadata.file_path", "_metadata.file_size").groupBy("day", "file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))
    return files.groupBy("day").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"),
                                    F.sum("bytes").alias("bytes")).orderBy(F.col("day").desc())


def bytes_per_row(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).withColumn(
        "bytes_per_row", F.round(F.col("bytes") / F.nullif(F.col("rows"), F.lit(0)), 1))


def storage_projection(df: DataFrame, row_bytes, retention_days: int, keys: list[str] = ()) -> DataFrame:
    """Observed rate and row size -> bytes per day, GB per month and at full retention."""
    span = F.greatest((F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(1e6), F.lit(1.0))
    out = df.groupBy(*keys).agg((F.count(F.lit(1)) / span).alias("_rate"), F.avg(row_bytes).alias("_size"))
    per_s = F.col("_rate") * F.col("_size")
    return out.select(*keys, F.round("_rate", 8).alias("rows_per_s"), F.round(per_s * 86400, 4).alias("bytes_per_day"),
                      F.round(per_s * 86400 * 30 / 1e9, 9).alias("gb_per_month"),
                      F.round(per_s * 86400 * retention_days / 1e9, 9).alias("gb_at_retention"))


# ------------------------------------------------------------------ retention

def retention_plan(tables: dict[str, DataFrame], today: str, keep_days: int) -> DataFrame:
    """Day partitions of every table with their rows and whether they are past retention."""
    parts = None
    for name, df in tables.items():
        days = df.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        parts = days if parts is None else parts.unionByName(days)
    cutoff = F.date_sub(F.lit(today).cast("date"), keep_days)
    return parts.withColumn("expired", F.col("day") < cutoff)


def emergency_retention(disk: DataFrame, days: DataFrame, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Disk events per volume: one warning per crossing, one dropped day per critical reading.

    The n-th critical reading of a volume drops the n-th oldest day. ``days`` has one row per
    archived day, so ranking it is small whatever the archive holds.
    """
    free = F.col("free_pct")
    steps = {"_relief": running((free > DISK_WARN_PCT).cast("long")), "_nth": running((free <= DISK_CRITICAL_PCT).cast("long"))}
    rows = drop_slice(scan(disk, "volume", list(order), steps, micros("ts"), slices))
    ranked = days.select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("_nth"))
    critical = rows.filter(free <= DISK_CRITICAL_PCT).join(broadcast_if_small(ranked), "_nth", "left").select(
        "volume", "ts", F.lit("critical").alias("severity"), "free_pct", F.col("day").alias("dropped_day"))
    low = rows.filter((free > DISK_CRITICAL_PCT) & (free <= DISK_WARN_PCT))
    warned = low.groupBy("volume", "_relief").agg(F.min_by(F.struct("ts", "free_pct"), F.struct(*order)).alias("f")).select(
        "volume", "f.ts", F.lit("warn").alias("severity"), "f.free_pct", F.lit(None).cast("date").alias("dropped_day"))
    return critical.unionByName(warned)


def size_retention(files: DataFrame, cap: int, keys: list[str], slices: Slices | None = None) -> DataFrame:
    """Keep the newest files whose total stays within ``cap``; the rest goes."""
    rows = drop_slice(scan(files, keys, ["seq"], {"_upto": running("size")}, F.col("seq"), slices))
    totals = files.groupBy(*keys).agg(F.sum("size").alias("_all"))
    rows = rows.join(broadcast_if_small(totals), keys)
    newer = F.col("_all") - F.col("_upto") + F.col("size")
    return rows.withColumn("kept", newer <= cap).drop("_all", "_upto")
