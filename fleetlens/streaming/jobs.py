"""Streaming jobs: continuous twins of the batch operators.

Every job takes a streaming DataFrame and returns one; ``run_once`` drives it over all
available input with a checkpoint in the shared folder and an exactly-once file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.functions.scalars import from_micros, micros
from fleetlens.operators import quality as Q
from fleetlens.operators.presence import OFFLINE_AFTER_S, STALE_AFTER_S, decide, signals
from fleetlens.operators.relay import HEARTBEAT_S, MAX_RATE_HZ
from fleetlens.sources import messages as M
from fleetlens.sources import sinks as K
from fleetlens.streaming import processors as P

#: How long a delivered sequence number is remembered: as long as the oldest backfill may take to come.
REMEMBER_S = int(Q.MAX_BACKFILL_S)


#: Furthest event time, either way, of a stream's clock.
CLOCK_US = 9_200_000_000_000_000

#: Size of a micro-batch that is read from the archive of another job.
BYTES_PER_TRIGGER = 256 << 20


def read_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """What another job has written, as a stream.

    Its files are as many as that job had tasks, whatever they hold, so micro-batches are bounded by bytes: every
    micro-batch costs its jobs, and one per file would make them hundreds.
    """
    return (spark.readStream.schema(spark.read.parquet(folder).schema).option("pathGlobFilter", "*.parquet")
            .option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(folder))


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_once(df: DataFrame, name: str, partition_by: list[str] = (), idle_batches: bool = True) -> str:
    """Process everything available, then stop; returns the folder with the result.

    ``idle_batches=False`` leaves out batches without rows, which state with a time to live asks for without end.
    """
    spark = df.sparkSession
    path = K.scratch_path(spark, name)
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(idle_batches).lower())
    try:
        writer = (df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
                  .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True))
        running = (writer.partitionBy(*partition_by) if partition_by else writer).start()
    finally:
        spark.conf.set(IDLE_BATCHES, before)
    running.awaitTermination()
    return f"{path}/data"


# ------------------------------------------------------------------ ingest

def dedup_stream(batches: DataFrame, remember_s: float = REMEMBER_S) -> DataFrame:
    """First delivery of each (robot, boot, seq); batches without them pass, and no batch is too late to pass."""
    return batches.groupBy("robot_id").transformWithState(
        P.FirstDelivery(batches.columns, int(remember_s * 1000)), batches.schema, "Append", "ProcessingTime")


def ingest_stream(raw: DataFrame) -> DataFrame:
    """(topic, payload, recv_ts) -> clean topic samples on the server's clock, by day."""
    batches = M.batch_headers(M.route_messages(raw).filter("lane = 'samples'")).filter("n_items is not null")
    rows = Q.correct_timestamps(M.explode_samples(M.batch_items(Q.measure_skew(dedup_stream(batches)))))
    return rows.select("robot_id", F.col("sample_topic").alias("topic"), "ts", "recv_ts", "skew_ms", "num",
                       F.col("value").alias("payload"), "flag", "clamped", F.to_date("ts").alias("day"))


# ------------------------------------------------------------------ windows

def tumbling_counts(samples: DataFrame, width: str) -> DataFrame:
    """Sums per robot, window and arriving micro-batch part; add parts with ``sum_parts``.

    There is no watermark, so a row of any age counts. Window state would have to be kept for ever then; instead
    every micro-batch writes what it adds (see ``run_parts``) and reading adds the parts up.
    """
    out = samples.groupBy("robot_id", F.window(F.col("ts").cast("timestamp"), width).alias("_w")).agg(
        F.count(F.lit(1)).alias("samples"), F.count("num").alias("_numbers"), F.sum("num").alias("_sum"))
    return out.select("robot_id", F.col("_w.start").cast("timestamp_ntz").alias("ts"), "samples", "_numbers", "_sum")


def sum_parts(parts: DataFrame) -> DataFrame:
    """The counts and means of everything that has arrived."""
    return parts.groupBy("robot_id", "ts").agg(
        F.sum("samples").alias("samples"), F.round(F.sum("_sum") / F.nullif(F.sum("_numbers"), F.lit(0)), 6).alias("num"))


def run_parts(df: DataFrame, name: str, reduce) -> str:
    """Write ``reduce(rows)`` of every micro-batch; a retried batch overwrites its own part."""
    path = K.scratch_path(df.sparkSession, name)

    def keep(rows: DataFrame, batch_id: int) -> None:
        reduce(rows).write.mode("overwrite").parquet(f"{path}/data/b={batch_id}")

    (df.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True)
     .start().awaitTermination())
    return f"{path}/data"


def activity_stretches(samples: DataFrame, gap: str) -> DataFrame:
    """Stretches of activity per robot in one micro-batch; ``join_stretches`` makes sessions of all of them."""
    out = samples.groupBy("robot_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select("robot_id", "samples", "first_ts", "last_ts")


def join_stretches(parts: DataFrame, gap_s: int) -> DataFrame:
    """Sessions per robot, the ones still open included: stretches less than ``gap_s`` apart are one.

    The silence between two sessions is an outage. Late rows join the sessions they belong to, however old.
    """
    order = W.partitionBy("robot_id").orderBy("first_ts", "last_ts")
    ends = F.max(micros("last_ts")).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(micros("first_ts") - ends >= gap_s * 1_000_000, F.lit(True)).cast("int")
    rows = parts.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("robot_id", "_n").agg(F.sum("samples").alias("samples"), F.min("first_ts").alias("first_ts"),
                                              F.max("last_ts").alias("last_ts")).drop("_n")


# ------------------------------------------------------------------ keyed state

def relay_stream(samples: DataFrame, min_gap_s: float = 1 / MAX_RATE_HZ, heartbeat_s: float = HEARTBEAT_S,
                 deadband: float = 0.0) -> DataFrame:
    rows = samples.select("robot_id", "topic", "event_id", micros("ts").alias("at_us"), "num", "payload")
    return rows.groupBy("robot_id", "topic").transformWithState(
        P.RelayProcessor(min_gap_s, heartbeat_s, deadband), P.RELAY_OUT, "Append", "None")


def state_stream(status: DataFrame, fields: list[str] = P.STATE_FIELDS) -> DataFrame:
    """Archived state rows; write them by day, the alert job reads that archive."""
    more = ["mission_reset"] if "mission" in fields else []
    return status.select("robot_id", "event_id", "ts", *fields, *more).groupBy("robot_id").transformWithState(
        P.StateProcessor(fields), P.state_out(fields), "Append", "None")


def presence_stream(data: DataFrame, lwt: DataFrame, offline_after_s: float = OFFLINE_AFTER_S,
                    stale_after_s: float = STALE_AFTER_S, disorder: str = "1 minute") -> DataFrame:
    """Presence changes per robot; rows without a time take no part, as in ``presence.presence_timeline``."""
    up = F.col("up")
    kind = (F.when(F.col("rank") == 0, P.DATA).when(up, P.LINK_UP).when(~up, P.LINK_DOWN).otherwise(P.LINK_UNKNOWN))
    # the clock's column reaches pandas, whose times are nanoseconds
    clock = F.timestamp_micros(F.least(F.greatest("at_us", F.lit(-CLOCK_US)), F.lit(CLOCK_US)))
    rows = signals(data, lwt).filter("at_us is not null").select(
        F.pmod(F.xxhash64("robot_id"), F.lit(P.PRESENCE_GROUPS)).alias("robots"), "robot_id", "at_us", kind.alias("kind"),
        F.coalesce("event_id", F.lit(P.NEVER)).alias("event_id"), clock.alias("_at"))
    return rows.withWatermark("_at", disorder).groupBy("robots").transformWithStateInPandas(
        P.PresenceProcessor(offline_after_s, stale_after_s), P.PRESENCE_OUT, "Append", "EventTime")


def open_tail(changes: DataFrame, known: DataFrame, as_of: str, offline_after_s: float = OFFLINE_AFTER_S,
              stale_after_s: float = STALE_AFTER_S) -> DataFrame:
    """Changes that the stream has reported, completed by the silence after each robot's last signal.

    Timers fire when later rows move the clock on, so at the end of the input some have not fired yet. What silence
    does until ``as_of`` follows from the last signals alone; reported timer rows are replaced by it.
    """
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    last = known.filter(F.col("at_us") <= at).groupBy("robot_id").agg(
        F.max("at_us").alias("last_us"), F.max("seen_us").alias("seen_us"),
        F.max(F.when(F.col("up").isNotNull(), F.struct("at_us", "event_id", "up"))).alias("link"))
    reported = changes.join(last.select("robot_id", "last_us"), "robot_id").filter("at_us <= last_us")
    up, seen = F.coalesce(F.col("link.up"), F.lit(True)), F.col("seen_us")
    state = lambda c: F.struct(c.alias("at_us"), decide(c, seen, up, F.col("link.at_us"), offline_after_s, stale_after_s).alias("p"))
    cuts = F.filter(F.array(seen + int(offline_after_s * 1e6) + 1, seen + int(stale_after_s * 1e6) + 1),
                    lambda c: (c > F.col("last_us")) & (c < at))
    steps = F.concat(F.array(F.col("last_us")), F.coalesce(cuts, F.array().cast("array<bigint>")))
    rows = last.select("robot_id", F.transform(steps, state).alias("s"))
    rows = rows.select("robot_id", F.explode(F.zip_with(F.slice("s", 2, 2), F.slice("s", 1, F.size("s") - 1), lambda b, a: F.struct(
        b["at_us"].alias("at_us"), b["p"].alias("presence"), a["p"].alias("before")))).alias("x")).select("robot_id", "x.*")
    rows = rows.filter("presence <> before")
    return reported.select(*rows.columns).unionByName(rows).select("robot_id", "presence", "before", from_micros("at_us").alias("start_ts"))


def alert_stream(hits: DataFrame) -> DataFrame:
    """Rows of ``alerts.with_hits`` -> start / repeat / stop marks."""
    # numbers pass through as texts, which keep null and NaN apart
    rows = hits.select("rule_id", "robot_id", "event_id", micros("ts").alias("at_us"), F.col("num").cast("string").alias("num"), "hit", "hold",
                       "for_seconds", F.coalesce(F.round(F.col("cooldown_min") * 60e6).cast("long"), F.lit(0)).alias("cool_us"))
    rows = rows.withColumn("robots", F.pmod(F.xxhash64("robot_id"), F.lit(P.ALERT_GROUPS)))
    marks = rows.groupBy("robots").transformWithStateInPandas(P.AlertProcessor(), P.ALERT_OUT, "Append", "None")
    return marks.select("rule_id", "robot_id", from_micros("at_us").alias("ts"), F.col("num").cast("double").alias("num"), "mark")


# ------------------------------------------------------------------ small tables

def catalog_job(samples: DataFrame, root: str):
    """Keep the topic catalogue current: aggregate the micro-batch, merge, write a new version."""
    from fleetlens.operators.history import catalog

    def merge(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        update = catalog(rows)
        current = None if batch_id == 0 else spark.read.parquet(f"{root}/v={batch_id - 1}")
        K.write_versioned(update if current is None else K.merge_catalog(current, update), root, batch_id)

    return (samples.writeStream.option("checkpointLocation", f"{root}-checkpoint").foreachBatch(merge)
            .trigger(availableNow=True).start())
