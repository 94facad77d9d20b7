"""Source-side sampling: rate cap, change test, heartbeat; and what a relay costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.scalars import micros
from fleetlens.operators.chain import FIRST, Rule, sampled
from fleetlens.operators.sequence import Slices, drop_slice, lag, scan

# Defaults of the sampler and the measured storage cost of a row.
MAX_RATE_HZ = 5.0
HEARTBEAT_S = 60.0
BYTES_PER_ROW = 170.0
SENT_CHANGE, SENT_HEARTBEAT, SKIPPED_RATE, SKIPPED_SAME = "change", "heartbeat", "rate", "same"

SENT = T.StructType([T.StructField("sent_us", T.LongType()), T.StructField("sent_num", T.DoubleType()),
                     T.StructField("sent_text", T.StringType())])


def sampler(min_gap_s: float, heartbeat_s: float, deadband: float, on_change_only: bool = True):
    """Step function: the last sent (time, number, text) and a row -> what happens to the row."""
    gap_us, beat_us = int(min_gap_s * 1e6), int(heartbeat_s * 1e6)

    def step(sent, row):
        at, num, text = row
        if sent is None:
            return (at, num, text), (SENT_CHANGE,)
        if at - sent[0] < gap_us:
            return sent, (SKIPPED_RATE,)
        same = abs(num - sent[1]) <= deadband if num is not None and sent[1] is not None else text == sent[2]
        if same and on_change_only:
            if not beat_us or at - sent[0] < beat_us:
                return sent, (SKIPPED_SAME,)
            return (at, num, text), (SENT_HEARTBEAT,)
        return (at, num, text), (SENT_CHANGE,)

    return step


def relay_decisions(df: DataFrame, keys: list[str], num: str, text: str, order=("ts", "event_id"),
                    min_gap_s: float = 1 / MAX_RATE_HZ, heartbeat_s: float = HEARTBEAT_S, deadband: float = 0.0,
                    slices: Slices | None = None, unused: tuple[str, ...] = ()) -> DataFrame:
    """Add ``decision`` to every row. Each decision depends on the last row sent."""
    rule = Rule(int(heartbeat_s * 1e6), deadband)
    out = sampled(df, keys, list(order), micros("ts"), F.col(num), F.col(text), F.lit(int(min_gap_s * 1e6)), rule, slices, unused)
    return out.replace(FIRST, SENT_CHANGE, ["decision"])


def throttle(df: DataFrame, keys: list[str], min_gap_s: float, order=("ts", "event_id"),
             slices: Slices | None = None) -> DataFrame:
    """Rate cap only: keep a row when the last kept one is at least ``min_gap_s`` older."""
    none = F.lit(None)
    out = sampled(df, keys, list(order), micros("ts"), none, none.cast("string"), F.lit(int(min_gap_s * 1e6)), Rule(on_change=False), slices)
    return out.filter(F.col("decision") != SKIPPED_RATE).drop("decision")


def relay_counters(decided: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("decision")
    return decided.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(d.isin(SENT_CHANGE, SENT_HEARTBEAT)).alias("relayed"),
        F.count_if(d == SENT_HEARTBEAT).alias("heartbeats"), F.count_if(d == SKIPPED_RATE).alias("skipped_rate"),
        F.count_if(d == SKIPPED_SAME).alias("skipped_same"))


def topic_profile(df: DataFrame, keys: list[str], payload: str = "payload", binary: Column | None = None,
                  order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Count, rate, mean size, changes and last value per topic."""
    rows = df.withColumn("_binary", F.lit(False) if binary is None else binary)
    rows = drop_slice(scan(rows, keys, list(order), {"_before": lag(F.struct(F.col(payload).alias("x")))}, micros("ts"), slices))
    changed = F.col("_before").isNotNull() & ~F.col("_before")["x"].eqNullSafe(F.col(payload))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.min(micros("ts")).alias("_lo"), F.max(micros("ts")).alias("_hi"),
        F.round(F.avg(F.octet_length(payload)), 6).alias("avg_bytes"), F.count_if(changed).alias("changes"),
        F.bool_or("_binary").alias("is_binary"), F.max_by(payload, F.struct(*order)).alias("last_value"))
    span_s = F.greatest((F.col("_hi") - F.col("_lo")) / F.lit(1e6), F.lit(1e-6))
    return out.withColumn("hz", F.when(F.col("samples") > 1, (F.col("samples") - 1) / span_s).otherwise(0.0)).drop("_lo", "_hi")


def relay_cost(profile: DataFrame, max_rate_hz: float = MAX_RATE_HZ, on_change_only: bool = True, keys: list[str] = ()) -> DataFrame:
    """Rows per second and storage the selected topics will cost."""
    rate = F.least(F.col("hz"), F.lit(max_rate_hz))
    if on_change_only:
        rate = F.when(F.col("samples") > 1, rate * F.col("changes") / (F.col("samples") - 1)).otherwise(rate)
    out = profile.groupBy(*keys).agg(F.sum(rate).alias("rows_per_s"))
    day = F.col("rows_per_s") * BYTES_PER_ROW * 86400 / 1e9
    return out.withColumns({"gb_per_day": day, "gb_per_month": day * 30})


def map_fields(df: DataFrame, field_of: dict[str, str], order=("ts", "event_id")) -> DataFrame:
    """Latest value of each mapped topic, one status row per robot."""
    fields = sorted(set(field_of.values()))
    aggs = []
    for f in fields:
        mine = F.col("topic").isin([t for t, name in field_of.items() if name == f])
        aggs.append(F.max_by(F.when(mine, F.col("num")), F.when(mine, F.struct(*order))).alias(f))
    return df.filter(F.col("topic").isin(list(field_of))).groupBy("robot_id").agg(*aggs)
