"""Last-known state per robot and the audit trail derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.sequence import Slices, drop_slice, lag, last_known, running, scan
from fleetlens.functions.scalars import micros

# Fields a fresh robot starts with, and the states that count as faults.
START_AT_ZERO = ["x", "y", "yaw", "v", "w"]
FAULT_STATES = ["error", "estop"]


def locf_state(df: DataFrame, fields: list[str], order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Replace each field by its last known value; the archive stores state, not messages.

    Battery is clipped to 0..100. A mission given as an object also resets the progress.
    """
    if "battery" in fields:
        df = df.withColumn("battery", F.when(F.col("battery").isNotNull(),
                                             F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("battery")))))
    steps = {f"_k_{f}": last_known(f) for f in fields if f not in ("mission", "progress")}
    if "mission" in fields:
        said = F.col("mission").isNotNull() | F.col("mission_reset")
        steps["_k_mission"] = last_known(F.when(said, F.struct(F.col("mission").alias("x"))))
        steps["_k_progress"] = last_known(F.when(F.col("mission_reset"), F.struct(F.col("progress").alias("x"))))
    df = drop_slice(scan(df, "robot_id", list(order), steps, micros("ts"), slices))
    out = {}
    for name in steps:
        field = name[3:]
        value = F.col(name)["x"] if field in ("mission", "progress") else F.col(name)
        out[field] = F.coalesce(value, F.lit(0.0)) if field in START_AT_ZERO else value
    return df.withColumns(out).drop(*steps)


def state_transitions(df: DataFrame, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """One row per change of ``state``; the first state of a robot is no change."""
    df = drop_slice(scan(df, "robot_id", list(order), {"from_state": lag("state")}, micros("ts"), slices))
    return (df.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("state")))
            .withColumn("severity", F.when(F.col("state").isin(FAULT_STATES), "warn").otherwise("info"))
            .withColumnRenamed("state", "to_state"))


def error_transitions(df: DataFrame, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """One row per change of the error list; clearing is reported, but not on the first sample."""
    steps = {"_before": lag("errors"), "_seen": lag(F.lit(True))}
    df = drop_slice(scan(df, "robot_id", list(order), steps, micros("ts"), slices))
    empty = F.col("errors") == ""
    changed = F.col("errors") != F.coalesce(F.col("_before"), F.lit(""))
    return (df.filter(changed & (~empty | F.col("_seen").isNotNull()))
            .withColumns({"cleared": empty, "severity": F.when(empty, "info").otherwise("critical")})
            .drop("_before", "_seen"))


def merge_extra(df: DataFrame, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Unknown keys merged over time, in long form: one row per (robot, key, change).

    The value of a key at any time is the latest row at or before it. A map per message
    would repeat every key on every row, so the merged map is built on read only.
    """
    rows = df.select("robot_id", *order, F.explode("extra").alias("key", "value"))
    rows = drop_slice(scan(rows, ["robot_id", "key"], list(order), {"_before": lag(F.struct("value"))}, micros("ts"), slices))
    return rows.filter(F.col("_before").isNull() | ~F.col("_before")["value"].eqNullSafe(F.col("value"))).drop("_before")


def latest_extra(df: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Current merged extra keys, one row per (robot, key)."""
    rows = df.select("robot_id", *order, F.explode("extra").alias("key", "value"))
    return rows.groupBy("robot_id", "key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def change_only(df: DataFrame, keys, value: str, order=("ts", "event_id"), slices: Slices | None = None) -> DataFrame:
    """Drop repeats of the previous value."""
    df = drop_slice(scan(df, keys, list(order), {"_before": lag(F.struct(F.col(value).alias("x")))}, micros("ts"), slices))
    return df.filter(F.col("_before").isNull() | ~F.col("_before")["x"].eqNullSafe(F.col(value))).drop("_before")


def number_rows(df: DataFrame, keys, order, name: str, slices: Slices | None = None) -> DataFrame:
    """Revision number per key: 1, 2, 3, ... along ``order``."""
    return drop_slice(scan(df, keys, list(order), {name: running(F.lit(1))}, micros(order[0]), slices))
