"""Archive writers, catalogue merges, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_folder

# Tables whose rows a configuration-only snapshot leaves out.
HISTORY_TABLES = ("telemetry", "topic_samples")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder, removed when the application ends."""
    return scratch_folder(spark, name)


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows into day folders. Each task gets a range of (day, robot, time): it writes few days, a busy robot or
    day is spread over several tasks, and files hold narrow ranges for min/max pruning."""
    by_topic = ["topic"] if "topic" in df.columns else []
    rows = df.withColumn("day", F.to_date("ts")).repartitionByRange("day", "robot_id", "ts")
    (rows.sortWithinPartitions("day", "robot_id", *by_topic, "ts").write.mode(mode).partitionBy("day").parquet(path))


def append_events(df: DataFrame, path: str) -> None:
    """Audit rows are few and permanent: no day folders, never expired."""
    df.write.mode("append").parquet(path)


def merge_catalog(current: DataFrame, update: DataFrame) -> DataFrame:
    """Combine two catalogues; both sides are already one row per (robot, topic)."""
    both = current.unionByName(update)
    return both.groupBy("robot_id", "topic").agg(
        F.sum("samples").alias("samples"), F.max_by("last_value", "last_seen").alias("last_value"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("last_changed").alias("last_changed"))


def touch_last_seen(robots: DataFrame, rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Advance ``last_seen`` of the robots present in ``rows``."""
    seen = rows.groupBy(F.col("robot_id").alias("id")).agg(F.max(ts).alias("_seen"))
    old = F.col("last_seen") if "last_seen" in robots.columns else F.lit(None).cast("timestamp_ntz")
    return robots.join(seen, "id", "left").withColumn("last_seen", F.greatest(old, F.col("_seen"))).drop("_seen")


def write_versioned(df: DataFrame, root: str, version: int) -> None:
    """Replace a small table: write the new version whole, keyed by batch, so that a retry
    of the same batch overwrites itself."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    versions = list_children(spark, root)
    done = [v for v in versions if v.startswith("v=") and exists(spark, f"{root}/{v}/_SUCCESS")]
    if not done:
        return None
    return spark.read.parquet(f"{root}/{max(done, key=lambda v: int(v[2:]))}")


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def list_children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop_day(spark: SparkSession, path: str, day: str) -> bool:
    fs, p = _fs(spark, f"{path}/day={day}")
    return fs.delete(p, True)


NO_DAY = "day=__HIVE_DEFAULT_PARTITION__"


def apply_retention(spark: SparkSession, path: str, today: str, keep_days: int, fallback: str | None = None) -> list[str]:
    """Delete day folders older than ``today - keep_days``; returns the days dropped.

    Rows without a day lie in a folder of their own, which is never dropped whole: with ``fallback``, a column that
    tells their age (the time of arrival), those older than the limit are swept out of it.
    """
    import datetime as dt

    cutoff = dt.date.fromisoformat(today) - dt.timedelta(days=keep_days)
    days = [c[4:] for c in list_children(spark, path) if c.startswith("day=") and c != NO_DAY]
    expired = [d for d in days if dt.date.fromisoformat(d) < cutoff]
    dropped = [d for d in expired if drop_day(spark, path, d)]
    if fallback and exists(spark, f"{path}/{NO_DAY}"):
        sweep(spark, path, NO_DAY, F.to_date(fallback) < F.lit(cutoff.isoformat()).cast("date"))
    return dropped


def sweep(spark: SparkSession, path: str, folder: str, expired) -> int:
    """Remove the rows for which ``expired`` holds from one folder; returns how many files were rewritten.

    Only files that hold such rows are written anew, into a hidden folder together with the list of files that they
    replace. That list is the last thing written: from then on the swap is decided, and ``finish_sweeps`` completes it
    after a crash as well; without the list a hidden folder is rubbish. No row is lost or doubled.
    """
    import uuid

    finish_sweeps(spark, path)
    rows = spark.read.parquet(f"{path}/{folder}")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    touched = [r[0] for r in rows.filter(expired).select(name.alias("f")).distinct().collect()]  # one name per file
    if not touched:
        return 0
    kept = spark.read.parquet(*[f"{path}/{folder}/{f}" for f in touched]).filter(~F.coalesce(expired, F.lit(False)))
    staged = f"{path}/_swept-{uuid.uuid4().hex}"
    kept.write.parquet(f"{staged}/rows")
    spark.createDataFrame([(folder, f) for f in touched], "folder string, file string").coalesce(1).write.json(f"{staged}/replaces")
    finish_sweeps(spark, path)
    return len(touched)


def finish_sweeps(spark: SparkSession, path: str) -> None:
    """Complete the swaps of ``sweep`` that are decided, and remove those that are not."""
    for staged in [c for c in list_children(spark, path) if c.startswith("_swept-")]:
        base = f"{path}/{staged}"
        fs, _ = _fs(spark, path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        if exists(spark, f"{base}/replaces/_SUCCESS"):
            replaced = spark.read.schema("folder string, file string").json(f"{base}/replaces").collect()  # one row per file
            folder = replaced[0]["folder"]
            for r in replaced:
                fs.delete(hadoop(f"{path}/{folder}/{r['file']}"), False)
            for f in [c for c in list_children(spark, f"{base}/rows") if c.startswith("part-")]:
                fs.rename(hadoop(f"{base}/rows/{f}"), hadoop(f"{path}/{folder}/{f}"))
        fs.delete(hadoop(base), True)


def snapshot_export(tables: dict[str, DataFrame], root: str, stamp: str, with_history: bool = True) -> str:
    """Write every table under one stamped folder, plus a manifest."""
    spark = next(iter(tables.values())).sparkSession
    kind = "full" if with_history else "config"
    target = f"{root}/{kind}-{stamp}"
    for name, df in tables.items():
        empty = not with_history and name.startswith(HISTORY_TABLES)
        (df.limit(0) if empty else df).write.mode("overwrite").parquet(f"{target}/{name}")
    manifest = [(stamp, kind, name, df.schema.simpleString(), spark.read.parquet(f"{target}/{name}").count(),
                 stored_bytes(spark, f"{target}/{name}")) for name, df in tables.items()]
    spark.createDataFrame(manifest, "created string, kind string, table_name string, layout string, rows long, bytes long").coalesce(1).write.mode(
        "overwrite").json(f"{target}/manifest")
    return target


def snapshot_list(spark: SparkSession, root: str) -> list[str]:
    return [c for c in list_children(spark, root) if exists(spark, f"{root}/{c}/manifest/_SUCCESS")]


def snapshot_restore(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    names = [c for c in list_children(spark, target) if c != "manifest"]
    return {n: spark.read.parquet(f"{target}/{n}") for n in names}
