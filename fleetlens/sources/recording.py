"""Full-rate recordings: gzip JSON lines of time, name and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros

LINE_SCHEMA = "t double, n string, v string, _bad string"


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Good lines of all recordings under ``path``; torn lines and torn archives are skipped."""
    raw = (spark.read.schema(LINE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .option("ignoreCorruptFiles", "true").json(path))
    return raw.filter("_bad is null and n is not null").drop("_bad")


def as_lines(df: DataFrame, topic: str = "topic", value: str = "num") -> DataFrame:
    return df.select((micros("ts") / 1e6).alias("t"), F.col(topic).alias("n"), F.col(value).alias("v"))


def write_recording(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append lines as rotated gzip files; rotation is by row count per file."""
    (df.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).json(path))
