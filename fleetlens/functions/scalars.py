"""Scalar functions over columns. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings vendors use for booleans, and the longest text read as a number.
TRUE_WORDS = ["true", "1", "on", "yes", "t"]
FALSE_WORDS = ["false", "0", "off", "no", "f"]
NUMBER_TEXT_MAX = 32

DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ROBOT_ID = r"^[a-z0-9][a-z0-9_-]{1,62}$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly values: a later filter on them, or on what is made of them, is not moved below.

    The optimizer copies the definition of a column into every place of a filter that it moves down, so that a text
    would be parsed anew for each of them. It moves nothing below a generator.
    """
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made.alias("_once"))
    return df.withColumns({k: F.col(f"_once.{k}") for k in columns}).drop("_once")


def strip(c) -> Column:
    """Remove blanks, tabs and line ends from both ends."""
    return F.trim(col(c), F.lit(" \t\r\n\f\v"))


def finite(c) -> Column:
    """The double, or null for NaN and the infinities."""
    # NaN sorts above infinity, so one comparison rules out all three
    return F.when(F.abs(col(c)) < F.lit(float("inf")), col(c))


def decimal_text(c) -> Column:
    """Double for plain decimal text; null for suffixes, words and separators."""
    # the cast trims by itself
    return finite(F.when(col(c).rlike(DECIMAL_TEXT), col(c).try_cast("double")))


def to_numeric(c) -> Column:
    """A double for yes/no words (1 and 0) and short decimal texts, null for anything else."""
    text = strip(c)
    low = F.lower(text)
    return F.when((text != "") & (F.length(text) <= NUMBER_TEXT_MAX),
                  F.when(low.isin(TRUE_WORDS), F.lit(1.0))
                  .when(low.isin(FALSE_WORDS), F.lit(0.0))
                  .otherwise(decimal_text(text)))


def finite_or_default(c, default: float | None = None) -> Column:
    return F.coalesce(decimal_text(c), F.lit(default).cast("double"))


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds as a double, exact to the microsecond."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def from_micros(us) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def bucket_start(ts, seconds: float) -> Column:
    """Start of the fixed-width bucket holding ``ts``; buckets count from the epoch."""
    width = max(int(round(seconds * 1e6)), 1)
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(width)))


def parse_time(c) -> Column:
    """Time given as epoch seconds or ISO-8601; a naive time is UTC. Null if neither."""
    number = decimal_text(c)
    iso = F.when(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}"), strip(c).try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros(F.round(number * 1e6).cast("bigint")), iso).cast("timestamp_ntz")


def human_bytes(c) -> Column:
    """1023 -> '1023 B'; above that two decimals under ten, else one."""
    n = col(c).cast("double")
    step = F.when(n < 1024.0**2, 1).when(n < 1024.0**3, 2).when(n < 1024.0**4, 3).otherwise(4)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KB", "MB", "GB", "TB")]), step)
    scaled = n / F.pow(F.lit(1024.0), step)
    fixed = F.when(scaled < 10, F.format_string("%.2f", scaled)).otherwise(F.format_string("%.1f", scaled))
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).otherwise(
        F.concat_ws(" ", fixed, unit))


def human_age(c) -> Column:
    """Seconds, minutes or hours in short form."""
    s = col(c)
    return (F.when(s < 60, F.concat(F.format_string("%.0f", s), F.lit("s")))
            .when(s < 3600, F.concat(F.format_string("%.0f", s / 60), F.lit(" min")))
            .otherwise(F.concat(F.format_string("%.1f", s / 3600), F.lit(" h"))))


def truncate_text(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def format_time(c) -> Column:
    return F.date_format(col(c), "MM-dd HH:mm:ss")


def same_value(a_num, b_num, a_text, b_text, deadband: float) -> Column:
    """Numbers within the deadband, or equal texts; booleans compare as text."""
    a_num, b_num = col(a_num), col(b_num)
    return F.when(a_num.isNotNull() & b_num.isNotNull(), F.abs(a_num - b_num) <= deadband).otherwise(
        col(a_text).eqNullSafe(col(b_text)))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def slug(c) -> Column:
    """Identifier made from a display name; null when nothing usable is left."""
    dashed = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "-")
    return F.nullif(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 63), F.lit(""))


def valid_robot_id(c) -> Column:
    return col(c).rlike(ROBOT_ID)


def round_half_even(c, n: int) -> Column:
    return F.bround(col(c), n)
