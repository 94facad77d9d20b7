"""Ordered computations per key that survive one key holding most of the rows.

A plain window puts every row of a key into one task. Here a key with more than
``target_rows`` rows is cut into consecutive time slices. Each slice is scanned on
its own, one summary row per slice carries the state across the cut, and the two
are joined on the partitioning the big side already has.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import broadcast_if_small, cut_lineage

TARGET_ROWS = 2_000_000
#: Slices per key, at most; a larger key gets larger slices.
MAX_SLICES = 1000
SLICE = "_slice"


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column


def lag(value) -> Step:
    """Value of the previous row."""
    return Step("lag", _col(value))


def lead(value) -> Step:
    """Value of the next row."""
    return Step("lead", _col(value))


def last_known(value) -> Step:
    """Latest non-null value up to and including this row."""
    return Step("last_known", _col(value))


def next_known(value) -> Step:
    """Earliest non-null value strictly after this row."""
    return Step("next_known", _col(value))


def running(value) -> Step:
    """Running sum up to and including this row (nulls count as 0)."""
    return Step("running", _col(value))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_micros(column) -> Column:
    """Microseconds since the epoch for a timestamp column, with or without zone."""
    return F.unix_micros(_col(column).cast("timestamp"))


@dataclass(frozen=True)
class Slices:
    """Cut plan for the keys that are too large for one task.

    ``hot`` has one row per such key: (keys..., _bounds), the positions at which its slices end. It has at most
    total rows / target_rows rows; it is broadcast only after a count.
    """

    hot: DataFrame
    keys: tuple[str, ...]

    def assign(self, df: DataFrame, position: Column) -> DataFrame:
        # equal positions share a slice; slices follow each other in order of position
        place = F.size(F.filter("_bounds", lambda b: b < position)).cast("long")
        return (
            df.join(broadcast_if_small(self.hot), list(self.keys), "left")
            .withColumn(SLICE, F.when(F.col("_bounds").isNull(), F.lit(0).cast("long")).otherwise(place))
            .drop("_bounds")
        )


def plan_slices(df: DataFrame, keys, position: Column, target_rows: int = TARGET_ROWS) -> Slices | None:
    """Find keys above ``target_rows`` and cut them at quantiles; None when every key fits in one task.

    Quantiles follow bursts and fractional positions alike. All cut keys get as many slices as the largest needs.
    Rows at one and the same position cannot be cut apart.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    placed = df.select(*keys, position.alias("_p"))
    sizes = cut_lineage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows))
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    parts = min(MAX_SLICES, -(-largest // target_rows))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    hot = placed.join(broadcast_if_small(sizes.select(*keys)), keys, "left_semi").groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_p", shares, 10 * MAX_SLICES)).alias("_bounds"))
    return Slices(cut_lineage(hot), tuple(keys))


def scan(
    df: DataFrame,
    keys,
    order,
    steps: dict[str, Step],
    position: Column | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Add one column per step, computed along ``order`` within ``keys``.

    ``order`` must be a total order within a key. ``position`` is the numeric form of
    the leading order column and is needed only together with ``slices``. A frame that
    already carries the slice column (from an earlier scan) is used as it is cut.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    if SLICE not in df.columns:
        if slices is None:
            return _local(df, keys, order, steps)
        df = slices.assign(df, position)
    return _sliced(df, keys, order, steps)


def drop_slice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


def _local(df: DataFrame, by: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    forward = Window.partitionBy(*by).orderBy(*order)
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    build = {
        "lag": lambda v: F.lag(v).over(forward),
        "lead": lambda v: F.lead(v).over(forward),
        "last_known": lambda v: F.last(v, ignorenulls=True).over(upto),
        "next_known": lambda v: F.last(v, ignorenulls=True).over(after),
        "running": lambda v: F.sum(F.coalesce(v, F.lit(0))).over(upto),
    }
    return df.withColumns({name: build[s.kind](s.value) for name, s in steps.items()})


def _sliced(df: DataFrame, keys: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    by = [*keys, SLICE]
    forward = Window.partitionBy(*by).orderBy(*order)
    values = {f"_v_{i}": s.value for i, s in enumerate(steps.values())}
    kinds = {f"_v_{i}": s.kind for i, s in enumerate(steps.values())}
    local_steps = {f"_l_{i}": s for i, s in enumerate(steps.values())}
    edge = {}
    if "lag" in kinds.values():
        edge["_first"] = F.row_number().over(forward) == 1
    if "lead" in kinds.values():
        edge["_last"] = F.lead(F.lit(1)).over(forward).isNull()

    at = F.struct(*order)
    pick = {
        # wrapped in a struct so that a null value at the edge is still carried
        "lag": lambda c: F.max_by(F.struct(F.col(c).alias("x")), at),
        "lead": lambda c: F.min_by(F.struct(F.col(c).alias("x")), at),
        "last_known": lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)),
        "next_known": lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)),
        "running": lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))),
    }
    summary = (
        df.select(*by, *order, *[v.alias(c) for c, v in values.items()])
        .groupBy(*by)
        .agg(*[pick[kinds[c]](c).alias(c) for c in values])
    )
    # One row per slice: a key contributes rows / target_rows of them.
    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "lag": lambda c: F.lag(c).over(along)["x"],
        "lead": lambda c: F.lead(c).over(along)["x"],
        "last_known": lambda c: F.last(c, ignorenulls=True).over(before),
        "next_known": lambda c: F.last(c, ignorenulls=True).over(behind),
        "running": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
    }
    carried = summary.select(*by, *[carry[kinds[c]](c).alias(c.replace("_v_", "_c_")) for c in values])

    local = _local(df, by, order, local_steps).withColumns(edge) if edge else _local(df, by, order, local_steps)
    merged = local.join(carried, by)
    out = {}
    for i, (name, step) in enumerate(steps.items()):
        here, from_before = F.col(f"_l_{i}"), F.col(f"_c_{i}")
        if step.kind == "lag":
            out[name] = F.when(F.col("_first"), from_before).otherwise(here)
        elif step.kind == "lead":
            out[name] = F.when(F.col("_last"), from_before).otherwise(here)
        elif step.kind == "running":
            out[name] = here + from_before
        else:
            out[name] = F.coalesce(here, from_before)
    drop = [*local_steps, *[f"_c_{i}" for i in range(len(steps))], *edge]
    return merged.withColumns(out).drop(*drop)


@functools.lru_cache(maxsize=256)
def _no_hot_keys(app_id: str, tag: str) -> dict:
    return {}


def plan_slices_once(tag: str, df: DataFrame, keys, position: Column, target_rows: int = TARGET_ROWS) -> Slices | None:
    """``plan_slices`` that remembers, per application, inputs found to have no hot key.

    An input is known by its files, so a table that has grown is looked at again.
    """
    files = hash(tuple(sorted(df.inputFiles())))
    memo = _no_hot_keys(df.sparkSession.sparkContext.applicationId, f"{tag}|{files}|{keys}|{target_rows}")
    if memo.get("fits"):
        return None
    slices = plan_slices(df, keys, position, target_rows)
    memo["fits"] = slices is None
    return slices
