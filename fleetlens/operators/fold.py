"""Sequential state machines per key, exact even when one key spans many tasks.

The rows of a key are cut into the same time slices as everywhere else. A slice is folded
by a small step function starting from an assumed entry state; the exit state of a slice is
the entry of the next. Slices whose entry turned out different are folded again, until
nothing changes. State machines that forget quickly need two or three rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.sequence import SLICE, Slices
from fleetlens.session import broadcast_if_small, cut_lineage

Step = Callable[[tuple | None, tuple], tuple[tuple | None, tuple]]


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Step, state: T.StructType,
         output: T.StructType, position: Column | None = None, slices: Slices | None = None) -> DataFrame:
    """Add the ``output`` columns, computed by ``step(state, inputs) -> (state, outputs)``.

    ``state`` is None before the first row of a key, and its first field is never null
    afterwards. The step must be deterministic.
    """
    if slices is None:
        rows = df.withColumn(SLICE, F.lit(0).cast("long"))
        entries = None
    else:
        rows = slices.assign(df, position).withColumn(SLICE, F.col(SLICE).cast("long"))
        entries = _settle(rows, keys, order, inputs, step, state, slices)
    return _run(rows, entries, keys, order, inputs, step, state, output).drop(SLICE)


def _settle(rows, keys, order, inputs, step, state, slices) -> DataFrame:
    """Entry state per (key, slice) of the cut keys; all other keys have one slice."""
    by = [*keys, SLICE]
    hot = cut_lineage(rows.join(broadcast_if_small(slices.hot.select(*slices.keys)), list(slices.keys), "left_semi"))
    names = [f.name for f in state.fields]
    none = F.lit(None).cast(state)
    known = cut_lineage(hot.select(*by).distinct().withColumns({"entry": none, "exit": none, "stale": F.lit(True)}))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    while True:
        todo = known.filter("stale").select(*by, F.col("entry").alias("_entry"))
        redone = _exits(hot.join(todo, by), keys, order, inputs, step, state, names)
        merged = known.join(redone, by, "left").withColumn("exit", F.coalesce("_new", "exit")).drop("_new")
        moved = merged.withColumn("_in", F.lag("exit").over(along))
        known = cut_lineage(moved.select(*by, F.col("_in").alias("entry"), "exit",
                                         (~F.col("_in").eqNullSafe(F.col("entry"))).alias("stale")))
        if known.filter("stale").isEmpty():
            return known.select(*by, F.col("entry").alias("_entry"))


def _exits(rows, keys, order, inputs, step, state, names) -> DataFrame:
    """Exit state of each slice; a slice emits one row when its last row is folded."""
    by = [*keys, SLICE]
    schema = T.StructType([*[rows.schema[k] for k in by], *state.fields])
    width = len(by)
    picked = rows.select(*by, "_entry", *[F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)], *[c for c in order if c not in by])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, now, done = None, None, []
        for pdf in batches:
            for key, entry, row in _tuples(pdf, by, inputs, names):
                if key != group:
                    if group is not None:
                        done.append((*group, *(now or (None,) * len(names))))
                    group, now = key, entry
                now, _ = step(now, row)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=schema.names).astype(object)
                done = []
        if group is not None:
            done.append((*group, *(now or (None,) * len(names))))
        yield pd.DataFrame(done, columns=schema.names).astype(object)

    laid = picked.repartition(*by).sortWithinPartitions(*by, *order)
    out = laid.mapInPandas(run, schema)
    return out.select(*by, F.when(F.col(names[0]).isNotNull(), F.struct(*names)).alias("_new"))


def _run(rows, entries, keys, order, inputs, step, state, output) -> DataFrame:
    by = [*keys, SLICE]
    names = [f.name for f in state.fields]
    if entries is None:
        rows = rows.withColumn("_entry", F.lit(None).cast(state))
    else:
        rows = rows.join(entries, by, "left")
    laid = rows.repartition(*by).sortWithinPartitions(*by, *order)
    passed = [f for f in laid.schema.fields if f.name != "_entry"]
    laid = laid.select(*[f.name for f in passed], "_entry", *[F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*passed, *output.fields])
    kept = [f.name for f in passed]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, now = None, None
        for pdf in batches:
            made = []
            for key, entry, row in _tuples(pdf, by, inputs, names):
                if key != group:
                    group, now = key, entry
                now, out = step(now, row)
                made.append(out)
            result = pdf[kept].copy()
            for i, f in enumerate(output.fields):
                result[f.name] = pd.Series([m[i] for m in made], index=result.index, dtype=object)
            yield result

    return laid.mapInPandas(run, schema)


def _tuples(pdf: pd.DataFrame, by: list[str], inputs: list[str], names: list[str]):
    """(group key, entry state or None, input row) per row, with nulls as None."""
    keys = zip(*[pdf[c].tolist() for c in by])
    rows = zip(*[_plain(pdf[f"_i{i}"]) for i in range(len(inputs))])
    for key, entry, row in zip(keys, _entries(pdf["_entry"], names), rows):
        yield key, entry, row


def _plain(column: pd.Series) -> list:
    if column.dtype == object:
        return column.tolist()
    return column.astype(object).where(column.notna(), None).tolist()


def _entries(column, names: list[str]):
    if isinstance(column, pd.DataFrame):  # struct columns arrive as frames
        values = list(zip(*[_plain(column[n]) for n in names]))
        return [v if v[0] is not None else None for v in values]
    return [tuple(v[n] for n in names) if v is not None else None for v in column.tolist()]
