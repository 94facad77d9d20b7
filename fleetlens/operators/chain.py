"""Greedy sampling along ordered rows: each row that is sent decides which row is sent next.

A row is sent if it comes ``gap`` after the last sent one and differs from it, or comes ``beat`` after it. So every
row has one successor, the row that would be sent after it; successors of all rows of a block are found at once, and
following them by doubling gives the rows sent. Nothing is stepped through row by row.

A key cut into slices takes a fixed number of jobs. Each slice reports the states in which it can be left, each of
these is looked up in the slices that its successor can lie in, and walking these few links gives the state in which
every slice is entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.sequence import SLICE, Slices
from fleetlens.session import broadcast_if_small, cut_lineage

FIRST, CHANGE, HEARTBEAT, RATE, SAME = "first", "change", "heartbeat", "rate", "same"
NAMES = (FIRST, CHANGE, HEARTBEAT, RATE, SAME)
#: Rows handled at once, beyond one key's (slice's) rows.
BLOCK = 50_000
STATE = ["_at", "_num", "_code", "_gap"]
STATE_DDL = "_at long, _num double, _code long, _gap long"


@dataclass(frozen=True)
class Rule:
    beat_us: int = 0  # 0: no heartbeat
    deadband: float = 0.0
    on_change: bool = True


@dataclass
class States:
    """Times, numbers (NaN for none), hashes of texts, and gaps."""

    at: np.ndarray
    num: np.ndarray
    code: np.ndarray
    gap: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, names: list[str] = STATE) -> States:
        at, num, code, gap = (batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names)
        return cls(at, num.astype(float), code, gap)

    def take(self, i: np.ndarray) -> States:
        return States(self.at[i], self.num[i], self.code[i], self.gap[i])


def _ends_of_runs(values: np.ndarray) -> np.ndarray:
    """Per element the place after its run of equal values."""
    cuts = np.r_[np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(0, np.int64)
    return np.repeat(cuts, np.diff(np.r_[0, cuts]))


class Rows:
    """A block of rows of whole groups, in order; ``begin`` are the places where groups begin."""

    def __init__(self, states: States, begin: np.ndarray, rule: Rule):
        self.s, self.rule, self.n = states, rule, len(states.at)
        self.begin = begin
        self.end = np.r_[begin[1:], self.n]
        self.group = np.repeat(np.arange(len(begin)), self.end - begin)
        # one rising line of times for all groups
        spans = states.at[self.end - 1] - states.at[begin] + 1
        self.shift = np.cumsum(spans) - spans - states.at[begin]
        self.line = states.at + self.shift[self.group]
        self.numeric, self.other = np.flatnonzero(~np.isnan(states.num)), np.flatnonzero(np.isnan(states.num))
        self.code_runs, self.other_runs = _ends_of_runs(states.code), _ends_of_runs(states.code[self.other])
        self.num_runs = _ends_of_runs(states.num[self.numeric])
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _next_different(self, places: np.ndarray, values: np.ndarray, runs: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First of ``places`` from ``start`` on whose value is another; ``n`` if there is none."""
        out, k = np.full(len(start), self.n), np.searchsorted(places, start)
        inside = np.flatnonzero(k < len(places))
        k = k[inside]
        k = np.where(values[k] != value[inside], k, runs[k])
        out[inside] = np.where(k < len(places), places[np.minimum(k, len(places) - 1)], self.n)
        return out

    def _next_outside(self, start: np.ndarray, stop: np.ndarray, num: np.ndarray) -> np.ndarray:
        """First row from ``start`` on, ``stop`` at most, that is further than the deadband from ``num``."""
        widest = int((stop - start).max(initial=0))
        if not self.levels:
            self.levels.append((np.where(np.isnan(self.s.num), -np.inf, self.s.num), np.where(np.isnan(self.s.num), np.inf, self.s.num)))
        while 2 << (len(self.levels) - 1) <= min(widest, self.n):
            high, low = self.levels[-1]
            half = 1 << (len(self.levels) - 1)
            self.levels.append((np.maximum(high[:-half], high[half:]), np.minimum(low[:-half], low[half:])))
        at, d = start.copy(), self.rule.deadband
        for k in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[k]
            i = np.flatnonzero(at + (1 << k) <= stop)
            near = (high[at[i]] - num[i] <= d) & (num[i] - low[at[i]] <= d)
            at[i[near]] += 1 << k
        return at

    def sent_after(self, q: States, group: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Per state, of a group, the first row from ``least`` on that is sent after it; -1 if none is."""
        end, base = self.end[group], q.at + self.shift[group]
        clip = lambda x: np.minimum(np.maximum(np.searchsorted(self.line, base + x), least), end)
        found = clip(q.gap)
        if self.rule.on_change:
            stop = np.maximum(found, clip(self.rule.beat_us)) if self.rule.beat_us else end
            other = np.full(len(found), self.n)
            word = np.isnan(q.num)
            i = np.flatnonzero(word)
            other[i] = self._next_different(np.arange(self.n), self.s.code, self.code_runs, found[i], q.code[i])
            i = np.flatnonzero(~word)
            other[i] = self._next_different(self.other, self.s.code[self.other], self.other_runs, found[i], q.code[i])
            if self.rule.deadband > 0:
                far = self._next_outside(found[i], stop[i], q.num[i])
            else:
                far = self._next_different(self.numeric, self.s.num[self.numeric], self.num_runs, found[i], q.num[i])
            other[i] = np.minimum(other[i], far)
            found = np.minimum(stop, other)
        return np.where(found < end, found, -1)

    def successors(self) -> np.ndarray:
        return self.sent_after(self.s, self.group, np.arange(self.n) + 1)

    def decisions(self, entry: States | None, entered: np.ndarray) -> np.ndarray:
        """Per row the place in NAMES of what happens to it; ``entered`` tells groups that begin in a state of ``entry``."""
        start = self.begin.copy()
        if entered.any():
            g = np.flatnonzero(entered)
            start[g] = self.sent_after(entry.take(g), g, self.begin[g])
        jump = np.r_[np.where((nxt := self.successors()) < 0, self.n, nxt), self.n]
        sent = np.zeros(self.n + 1, bool)
        chain = np.where(start < 0, self.n, start)
        while len(chain):  # twice as many steps every time
            sent[chain] = True
            more = np.unique(jump[np.flatnonzero(sent)])
            chain = more[~sent[more]]
            jump = jump[jump]
        sent = sent[:-1]
        before = np.maximum.accumulate(np.r_[-1, np.where(sent, np.arange(self.n), -1)[:-1]])
        own = before >= self.begin[self.group]
        s = self.s.take(np.maximum(before, 0))
        state, known = s, own
        if entered.any():
            e, use = entry.take(self.group), ~own & entered[self.group]
            state = States(*[np.where(use, x, y) for x, y in ((e.at, s.at), (e.num, s.num), (e.code, s.code), (e.gap, s.gap))])
            known = own | use
        both = ~np.isnan(self.s.num) & ~np.isnan(state.num)
        same = np.where(both, np.abs(self.s.num - state.num) <= self.rule.deadband, self.s.code == state.code)
        idle = np.where(self.s.at - state.at < self.s.gap, NAMES.index(RATE), NAMES.index(SAME))
        told = np.where(same & self.rule.on_change, NAMES.index(HEARTBEAT), NAMES.index(CHANGE))
        return np.where(~known, NAMES.index(FIRST), np.where(sent, told, idle))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups; a group begins where ``_first`` is true."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if rows + batch.num_rows > BLOCK and len(begins):
            cut = int(begins[-1])
            if rows + cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _laid(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows by group in order, with a mark at each group's first row: the window lays them out."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def sampled(df: DataFrame, keys: list[str], order: list[str], at: Column, num: Column, text: Column, gap_us: Column, rule: Rule,
            slices: Slices | None = None, unused: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``decision``: first, change or heartbeat for rows that are sent, rate or same for those that are not.

    ``at`` is the time in microseconds, along which ``order`` runs; ``gap_us`` must not change within a key. Rows with
    numbers are compared as numbers, others by a 64-bit hash of their texts. Columns of df keep their values; rows
    without a number and a text are equal to each other. ``unused`` columns are left out, and do not go through Python.
    """
    code = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
    rows = df.withColumns({"_at": at, "_num": num.cast("double"), "_code": code, "_gap": gap_us.cast("long")})
    by, entries = list(keys), None
    if slices is not None:
        rows = slices.assign(rows, at).withColumn(SLICE, F.col(SLICE).cast("long"))
        by.append(SLICE)
        entries = _entries(rows, keys, order, rule, slices)
    names = [c for c in rows.columns if c not in STATE and c not in unused]
    rows = rows.select(*dict.fromkeys([*names, *order, *STATE]))
    laid = _laid(rows, by, order)
    if entries is not None:
        laid = _laid(rows.join(entries, by, "left"), by, order)
    schema = T.StructType([*[laid.schema[n] for n in names], T.StructField("decision", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(NAMES)
        for block in _blocks(batches):
            begin = np.flatnonzero(block.column("_first").to_numpy())
            entry, entered = None, np.zeros(len(begin), bool)
            if "_entry_at" in block.column_names:
                heads = block.take(begin)
                entered = heads.column("_entry_at").is_valid().to_numpy()
                entry = States.of(heads, [f"_entry{c}" for c in STATE])
            made = Rows(States.of(block), begin, rule).decisions(entry, entered)
            out = block.select(names).append_column("decision", labels.take(pa.array(made)))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return laid.mapInArrow(run, schema).drop(SLICE)


def _entries(rows: DataFrame, keys: list[str], order: list[str], rule: Rule, slices: Slices) -> DataFrame:
    """(keys, slice, _entry...): the state in which each slice of a cut key is entered; none for a key's first slice."""
    by = [*keys, SLICE]
    hot = rows.join(broadcast_if_small(slices.hot.select(*slices.keys)), list(slices.keys), "left_semi").select(*by, *order, *STATE)
    hot = hot.select(*dict.fromkeys([*by, *order, *STATE]))
    key_fields = [hot.schema[k] for k in by]
    state_fields = list(T.StructType.fromDDL(STATE_DDL).fields)

    # the states in which a slice can be left, from any row that may be its first sent one
    exits_schema = T.StructType([*key_fields, *state_fields, T.StructField("_from_first", T.BooleanType())])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            begin = np.flatnonzero(block.column("_first").to_numpy())
            r = Rows(States.of(block), begin, rule)
            last = np.where((nxt := r.successors()) < 0, np.arange(r.n), nxt)
            while not np.array_equal(last, after := last[last]):
                last = after
            maybe = np.ones(r.n, bool)
            if rule.beat_us or not rule.on_change:
                maybe = r.s.at <= r.s.at[r.begin][r.group] + np.maximum(r.s.gap, rule.beat_us if rule.on_change else 0)
            places = np.unique(np.r_[last[maybe], last[r.begin]])
            some = block.take(places).select([*by, *STATE])
            yield from some.append_column("_from_first", pa.array(np.isin(places, last[r.begin]))).combine_chunks().to_batches()

    left = cut_lineage(_laid(hot, by, order).mapInArrow(exits, exits_schema))
    spans = hot.groupBy(*by).agg(F.max("_at").alias("_hi"))
    spans = cut_lineage(spans.withColumn("_prev", F.lag("_hi").over(Window.partitionBy(*keys).orderBy(SLICE))))

    # each state meets the slices that its successor can lie in, up to the first one that surely has it
    surely = F.col("_at") + F.greatest(F.col("_gap"), F.lit(rule.beat_us if rule.on_change else 0))
    meets = F.col("_hi") >= F.col("_at") + F.col("_gap")
    if rule.beat_us or not rule.on_change:
        meets = meets & (F.coalesce("_prev", F.lit(-(1 << 62))) < surely)
    to = spans.withColumnRenamed(SLICE, "_to")
    asked = left.withColumnRenamed(SLICE, "_of").join(to, list(keys)).filter((F.col("_to") > F.col("_of")) & meets)
    asked = asked.select(*keys, F.col("_to").alias(SLICE), *STATE, "_of", F.lit(0).alias("_kind")).distinct()
    reached = asked.select(*by).distinct()
    both = hot.join(reached, by, "left_semi").withColumn("_kind", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    links_schema = T.StructType([*key_fields, T.StructField("_of", T.LongType()), *state_fields,
                                 *[T.StructField(f"_next{f.name}", f.dataType) for f in state_fields]])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            first, kind = block.column("_first").to_numpy(), block.column("_kind").to_numpy()
            group = np.cumsum(first) - 1
            asking, real = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(asking) or not len(real):
                continue
            begin = np.flatnonzero(np.r_[True, group[real][1:] != group[real][:-1]])
            r = Rows(States.of(block.take(real)), begin, rule)
            last = np.where((nxt := r.successors()) < 0, np.arange(r.n), nxt)
            while not np.array_equal(last, after := last[last]):
                last = after
            own = np.searchsorted(group[real][begin], group[asking])
            hit = r.sent_after(States.of(block.take(asking)), own, r.begin[own])
            good = np.flatnonzero(hit >= 0)
            if len(good):
                out = block.take(asking[good]).select([*by, "_of", *STATE])
                target = block.take(real[last[hit[good]]]).select(STATE)
                for c in STATE:
                    out = out.append_column(f"_next{c}", target.column(c))
                yield from out.combine_chunks().to_batches()

    linked = _laid(both, by, ["_kind", *order]).mapInArrow(links, links_schema)
    linked = linked.groupBy(*keys, "_of", *STATE).agg(F.min_by(F.struct(F.col(SLICE).alias("_to"), *[f"_next{c}" for c in STATE]), SLICE).alias("_l"))
    nodes = linked.select(*keys, F.col("_of").alias(SLICE), *STATE, F.lit(1).alias("_what"), "_l.*")
    starts = left.filter("_from_first").select(*by, *STATE, F.lit(0).alias("_what"))
    stops = spans.select(*by, F.lit(2).alias("_what"))
    graph = nodes.unionByName(starts, allowMissingColumns=True).unionByName(stops, allowMissingColumns=True)
    entry_schema = T.StructType([*key_fields, *[T.StructField(f"_entry{f.name}", f.dataType) for f in state_fields]])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Follows one key's links from its first slice on; there are as many as states that slices can be left in."""
        state = lambda r, c="": tuple(None if pd.isna(r[f"{c}{n}"]) else r[f"{c}{n}"] for n in STATE)
        ends = sorted(pdf.loc[pdf["_what"] == 2, SLICE])
        edges = {state(r): (r["_to"], state(r, "_next")) for r in pdf[pdf["_what"] == 1].to_dict("records")}
        begin = pdf[(pdf["_what"] == 0) & (pdf[SLICE] == ends[0])].to_dict("records")
        now, made = state(begin[0]), []
        for s in ends[1:]:
            while now in edges and edges[now][0] < s:
                now = edges[now][1]
            made.append((*[pdf[k].iloc[0] for k in keys], s, *now))
        return pd.DataFrame(made, columns=entry_schema.names)

    return cut_lineage(graph.groupBy(*keys).applyInPandas(walk, entry_schema))
