"""Stateful processors: one small record of state per key, kept in the state store.

Rows of one key arrive unordered inside a micro-batch and are sorted here; the size of a
micro-batch is bounded by the source's per-trigger limits, so the list is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators import alerts as A
from fleetlens.operators.presence import OFFLINE, OK, STALE, UNKNOWN
from fleetlens.operators.relay import SENT, sampler
from fleetlens.operators.state import START_AT_ZERO

#: Sequence numbers that are remembered together: delivered in a row, they cost one read and one write of state.
SEQ_BLOCK = 256
SEQS = T.StructType([T.StructField("boot", T.StringType()), T.StructField("block", T.LongType())])
SEEN = T.StructType([T.StructField("seq", T.ArrayType(T.LongType())), T.StructField("seen_ms", T.ArrayType(T.LongType()))])


class FirstDelivery(StatefulProcessor):
    """First delivery of each sequence number per robot and boot; rows without a boot or number pass.

    Numbers are remembered for ``keep_ms`` after they were first seen. Nothing is dropped for being late: a batch
    goes only if its number is remembered. Inside a micro-batch the earliest arrival wins, then the lesser topic.
    State is kept by blocks of numbers, read and written once per micro-batch.
    """

    def __init__(self, columns: list[str], keep_ms: int):
        self._columns, self._keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", SEQS, SEEN, self._keep_ms)
        self._row = Row(*self._columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known, changed = {}, set()
        for r in sorted(rows, key=lambda r: (r.recv_us, r.topic)):
            if r.boot is not None and r.seq is not None:
                block = (r.boot, r.seq // SEQ_BLOCK)
                if block not in known:
                    known[block] = self._load(block, now)
                if r.seq in known[block]:
                    continue
                known[block][r.seq] = now
                changed.add(block)
            yield self._row(*[r[c] for c in self._columns])
        for block in changed:
            self._seen.updateValue(block, (list(known[block]), list(known[block].values())))

    def _load(self, block, now) -> dict[int, int]:
        if not self._seen.containsKey(block):
            return {}
        seqs, times = self._seen.getValue(block)
        return {s: t for s, t in zip(seqs, times) if now - t < self._keep_ms}

    def close(self) -> None:
        pass


RELAY_OUT = T.StructType([
    T.StructField("robot_id", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("decision", T.StringType())])


class RelayProcessor(StatefulProcessor):
    """Sampling decisions per (robot, topic); remembers the last row sent."""

    def __init__(self, min_gap_s: float, heartbeat_s: float, deadband: float):
        self._args = (min_gap_s, heartbeat_s, deadband)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._step = sampler(*self._args)
        self._sent = handle.getValueState("sent", SENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self._sent.get()) if self._sent.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_us, r.event_id)):
            now, (decision,) = self._step(now, (r.at_us, r.num, r.payload))
            yield Row(robot_id=key[0], topic=key[1], event_id=r.event_id, decision=decision)
        self._sent.update(now)

    def close(self) -> None:
        pass


STATE_FIELDS = ["battery", "state", "v", "w", "temp", "wifi", "odom", "errors"]
TEXT_FIELDS = {"state", "errors", "mission"}


def state_struct(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType() if f in TEXT_FIELDS else T.DoubleType()) for f in fields])


def state_out(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField("robot_id", T.StringType()), T.StructField("event_id", T.LongType()),
                         T.StructField("ts", T.TimestampNTZType()), *state_struct(fields).fields])


class StateProcessor(StatefulProcessor):
    """Archived state rows per robot: each field is the last known value.

    With ``mission`` among the fields, rows also have ``mission_reset``: a mission given as an object, which sets or
    clears the progress and may have no name.
    """

    def __init__(self, fields: list[str] = STATE_FIELDS):
        self._fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", state_struct(self._fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = dict(zip(self._fields, self._known.get())) if self._known.exists() else dict.fromkeys(self._fields)
        make = Row(*state_out(self._fields).names)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            reset = "mission" in now and r.mission_reset
            for f in self._fields:
                value = r[f]
                if f == "progress" and "mission" in now:
                    if reset:
                        now[f] = value
                elif value is not None or f == "mission" and reset:
                    now[f] = min(100.0, max(0.0, value)) if f == "battery" else value
            yield make(key[0], r.event_id, r.ts, *[0.0 if v is None and f in START_AT_ZERO else v for f, v in now.items()])
        self._known.update(tuple(now.values()))

    def close(self) -> None:
        pass


#: Robots are dealt to so many groups; the presence of a group's robots is one record of state.
PRESENCE_GROUPS = 1024
#: Kinds of signals, data first: signals of one instant are taken in this order.
DATA, LINK_DOWN, LINK_UP, LINK_UNKNOWN = 0, 1, 2, 3
#: An instant before all others, for data never seen.
NEVER = -(1 << 62)
PRESENCES = [UNKNOWN, OK, STALE, OFFLINE]
#: Per robot: its name, the last instant looked at, the last data, the last link message, and the place in PRESENCES.
PRESENCE_STATE = T.StructType([
    T.StructField("robot_id", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("at_us", "seen_us", "link", "link_us", "presence")]])
PRESENCE_OUT = T.StructType([
    T.StructField("robot_id", T.StringType()), T.StructField("at_us", T.LongType()),
    T.StructField("presence", T.StringType()), T.StructField("before", T.StringType())])


def _last(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per place the value at the last place up to it where ``known`` is true; it must be at every robot's first."""
    return values[np.maximum.accumulate(np.where(known, np.arange(len(known)), 0))]


class PresenceProcessor(StatefulProcessor):
    """Presence changes of a group of robots.

    Decay between two signals is derived from the signals themselves, because a timer may
    fire only after a newer signal was seen; timers serve the silence that is still open.

    Calls of the state store, timers and rows in Python cost more than the decisions, so rows come by groups of robots
    and as columns; a group's state is read and written once per micro-batch, and it has one timer, the next that any
    of its robots needs.
    """

    def __init__(self, offline_after_s: float, stale_after_s: float):
        self._off_us, self._stale_us = int(offline_after_s * 1e6), int(stale_after_s * 1e6)
        # the state holds up to and including the limit, so it changes one microsecond later
        self._decay = np.array(sorted((self._off_us + 1, self._stale_us + 1)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("presence", PRESENCE_STATE)

    def _decide(self, at, seen, link, link_us):
        age, ever = at - seen, seen != NEVER
        silent = np.where(age <= self._off_us, PRESENCES.index(OK), np.where(age <= self._stale_us, PRESENCES.index(STALE), PRESENCES.index(OFFLINE)))
        down = (link == LINK_DOWN) & (link_us >= np.where(ever, seen, 0))
        return np.where(down, PRESENCES.index(OFFLINE), np.where(ever, silent, PRESENCES.index(UNKNOWN)))

    def _cuts(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two instants per state at which it may decay, whether they are still to come, and what it is then."""
        cuts = s["seen_us"][:, None] + self._decay
        now = self._decide(cuts, *[s[n][:, None] for n in ("seen_us", "link", "link_us")])
        return cuts, cuts > s["at_us"][:, None], now

    def _changes(self, names, robot, at, presence, told) -> Iterator[pd.DataFrame]:
        """Rows for states that are ``told`` and differ from the robot's one before; a robot's states are neighbours."""
        before = np.r_[-1, presence[:-1]]
        before[np.r_[True, robot[1:] != robot[:-1]]] = -1
        new = np.flatnonzero(told & (presence != before))
        if len(new):
            words = np.array([*PRESENCES, None], dtype=object)  # the last is the place -1
            yield pd.DataFrame({"robot_id": names[robot[new]], "at_us": at[new], "presence": words[presence[new]], "before": words[before[new]]})

    def _load(self) -> dict[str, np.ndarray]:
        held = self._state.get() if self._state.exists() else [[]] * len(PRESENCE_STATE)
        return {f.name: np.array(v, dtype=object if f.name == "robot_id" else np.int64) for f, v in zip(PRESENCE_STATE, held)}

    def _save(self, s: dict[str, np.ndarray]) -> None:
        self._state.update(tuple(s[n].tolist() for n in PRESENCE_STATE.names))
        cuts, to_come, _ = self._cuts(s)
        # timers count milliseconds; round up so that the limit has passed
        want = [-(-int(cuts[to_come].min()) // 1000)] if to_come.any() else []
        held = list(self._handle.listTimers())
        if held != want:
            for t in held:
                self._handle.deleteTimer(t)
            for t in want:
                self._handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, pdf = self._load(), pd.concat(list(rows), ignore_index=True)
        n, more = len(s["at_us"]), len(pdf)
        # what is held comes first for every robot, as a row of its own
        robot, names = pd.factorize(np.r_[s["robot_id"], pdf["robot_id"].to_numpy(dtype=object)], use_na_sentinel=False)
        names = np.where(pd.isna(names), None, names)
        ints = lambda c: pdf[c].to_numpy(dtype=np.int64)
        kind = np.r_[np.full(n, -1), ints("kind")]
        at, event = np.r_[s["at_us"], ints("at_us")], np.r_[np.zeros(n, np.int64), ints("event_id")]
        order = np.lexsort((event, kind > DATA, at, kind >= 0, robot))
        robot, kind, at = robot[order], kind[order], at[order]
        put = lambda c, values: np.r_[s[c], np.broadcast_to(values, more)][order]
        first = np.r_[True, robot[1:] != robot[:-1]]
        linked = first | (kind == LINK_DOWN) | (kind == LINK_UP)
        link = put("link", np.where(ints("kind") == DATA, LINK_UNKNOWN, ints("kind")))
        now = {"at_us": at, "seen_us": _last(put("seen_us", np.where(ints("kind") == DATA, ints("at_us"), NEVER)), first | (kind == DATA)),
               "link": _last(link, linked), "link_us": _last(put("link_us", ints("at_us")), linked)}
        held = kind < 0
        own = np.where(held, put("presence", 0), self._decide(at, now["seen_us"], now["link"], now["link_us"]))
        # before each row, what the silence since the row before did
        cuts, to_come, decayed = self._cuts({c: np.r_[v[:1], v[:-1]] for c, v in now.items()})
        keep = np.c_[to_come & (cuts < at[:, None]) & ~first[:, None], np.ones(len(at), bool)].ravel()
        flat = lambda a, b: np.c_[a, b].ravel()[keep]
        whose, told = np.repeat(robot, 3)[keep], np.repeat(~held, 3)[keep]
        yield from self._changes(names, whose, flat(cuts, at), flat(decayed, own), told)
        ends = np.flatnonzero(np.r_[robot[1:] != robot[:-1], True])
        self._save({"robot_id": names[robot[ends]], **{c: v[ends] for c, v in now.items()}, "presence": own[ends]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        cuts, to_come, decayed = self._cuts(s)
        due = to_come & (cuts <= limit)
        keep, told = np.c_[np.ones(len(due), bool), due].ravel(), np.c_[np.zeros(len(due), bool), due].ravel()
        robot = np.repeat(np.arange(len(due)), 3)
        at, presence = np.c_[s["at_us"], cuts].ravel(), np.c_[s["presence"], decayed].ravel()
        yield from self._changes(s["robot_id"], robot[keep], at[keep], presence[keep], told[keep])
        ends = np.flatnonzero(np.r_[robot[keep][1:] != robot[keep][:-1], True])
        self._save({**s, "at_us": at[keep][ends], "presence": presence[keep][ends]})

    def close(self) -> None:
        pass


ALERT_OUT = T.StructType([
    T.StructField("rule_id", T.IntegerType()), T.StructField("robot_id", T.StringType()), T.StructField("at_us", T.LongType()),
    T.StructField("num", T.StringType()), T.StructField("mark", T.StringType())])
#: Robots are dealt to so many groups; the alerts of a group's robots are one record of state.
ALERT_GROUPS = 4096
ALERT_KEYS = T.StructType([T.StructField("rule_id", T.IntegerType()), T.StructField("robot_id", T.StringType())])
ALERTS = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*ALERT_KEYS.fields, *A.STRICT.fields]])


class AlertProcessor(StatefulProcessor):
    """ok -> pending -> firing -> ok per (rule, robot); emits start, repeat and stop marks.

    A call of the state store and a group of rows cost more than many steps of the alerts themselves, so rows come by
    groups of robots and as columns; a group's state is read and written once per micro-batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._alerts = handle.getValueState("alerts", ALERTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {(rule, robot): now for rule, robot, *now in zip(*self._alerts.get())} if self._alerts.exists() else {}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "event_id"], kind="stable", ignore_index=True)
        places, marks = [], []
        columns = [pdf[c].tolist() for c in ("rule_id", "robot_id", "at_us", "hit", "hold", "for_seconds", "cool_us")]
        for place, (rule, robot, *row) in enumerate(zip(*columns)):
            known[rule, robot], (mark,) = A.alert_step(known.get((rule, robot)), row)
            if mark is not None:
                places.append(place)
                marks.append(mark)
        self._alerts.update(tuple(list(c) for c in zip(*[(*k, *now) for k, now in known.items()])))
        yield pdf.loc[places, ["rule_id", "robot_id", "at_us", "num"]].assign(mark=pd.Series(marks, index=places, dtype=object))

    def close(self) -> None:
        pass
