"""Bounded buffers during outages against a deque."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.scalars import micros
from fleetlens.operators import quality as Q
from fleetlens.operators.sequence import plan_slices

BASE = 1_700_000_000


def events(seed):
    rng, rows, switches = random.Random(seed), [], []
    for robot in ("a", "b", "c"):
        for i in range(300 if robot == "a" else 40):
            at = rng.randint(0, 500)
            if rng.random() < 0.2:
                switches.append((robot, at, i, rng.random() < 0.5))
            else:
                rows.append((robot, at, i))
    return rows, switches


@pytest.mark.parametrize("seed", [1, 2])
def test_overflow_by_outage_equals_a_deque(spark, seed):
    rows, switches = events(seed)
    want, kept = {}, set()
    for robot in ("a", "b", "c"):
        mine = sorted([(at, 1, i, None) for r, at, i in rows if r == robot] + [(at, 0, i, up) for r, at, i, up in switches if r == robot])
        up, since, buffer = True, None, deque(maxlen=3)
        for at, kind, i, to in mine + [(10**6, 0, 0, True)]:
            if kind == 0:
                if to and not up:
                    kept |= {(robot, since, x) for x in buffer}
                    buffer.clear()
                if not to and up:
                    since = at
                up = to
            elif not up:
                n, lost = want.get((robot, since), (0, 0))
                want[robot, since] = (min(3, n + 1), lost + (len(buffer) == 3))
                buffer.append(i)
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("s") + BASE).cast("timestamp_ntz")).drop("s")
    data = stamp(spark.createDataFrame(rows, "robot_id string, s long, event_id long")).repartition(3)
    link = stamp(spark.createDataFrame(switches, "robot_id string, s long, event_id long, up boolean"))
    cut = plan_slices(data, "robot_id", micros("ts"), target_rows=50)
    assert cut is not None and want
    seconds = lambda c: (micros(c) / 1_000_000 - BASE).cast("long")
    for slices in (None, cut):
        got = Q.overflow_by_outage(data, link, 3, slices).select("robot_id", seconds("down_since"), "kept", "lost").collect()
        assert {tuple(r)[:2]: tuple(r)[2:] for r in got} == want
        held = Q.overflow(Q.outage_rows(data, link, slices), ["robot_id", "down_since"], ["ts", "event_id"], 3)
        assert {tuple(r) for r in held.select("robot_id", seconds("down_since"), "event_id").collect()} == kept
