"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

#: Edges that one task contracts.
CONTRACT = 500_000


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) rows with the least id among u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["k"]).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_least(edges)
    # one row per larger end keeps it linked to the least; the other smaller ends follow
    return near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one task as (node, least node of its component in this task)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for pdf in frames:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"u": nodes, "v": [top(x) for x in nodes]}, dtype="int64")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has an edge, with the least node id of its component.

    Edges are (a, b) longs without nulls. Each round first contracts about ``CONTRACT`` edges per task to stars, then
    takes a large-star and a small-star step; it ends when nothing changes. A graph of one such part needs no round.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = written(now, "edges")
    mark = _mark(now)
    parts = -(-mark[0] // CONTRACT)
    while parts > 1:
        stars = now.repartition(parts, "u").mapInPandas(_contracted, "u long, v long").distinct()
        now = written(_small_star(_large_star(stars).distinct()), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    if parts == 1:
        now = written(now.repartition(1).mapInPandas(_contracted, "u long, v long"), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
