"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

A document is a point with a weight (its bytes). In every round, all nodes of a level are split at once: one
aggregate finds each node's widest dimension, then the weighted median of (dimension, text checksum, id hash),
packed into one 63-bit key, is found digit by digit from histograms of at most ``2**DIGIT`` bins per node. Only
these histograms' winners, one row per node, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.llm.common import gapless_rank, table, written

#: Bits of a key: dimension, text checksum, hash of the id. Equal texts are cut apart only by the last part.
DIM_BITS, CRC_BITS, ID_BITS = 16, 32, 15
#: Bits of the key that one histogram resolves.
DIGIT = 16
KEY_BITS = DIM_BITS + CRC_BITS + ID_BITS


def _key(value: Column, low: Column, high: Column) -> Column:
    step = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    place = F.floor(step * ((1 << DIM_BITS) - 1)).cast("long")
    return (F.shiftleft(place, CRC_BITS + ID_BITS) + F.shiftleft(F.col("crc"), ID_BITS) + F.col("id_hash")).cast("long")


def _widest(points: DataFrame, dims: list[str], spans: dict[str, float]) -> dict[int, tuple[str, float, float]]:
    """Per node its widest dimension, as a share of the whole table's range, with that range."""
    ends = [f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))]
    out = {}
    for r in points.groupBy("node").agg(*ends).collect():  # one row per node
        width = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / spans[d] if spans[d] else 0.0 for d in dims}
        d = max(dims, key=lambda x: width[x])
        out[r["node"]] = (d, float(r[f"lo_{d}"]), float(r[f"hi_{d}"]))
    return out


def _pick(values: dict[int, object], kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col("node")].cast(kind)


def _medians(keyed: DataFrame, goal: dict[int, float]) -> dict[int, int]:
    """Per node the least key at which at least ``goal`` weight lies at or before it."""
    prefix, before = {n: 0 for n in goal}, {n: 0 for n in goal}
    left = KEY_BITS
    while left:
        take = min(DIGIT, left)
        left -= take
        inside = keyed.filter(F.shiftright(F.col("key"), left + take) == _pick(prefix, "long"))
        bins = inside.groupBy("node", F.shiftright(F.col("key"), left).alias("bin")).agg(F.sum("weight").alias("weight"))
        upto = F.sum("weight").over(W.partitionBy("node").orderBy("bin"))
        bins = bins.withColumn("upto", upto + _pick(before, "long"))
        hit = bins.filter(F.col("upto") >= _pick(goal, "double")).groupBy("node").agg(
            F.min(F.struct("bin", "upto", "weight")).alias("x"))
        for r in hit.collect():  # one row per node
            prefix[r["node"]], before[r["node"]] = r["x"]["bin"], r["x"]["upto"] - r["x"]["weight"]
    return prefix


def kd_shards(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) to ``points`` (doc_id, weight, crc, numeric ``dims``): near-equal weights.

    Null dimension values count as the least value of the table, null ids as one id. Rows that agree in text
    checksum and dimensions are neighbours and are cut apart only where a median falls among them; rows that agree
    in the id as well stay together. An empty table stays empty. Fewer points than shards leave shards empty.
    """
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    spans = {d: float((ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0)) for d in dims}
    tree: dict[int, tuple[str, float, float, int]] = {}
    leaves = {1: shards}
    base = points.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).alias("id_hash"))
    for d in dims:
        base = base.withColumn(d, F.coalesce(F.col(d).cast("double"), F.lit(float(ends[f"lo_{d}"] or 0))))
    first: dict[int, int] = {1: 0}
    while any(n > 1 for n in leaves.values()):
        now = _placed(base, tree).filter(F.col("node").isin([k for k, n in leaves.items() if n > 1]))
        wide = _widest(now, dims, spans)
        if not wide:
            break
        key = None
        for node, (d, lo, hi) in wide.items():
            made = _key(F.col(d), F.lit(lo), F.lit(hi))
            key = F.when(F.col("node") == node, made) if key is None else key.when(F.col("node") == node, made)
        keyed = now.select("node", "weight", key.alias("key"))
        totals = {r["node"]: r["w"] for r in keyed.groupBy("node").agg(F.sum("weight").alias("w")).collect()}
        goal = {n: totals[n] * (leaves[n] // 2) / leaves[n] for n in wide}
        cuts = _medians(keyed, goal)
        for node, (d, lo, hi) in wide.items():
            tree[node] = (d, lo, hi, cuts[node])
        for node in [k for k, n in leaves.items() if n > 1]:
            n, at = leaves.pop(node), first.pop(node)
            leaves[2 * node], first[2 * node] = n // 2, at
            leaves[2 * node + 1], first[2 * node + 1] = n - n // 2, at + n // 2
    return _placed(base, tree).withColumn("shard", _pick(first, "int")).drop("node", "id_hash")


def _placed(base: DataFrame, tree: dict) -> DataFrame:
    """``base`` with the tree node that each point has reached; nodes are numbered as in a binary heap."""
    node = F.lit(1)
    depth = max((n.bit_length() for n in tree), default=0)
    out = base.withColumn("node", node)
    for level in range(1, depth + 1):
        step = F.col("node")
        made = None
        for n, (d, lo, hi, cut) in tree.items():
            if n.bit_length() == level:
                child = F.when(_key(F.col(d), F.lit(lo), F.lit(hi)) <= cut, 2 * n).otherwise(2 * n + 1)
                made = F.when(F.col("node") == n, child) if made is None else made.when(F.col("node") == n, child)
        out = out.withColumn("node", step if made is None else made.otherwise(step))
    return out


def metadata_points(docs: DataFrame) -> DataFrame:
    """Weight, checksum and dimensions of documents: size, language and characters per byte."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    lang = F.pmod(F.xxhash64("lang"), F.lit(1024)).cast("double")
    return docs.select("doc_id", size.alias("weight"), F.crc32(text.cast("binary")).alias("crc"),
                       F.log2(size.cast("double")).alias("log_size"), lang.alias("lang_code"),
                       (F.length(text) / size).alias("density"))


def op9_shard(spark, sf_dir: str) -> DataFrame:
    points = written(metadata_points(table(spark, sf_dir, "documents")), "points")
    placed = kd_shards(points, ["log_size", "lang_code", "density"], 8)
    slotted = gapless_rank(placed.select("doc_id", "weight", "crc", "shard"), ["shard"], ["doc_id"], "slot")
    return slotted.select("doc_id", F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                          "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
