"""Block-by-block search: the queries, in a few groups, meet every block of rows, and each such cell is one small task.

Neither side is broadcast or collected. Rows and queries are packed into blocks of a fixed number of vectors, whole numbers
in as few bytes as hold them. A block of rows travels once per group of queries and a block of queries once per block of
rows; a task holds one block of rows and one group at a time. Each cell returns at most ``k`` rows per query, and a rank
filter (which Spark also applies before the shuffle) merges the cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.llm.common import block_count, hash_block, release_memory

#: Blocks of queries in a group, at most.
GROUP_BLOCKS = 64
#: Cells that are wanted at least, so that few blocks of rows still make tasks for all cores.
CELLS = 48


def padded(lists: list[np.ndarray], dims: int, kind) -> np.ndarray:
    """Rows as a matrix; vectors shorter than ``dims`` are filled with zeros."""
    out = np.zeros((len(lists), dims), dtype=kind)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def packed_bytes(m: np.ndarray) -> bytes:
    """A matrix as bytes; whole numbers take as few of them as hold the least and the largest."""
    if m.dtype.kind == "i" and m.size:
        m = m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max))
    return m.tobytes()


def _packer(kind: str, encode: Callable[[np.ndarray, np.ndarray], bytes] | None) -> Callable:
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        vecs = padded(list(pdf["vec"]), int(pdf["vec"].map(len).max()), kind)
        ids = pdf["vec_id"].to_numpy(np.int64)
        extra = encode(ids, vecs) if encode else b""
        return pd.DataFrame({"block": [int(key[0])], "n": [len(pdf)], "dims": [vecs.shape[1]],
                             "ids": [ids.tobytes()], "vecs": [packed_bytes(vecs)], "index": [extra]})

    return pack


PACKED = "block int, n long, dims int, ids binary, vecs binary, index binary"


def packed_blocks(rows: DataFrame, blocks: int, kind: str, encode=None) -> DataFrame:
    """(vec_id, vec) rows as one row per block; ``encode(ids, matrix)`` adds the block's index as bytes."""
    cut = rows.withColumn("block", hash_block(F.col("vec_id"), blocks))
    return cut.groupBy("block").applyInPandas(_packer(kind, encode), PACKED)


def block_search(rows: DataFrame, queries: DataFrame, k: int, kind: str, score_type: str, search: Callable,
                 encode: Callable | None = None, rows_per_block: int = 32_768, queries_per_block: int = 256) -> DataFrame:
    """Best ``k`` of ``rows`` (vec_id, vec) for each of ``queries`` (vec_id, vec) as query_id, rank, vec_id, score.

    ``search(index, dims, ids, vecs, query_ids, queries)`` returns (query row, row, score) arrays of one cell, whose
    queries are at most ``GROUP_BLOCKS`` blocks.
    """
    n_rows, n_queries = rows.count(), queries.count()
    blocks, q_blocks = block_count(n_rows, rows_per_block), block_count(n_queries, queries_per_block)
    groups = min(q_blocks, max(block_count(q_blocks, GROUP_BLOCKS), block_count(CELLS, blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # one task per cell or a few, spread evenly whatever the sizes of the packed rows are
    tasks = min(2 * blocks * groups, 10_000)
    data = packed_blocks(rows, blocks, kind, encode).withColumn("group", every(groups)).repartition(tasks, "block", "group")
    asked = packed_blocks(queries, q_blocks, kind).withColumnRenamed("block", "q_block").withColumn(
        "group", (F.col("q_block") % groups).cast("int")).withColumn("block", every(blocks)).repartition(tasks, "block", "group")

    def run(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if block.empty or group.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        r = next(block.itertuples(index=False))
        dims = max(r.dims, int(group["dims"].max()))
        group = group.sort_values("q_block")
        vecs, ids = _matrix(r.vecs, r.n, r.dims, dims, kind), np.frombuffer(r.ids, np.int64)
        asked = np.concatenate([_matrix(q.vecs, q.n, q.dims, dims, kind) for q in group.itertuples(index=False)])
        q_ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"]])
        q, i, score = search(r.index, r.dims, ids, vecs, q_ids, asked)
        found = pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[i], "score": score})
        release_memory()
        return found

    key = ["block", "group"]
    found = data.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _matrix(data: bytes, n: int, dims: int, wanted: int, kind: str) -> np.ndarray:
    stored = f"{kind[:-2]}{8 * len(data) // (n * dims)}" if n * dims else kind  # as narrow as it was packed
    m = np.frombuffer(data, stored).reshape(n, dims).astype(kind)
    return m if dims == wanted else np.pad(m, ((0, 0), (0, wanted - dims)))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
