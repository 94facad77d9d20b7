"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

A vector o is centred on its block's mean c and written as o = c + |r| u. Its code is the sign pattern of the
rotated u, packed to bits, with correction scalars |r| and <x, u>, where x is the unit vector of the code. For a
query q, <x, q> / <x, u> estimates <u, q>, and sqrt(1 - <x, u>^2) / <x, u> * eps / sqrt(D - 1) bounds its error.
Vectors whose upper bound reaches the k-th best exact product found so far are reranked on the original vectors.
Codes are longer than the vectors: padding before the rotation makes the bounds tighter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import finite_vector, table
from fleetlens.llm.vector_blocks import best, block_search

#: Code bits for each dimension of the vectors.
STRETCH = 4
#: Width of the error bounds in standard deviations of the estimate.
EPSILON = 2.6
#: Queries of a block that are estimated at once.
TOGETHER = 32
SEED = 20240611


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """``dims`` x code-length matrix with orthonormal rows, the same everywhere."""
    bits = code_bits(dims)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))
    return (q * np.sign(np.diag(r))).T


def code_bits(dims: int) -> int:
    return -(-max(64, STRETCH * dims) // 64) * 64


def build_codes(ids: np.ndarray, vecs: np.ndarray) -> bytes:
    """Centre, |r|, <x, u> and packed codes of a block."""
    dims = vecs.shape[1]
    centre = vecs.mean(axis=0)
    rest = vecs - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ rotation(dims)
    bits = turned > 0
    agree = np.abs(turned).sum(axis=1) / (np.sqrt(turned.shape[1]) * np.where(length > 0, length, 1))
    agree = np.where(length > 0, agree, 1.0)
    return b"".join([centre.tobytes(), length.tobytes(), agree.tobytes(), np.packbits(bits, axis=1).tobytes()])


class Codes:
    def __init__(self, data: bytes, n: int, dims: int):
        f = np.frombuffer(data, np.float64, dims + 2 * n)
        self.dims, self.bits = dims, code_bits(dims)
        self.centre, self.length, self.agree = f[:dims], f[dims : dims + n], f[dims + n :]
        packed = np.frombuffer(data, np.uint8, offset=8 * (dims + 2 * n)).reshape(n, self.bits // 8)
        # one-bit codes as signs: products with many queries are then one matrix product
        self.signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
        self.turn = rotation(dims)
        self.scale = self.length / self.agree
        self.error = self.scale * np.sqrt(np.maximum(0, 1 - self.agree**2)) * EPSILON / np.sqrt(self.bits - 1)

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with each of ``queries`` and the part of their error bounds per unit of its norm."""
        q = queries[:, : self.dims]
        with_code = (q @ self.turn).astype(np.float32) @ self.signs.T / np.float32(np.sqrt(self.bits))
        return with_code * self.scale + (q @ self.centre)[:, None], self.error


def search(k: int):
    def run(index: bytes, dims: int, ids, vecs, q_ids, queries):
        codes = Codes(index, len(vecs), dims)
        rows, asked, scores = [], [], []
        for j, query in enumerate(queries):
            if j % TOGETHER == 0:
                guesses, error = codes.estimate(queries[j : j + TOGETHER])
            guess, norm = guesses[j % TOGETHER], np.linalg.norm(query)
            own = max(1, int((ids == q_ids[j]).sum()))
            first = best(guess, ids, 2 * k + own)
            exact = vecs[first] @ query
            bar = np.sort(exact)[-(k + own)] if len(exact) >= k + own else -np.inf
            near = np.union1d(np.flatnonzero(guess + error * norm >= bar), first)
            near = near[ids[near] != q_ids[j]]
            exact = _products(vecs[near], query)
            keep = best(exact, ids[near], k)
            rows.append(near[keep])
            asked.append(np.full(len(keep), j))
            scores.append(exact[keep])
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.concatenate(asked), np.concatenate(rows), np.concatenate(scores)

    return run


def _products(vecs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so equal vectors get equal scores everywhere."""
    out = np.zeros(len(vecs))
    for d in range(vecs.shape[1]):
        out += vecs[:, d] * query[d]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, **blocks) -> DataFrame:
    """About the ``k`` rows of largest inner product for every query: query_id, rank, vec_id, score (exact).

    Both sides are (vec_id long, vec array<double>). A query's own vec_id is no candidate. Rows with a null id or a
    null, zero or empty vector, or one with null or non-finite components, take no part; shorter vectors count as
    filled with zeros; equal rows that repeat are kept once. Rows of one id with different vectors are
    all candidates and all ask, under their id. Empty inputs give no row. Every row is indexed.
    """
    def whole(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "vec").filter(
            F.col("vec_id").isNotNull() & finite_vector(F.col("vec")) & F.exists("vec", lambda x: x != 0)
        ).dropDuplicates(["vec_id", "vec"])

    return block_search(whole(rows), whole(queries), k, "float64", "double", search(k), build_codes, **blocks)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
