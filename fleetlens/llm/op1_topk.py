"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Each block of rows keeps, per dimension, its rows ordered by value and cut into segments of equal quantised
value. For a query, a segment's impact is the least product that its rows can have with the query's weight,
counted from the dimension's smallest product, so no impact is negative. Segments are processed by descending
impact; a row's sum is then a lower bound of its score, and the sum plus what unread segments and quantisation
can still add is an upper bound. Processing stops only once the bounds prove that all but a few rows cannot
reach the k-th best lower bound; the possible members left are rescored exactly. Where the segments of largest
impact prove too little, all segments are read, for many queries at once as one matrix product with their least values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import finite_vector, table
from fleetlens.llm.vector_blocks import best, block_search

#: Segments per dimension and block, at most.
SEGMENTS = 32
#: Processing stops once at most this share of the rows are possible members, or ``4 * k``.
POSSIBLE_SHARE = 1 / 16
#: Shares of all postings after which the bounds are looked at.
LOOKS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Share that is read one by one where the rest can be read at once, which takes about as long.
HEAD = 1 / 64
#: Queries that are read at once.
TOGETHER = 64


def _places(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def build_index(ids: np.ndarray, vecs: np.ndarray) -> bytes:
    """Row order by descending value for every dimension; segments follow from the values."""
    order = np.argsort(-vecs, axis=0, kind="stable").T.astype(_places(len(vecs)))
    return np.ascontiguousarray(order).tobytes()


class ImpactIndex:
    """The segments of one block."""

    def __init__(self, data: bytes, stored: int, vecs: np.ndarray):
        self.n = len(vecs)
        self.order = np.frombuffer(data, _places(self.n)).reshape(stored, self.n)
        self.dims, self.start, self.end, self.low, self.high = [], [], [], [], []
        self.least, self.most = np.zeros(stored, np.int64), np.zeros(stored, np.int64)
        for d in range(stored):
            values = vecs[self.order[d], d]
            self.least[d], self.most[d] = values[-1], values[0]
            width = max(1, -(-(int(values[0]) - int(values[-1]) + 1) // SEGMENTS))
            level = (values - values[-1]) // width
            cuts = np.flatnonzero(np.diff(level)) + 1
            start, end = np.r_[0, cuts], np.r_[cuts, self.n]
            self.dims.append(np.full(len(start), d))
            self.start.append(start)
            self.end.append(end)
            self.low.append(values[end - 1])
            self.high.append(values[start])
        for name in ("dims", "start", "end", "low", "high"):
            parts = getattr(self, name)
            setattr(self, name, np.concatenate(parts) if parts else np.zeros(0, np.int64))
        self.stored, self._least_values = stored, None

    def few(self, k: int) -> int:
        return max(4 * k, int(self.n * POSSIBLE_SHARE))

    def least_values(self, kind: type) -> np.ndarray:
        """For every dimension and row, the least value of the row's segment."""
        if self._least_values is None or self._least_values.dtype != kind:
            out = np.zeros((self.stored, self.n), kind)
            for d, start, end, low in zip(self.dims, self.start, self.end, self.low):
                out[d, self.order[d, start:end]] = low
            self._least_values = out
        return self._least_values

    def possible_of(self, queries: np.ndarray, ks: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the rows that may be among its best ``ks``."""
        q = queries[:, : self.stored]
        size = np.abs(q).astype(float) @ np.maximum(np.abs(self.least), np.abs(self.most)).astype(float)
        widths = np.zeros(self.stored, np.int64)  # what quantisation hides in a dimension
        np.maximum.at(widths, self.dims, self.high - self.low)
        for start in range(0, len(q), TOGETHER):
            part, at = q[start : start + TOGETHER], 0
            largest = size[start : start + TOGETHER].max()
            exact = np.float32 if largest < 1 << 22 else np.float64 if largest < 1 << 50 else None  # holds sums and bounds
            while at < len(part):
                k = int(ks[start + at])
                members, _ = self.possible(part[at], k, (HEAD,) if exact else LOOKS)
                if exact and len(members) > self.few(k):
                    break
                yield members
                at += 1
            if at < len(part):
                sums = part[at:].astype(exact) @ self.least_values(exact)
                hidden = np.abs(part[at:]) @ widths
                for row, unsure, k in zip(sums, hidden, ks[start + at : start + TOGETHER]):
                    if self.n > k:
                        bar = int(np.partition(row, self.n - k)[self.n - k])
                        yield np.flatnonzero(row >= exact(bar - int(unsure)))
                    else:
                        yield np.arange(self.n)

    def possible(self, query: np.ndarray, k: int, shares: tuple = LOOKS) -> tuple[np.ndarray, bool]:
        """Rows that may be among the best ``k``, and whether some segments were left unread."""
        q = query[: len(self.least)]
        weight = q[self.dims]
        floor = np.minimum(q * self.least, q * self.most)  # the smallest product in each dimension
        a, b = weight * self.low, weight * self.high
        impact, top = np.minimum(a, b) - floor[self.dims], np.maximum(a, b) - floor[self.dims]
        use = np.flatnonzero(weight != 0)
        use = use[np.argsort(-top[use], kind="stable")]
        read = np.cumsum(self.end[use] - self.start[use])
        total = read[-1] if len(read) else 0
        looks = np.searchsorted(read, [total * x for x in shares])
        widest = np.zeros(len(q), np.int64)  # what quantisation hides in a dimension that was read
        np.maximum.at(widest, self.dims, top - impact)
        lower = np.zeros(self.n, np.int64)
        few = self.few(k)
        members, done = np.arange(self.n), 0
        for look in looks:
            for s in use[done : look + 1]:
                if impact[s]:
                    lower[self.order[self.dims[s], self.start[s] : self.end[s]]] += impact[s]
            done = look + 1
            unread = np.zeros(len(q), np.int64)
            np.maximum.at(unread, self.dims[use[done:]], top[use[done:]])
            if self.n > k:
                bar = np.partition(lower, self.n - k)[self.n - k]
                members = np.flatnonzero(lower + int(np.maximum(unread, widest).sum()) >= bar)
            if len(members) <= few:
                break
        return members, done < len(use)


def search(k: int):
    def run(index: bytes, dims: int, ids, vecs, q_ids, queries):
        built = ImpactIndex(index, dims, vecs)
        rows, asked, scores = [], [], []
        # the rows of the query's own id are left out afterwards, so as many more are kept
        sorted_ids = np.sort(ids)
        own = np.searchsorted(sorted_ids, q_ids, side="right") - np.searchsorted(sorted_ids, q_ids)
        for j, members in enumerate(built.possible_of(queries, k + np.maximum(1, own))):
            query = queries[j]
            exact = vecs[members] @ query
            other = ids[members] != q_ids[j]
            members, exact = members[other], exact[other]
            keep = best(exact, ids[members], k)
            rows.append(members[keep])
            asked.append(np.full(len(keep), j))
            scores.append(exact[keep])
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        return np.concatenate(asked), np.concatenate(rows), np.concatenate(scores)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, **blocks) -> DataFrame:
    """The ``k`` rows of largest integer inner product for every query, exactly: query_id, rank, vec_id, score.

    Both sides are (vec_id long, vec array<long>). A query's own vec_id is no candidate. Rows with a null id, a null
    vector or a null component take no part; vectors of different length count as filled with zeros; equal rows
    that repeat are kept once. Rows of one id with different vectors are all candidates and all ask, under their id. Scores must fit a long (components below 2**28 are safe). Empty inputs give no row.
    """
    whole = lambda df: df.select("vec_id", "vec").filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).dropDuplicates(["vec_id", "vec"])
    found = block_search(whole(rows), whole(queries), k, "int64", "long", search(k), build_index, **blocks)
    return found


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Every usable vector with components floor(scale * x)."""
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.filter(finite_vector(F.col("embedding"))).select("vec_id", vec.alias("vec"))


def op1_topk(spark, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), parts as (
  select vec_id, unnest(vec) as x, unnest(range(len(vec))) as d from v
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
  from parts q join parts c on q.d = c.d and q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
  group by 1, 2
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
