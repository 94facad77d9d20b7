"""Exact and approximate vector search against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

from fleetlens.llm import op1_topk, op10_ann

KIND = "vec_id long, vec array<long>, other string"


def brute(rows, queries, k):
    whole = {i: v for i, v, *_ in rows if i is not None and v is not None and None not in v}
    out = []
    for q, v, *_ in queries:
        if q in whole:
            near = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force_over_several_blocks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-40, 40) for _ in range(12)], "x") for i in range(400)]
    rows += [(1000 + i, rows[7][1], "copies tie") for i in range(60)]
    rows += [(2000, None, "x"), (2001, [1, None] + [0] * 10, "x"), (2002, [3, 4], "short"), (2003, [], "no component"), (None, [1] * 12, "x")]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    found = op1_topk.top_k(df, df.filter("vec_id % 10 = 0"), 5, rows_per_block=64, queries_per_block=16)
    assert got(found) == brute(rows, queries, 5)


def test_top_k_of_fewer_rows_repeats_and_empty_tables(spark):
    rows = [(1, [1, 2], "a"), (2, [5, 5], "a"), (2, [5, 5], "a"), (3, [0, 0], "zero")]
    df = spark.createDataFrame(rows, KIND)
    assert got(op1_topk.top_k(df, df.filter("vec_id = 1"), 5)) == [(1, 1, 2, 15), (1, 2, 3, 0)]
    none = df.filter("vec_id > 9")
    assert got(op1_topk.top_k(none, none, 5)) == []
    assert got(op1_topk.top_k(df, none, 5)) == []


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    vecs = rng.integers(-3, 4, (4000, 16))
    vecs[:6] = 100  # far ahead: the bounds prove it before all postings are read
    index = op1_topk.ImpactIndex(op1_topk.build_index(np.arange(4000), vecs), 16, vecs)
    query = np.full(16, 50)
    members, early = index.possible(query, 5)
    assert early and set(range(6)) <= set(members)
    for q in rng.integers(-9, 10, (20, 16)):
        best = set(np.argsort(-(vecs @ q), kind="stable")[:5])
        scores = vecs @ q
        bar = sorted(scores)[-5]
        assert {i for i in best if scores[i] > bar} <= set(index.possible(q, 5)[0])


def test_top_k_query_equals_sql(spark):
    assert compare(spark, connect(SMALL), "op1", op1_topk.op1_topk, op1_topk.SQL, SMALL) is None


def recall(df, rows, k, step, **blocks):
    found = op10_ann.nearest(df, df.filter(F.col("vec_id") % step == 0), k, **blocks).collect()
    ids, vecs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = total = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    for q in ids[ids % step == 0]:
        exact = vecs @ vecs[list(ids).index(q)]
        order = [i for i in np.argsort(-exact, kind="stable") if ids[i] != q][:k]
        mine = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
        for r in mine:
            assert math.isclose(r.score, exact[list(ids).index(r.vec_id)], rel_tol=1e-12, abs_tol=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(ids[order]))
        total += len(order)
    return hit / total


def test_nearest_recall_over_several_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.standard_normal(24) * rng.uniform(0.2, 3)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    assert recall(df, rows, 20, 20, rows_per_block=300, queries_per_block=10) >= 0.95


def test_nearest_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    assert recall(df, [tuple(r) for r in df.collect()], 20, 20) >= 0.9


def test_nearest_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0], "q"), (1, [2.0, 1.0], ""), (2, [2.0, 1.0], "tie"), (3, [0.0, 0.0], "zero"), (4, None, ""),
            (5, [float("nan"), 1.0], ""), (6, [float("inf"), 1.0], ""), (7, [None, 1.0], ""), (8, [], ""), (None, [1.0, 1.0], ""), (9, [-1.0], "short")]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, rank string")
    assert got(op10_ann.nearest(df, df.filter("vec_id in (0, 3, 4, 5)"), 20)) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 9, -1.0)]
    none = df.filter("vec_id > 99")
    assert got(op10_ann.nearest(none, none, 20)) == []


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((2000, 32))
    codes = op10_ann.Codes(op10_ann.build_codes(np.arange(2000), vecs), 2000, 32)
    queries = rng.standard_normal((20, 32))
    guess, error = codes.estimate(queries)
    inside = np.abs(guess - queries @ vecs.T) <= error * np.linalg.norm(queries, axis=1)[:, None]
    assert inside.mean() > 0.98


@pytest.mark.parametrize("find,kind", [(op1_topk.top_k, "long"), (op10_ann.nearest, "double")])
def test_rows_of_one_id_with_different_vectors_all_take_part(spark, find, kind):
    cast = int if kind == "long" else float
    pairs = [(1, (1, 2)), (1, (9, 1)), (1, (9, 1)), (2, (3, 3)), (2, (7, 5)), (2, (7, 5)), (3, (4, 8)), (4, (2, 6)), (4, (6, 2))]
    rows = spark.createDataFrame([(i, [cast(x) for x in v]) for i, v in pairs], f"vec_id long, vec array<{kind}>").repartition(3)
    distinct = sorted(set(pairs))
    want = []
    for q in (1, 2):
        scores = sorted((-(a[0] * b[0] + a[1] * b[1]), j) for i, a in distinct for j, b in distinct if i == q and j != q)
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:6])]
    assert sorted(tuple(r) for r in find(rows, rows.filter("vec_id <= 2"), 6).collect()) == want


@pytest.mark.parametrize("find,kind", [(op1_topk.top_k, "long"), (op10_ann.nearest, "double")])
def test_many_rows_of_the_own_id_leave_no_candidate_out(spark, find, kind):
    rng, cast = random.Random(8), int if kind == "long" else float
    pairs = [(1, [cast(100 + i), cast(100)] + [cast(0)] * 6) for i in range(40)]
    pairs += [(i, [cast(rng.randint(-20, 20)) for _ in range(8)]) for i in range(2, 500)]
    rows = spark.createDataFrame(pairs, f"vec_id long, vec array<{kind}>")
    asks = rows.filter("vec_id = 1").limit(1)
    q = asks.first().vec
    want = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in pairs if i != 1)[:5]
    assert [(r.vec_id, r.score) for r in find(rows, asks, 5).orderBy("rank").collect()] == [(i, -s) for s, i in want]
