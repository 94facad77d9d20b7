"""Tests of round 4's findings: what travels, and what a task holds, in the vector search and the Jaccard join."""

import random

import numpy as np
import pytest
from test_jaccard import EDGES, answer, brute, corpus

from fleetlens.llm import op1_topk, op2_jaccard, vector_blocks


def test_a_block_of_rows_meets_queries_in_groups_not_block_by_block(spark):
    rows = spark.createDataFrame([(i, [i % 7, 1]) for i in range(500)], "vec_id long, vec array<long>")

    def search(index, dims, ids, vecs, q_ids, queries):  # one hit per cell: the number of its queries
        return np.zeros(1, int), np.zeros(1, int), np.array([len(queries)])

    found = vector_blocks.block_search(rows, rows.filter("vec_id < 200"), 10**6, "int64", "long", search, rows_per_block=50, queries_per_block=2)
    cells = [r.score for r in found.collect()]
    assert sum(cells) == 200 * 10  # every query meets every block
    assert len(cells) <= 50  # 100 blocks of queries were 1000 cells, each with its copy of a block of rows


@pytest.mark.parametrize("least,most,size", [(-128, 127, 1), (-129, 0, 2), (0, 128, 2), (-2**31, 2**31 - 1, 4), (-2**63, 2**63 - 1, 8), (0, 0, 1)])
def test_whole_numbers_travel_in_as_few_bytes_as_hold_them(least, most, size):
    m = np.array([[least, 0, 1], [most, 0, 0]], np.int64)
    data = vector_blocks.packed_bytes(m)
    assert len(data) == size * m.size
    back = vector_blocks._matrix(data, 2, 3, 5, "int64")
    assert back.dtype == np.int64 and (back[:, :3] == m).all() and not back[:, 3:].any()


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 22])
def test_segments_read_at_once_lose_nothing(scale):
    rng = np.random.default_rng(9)
    vecs = rng.integers(-90, 91, (3000, 24)) * scale
    vecs[50:60] = vecs[7]  # ties
    ids = rng.permutation(3000)
    queries = np.concatenate([rng.integers(-90, 91, (70, 24)) * scale, vecs[5:9], np.zeros((1, 24), np.int64)])
    q_ids = np.concatenate([np.arange(5000, 5070), ids[5:9], [9000]])
    asked, rows, scores = op1_topk.search(5)(op1_topk.build_index(ids, vecs), 24, ids, vecs, q_ids, queries)
    for j, query in enumerate(queries):
        exact = vecs @ query
        want = [i for i in np.lexsort((ids, -exact)) if ids[i] != q_ids[j]][:5]
        assert rows[asked == j].tolist() == want and scores[asked == j].tolist() == exact[want].tolist()


def test_documents_that_share_too_little_are_no_candidates(spark, monkeypatch):
    edges, connected = [], op2_jaccard.connected
    monkeypatch.setattr(op2_jaccard, "connected", lambda df, a, b: edges.append(df.count()) or connected(df, a, b))
    monkeypatch.setattr(op2_jaccard, "KNOWN", 0)
    words = iter(f"w{i}" for i in range(10**6))
    own = [[next(words) for _ in range(75)] for _ in range(80)]
    shared = [[next(words) for _ in range(12)] for _ in range(81)]
    # each shares 8 of 95 shingles with the next, some of them in both prefixes: they were one chain
    rows = [(i, " ".join(shared[i] + own[i] + shared[i + 1])) for i in range(80)]
    rows += [(900, rows[4][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(op2_jaccard.jaccard_classes(df)) == brute(rows)
    assert edges[0] == 1


@pytest.mark.parametrize("most,known", [(2, 0), (2, 10**6), (5, 0)])
def test_long_and_short_lists_find_the_same_classes(spark, monkeypatch, most, known):
    monkeypatch.setattr(op2_jaccard, "LIST", most)
    monkeypatch.setattr(op2_jaccard, "KNOWN", known)
    rng = random.Random(most)
    rows = corpus(10 + most) + EDGES
    rows += [(5000 + i, rng.choice(rows)[1]) for i in range(60)]  # copies in other tasks
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert answer(op2_jaccard.jaccard_classes(df)) == brute(rows)


@pytest.mark.parametrize("percent", [78, 80, 90, 100])
def test_linked_sets_share_as_many_prefix_shingles_as_counted(percent):
    rng = random.Random(percent)
    for _ in range(3000):
        n = rng.randint(1, 60)
        m = rng.randint(-(-percent * n // 100), n)
        both = max(1, -(-percent * (n + m) // (100 + percent)))
        pool = rng.sample(range(10**6), n + m - both)
        a, b = sorted(pool[:n]), sorted(pool[n - both :])
        a, b = a[: op2_jaccard.prefix_length(n, percent)], b[: op2_jaccard.prefix_length(m, percent)]
        assert len(set(a) & set(b)) >= op2_jaccard.least_shared(n, m, percent) >= 1
