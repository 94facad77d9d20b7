"""Resampling against a plain version, the cutoff by selection against sorting, and the query against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from compare import compare, connect
from conftest import SMALL

from fleetlens.llm import op11_resample as R

KIND = "doc_id long, text string, weight string, _at int"


def plain(docs, target, percent, least, runs, buckets, seed=2024):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(small))
    runs_of = lambda w: [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    hashed = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs_of(words(t))]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(hashed(x))
    for x in target:
        t.update(hashed(x))
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, x in docs:
        f = hashed(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words(x)) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = n + 1
    return sorted(map(tuple, out), key=repr)


def documents(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA-x", "été", "Ωmega", "1984", "日本", "can't"]
    make = lambda: rng.choice([None, "", " -- ", " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "beta " * 30])
    rows = [(rng.choice([None, i, i, i, 7]), make()) for i in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed,runs,finish,percent", [(1, 1, 10_000, 10), (2, 3, 5, 37), (3, 1, 1, 100), (4, 2, 3, 1)])
def test_equals_a_plain_version(spark, seed, runs, finish, percent):
    rows = documents(seed)
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], KIND).repartition(6)
    target = spark.createDataFrame([("été beta beta",), (None,), ("日本 omega",)], "text string")
    got = R.resample(docs, target, percent, 4, runs, 50, finish=finish)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, [r[0] for r in target.collect()], percent, 4, runs, 50)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, docs).count() == 0
    got = sorted(map(tuple, R.resample(docs, none, 100, 0).collect()))
    assert got == plain([(1, "a b"), (2, None)], [], 100, 0, 1, R.BUCKETS)


@pytest.mark.parametrize("seed", range(2))
def test_cutoff_is_the_kth_key(spark, seed):
    rng = random.Random(seed)
    n = 3000
    rows = [(rng.choice([5, rng.randint(-9, 9), rng.randint(-10**6, 10**6)]), rng.choice([None, 1, rng.randint(0, 10**9)]), rng.randint(0, 2)) for _ in range(n)]
    keys = spark.createDataFrame(rows, "score long, doc_id long, n_features long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        order = sorted(rows, key=R._place)
        for k in (1, n // 3, n):
            assert R.cutoff(keys, k, finish=20) == order[k - 1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert R.cutoff(keys, 0) is None


def test_weighted_median_halves():
    rng = random.Random(1)
    for _ in range(200):
        keys = [(rng.randint(0, 5), rng.choice([None, 1, 2]), 0) for _ in range(rng.randint(1, 9))]
        sizes = [rng.randint(1, 9) for _ in keys]
        flat = sorted((k for k, s in zip(keys, sizes) for _ in range(s)), key=R._place)
        assert R.weighted_median(keys, sizes) == flat[(len(flat) - 1) // 2]


def test_a_very_long_text(spark):
    text = "Word " * 400_000
    docs = spark.createDataFrame([(1, text), (2, "word " * 30)], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in R.resample(docs, docs).collect()}
    assert got == {1: 400_000, 2: 30}


def test_query_equals_sql(spark):
    assert compare(spark, connect(SMALL), "op11", R.op11_resample, R.SQL, SMALL) is None
