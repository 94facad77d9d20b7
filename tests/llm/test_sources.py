"""Mixing, sharding, ranks over hot groups, and the pipeline."""

import random
from collections import Counter, defaultdict

import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import common, op8_mix, op9_shard


def shares(sizes):
    """Targets by dealing again and again, as the rule is told."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 3 * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def documents(seed, n=600):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None, "é"]
    return [(i, rng.choices(names, [12, 1, 3, 0.2, 2, 0.5])[0], rng.choice([0, 3, 3, 10, rng.randint(1, 900)])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_reaches_its_targets(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    got = op8_mix.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, taken = shares(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= 901
    again = op8_mix.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_edges(spark):
    kind = "doc_id long, source string, size long"
    assert op8_mix.mix_sources(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "a", 0), (None, "a", 0), (2, None, 5), (2, None, 5), (3, None, 5)]
    got = op8_mix.mix_sources(spark.createDataFrame(rows, kind)).collect()
    assert {r.target for r in got if r.source == "a"} == {0.0} and sum(r.copies for r in got if r.source == "a") == 0
    assert sum(r.size * r.copies for r in got) == 15
    assert [op8_mix.word_count(F.lit(t)) is not None for t in ("a",)] == [True]
    texts = spark.createDataFrame([(None,), ("",), (" \n",), ("a b\tc",), (" é x ",)], "text string")
    assert [r[0] for r in texts.select(op8_mix.word_count(F.col("text"))).collect()] == [0, 0, 0, 3, 1]


def test_mix_query_equals_sql(spark):
    assert compare(spark, connect(SMALL), "op8", op8_mix.op8_mix, op8_mix.SQL, SMALL) is None


@pytest.mark.parametrize("per_bucket", [3, 50, 10**6])
def test_gapless_rank_of_hot_groups(spark, per_bucket):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 1, 1, 2, None]), rng.choice([None, rng.randint(-50, 10**15)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, a long, b long")
    got = common.gapless_rank(df, ["g"], ["a", "b"], "rank", per_bucket).collect()
    least = lambda v: (v is not None, v or 0)
    for g in ("x", "y", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [(r.a, r.b) for r in mine] == sorted(((r.a, r.b) for r in mine), key=lambda t: (least(t[0]), least(t[1])))


def points(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, weight long, crc long, p double, q double")


def test_shards_weigh_the_same_and_keep_equal_texts_near(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 50), rng.getrandbits(32), rng.random(), rng.choice([0.0, 1.0, None])) for i in range(3000)]
    rows += [(5000 + i, 20, 77, 0.5, 0.0) for i in range(1500)]  # a third of all in one text
    got = op9_shard.kd_shards(points(spark, rows), ["p", "q"], 8).collect()
    weight = Counter()
    for r in got:
        weight[r.shard] += r.weight
    assert set(weight) == set(range(8)) and len(got) == len(rows)
    mean = sum(weight.values()) / 8
    assert max(weight.values()) < 1.03 * mean and min(weight.values()) > 0.97 * mean
    small = Counter(rng.randrange(900) for _ in range(2500))
    rows = [(i * 10 + j, 5, g, float(g % 7), 0.0) for i, (g, n) in enumerate(small.items()) for j in range(n)]
    got = op9_shard.kd_shards(points(spark, rows), ["p", "q"], 8).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.crc].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7  # one text at most for each cut


def test_shards_of_few_or_no_points(spark):
    assert op9_shard.kd_shards(points(spark, []), ["p", "q"], 8).count() == 0
    got = op9_shard.kd_shards(points(spark, [(1, 5, 1, None, None), (None, 5, 2, 0.1, None), (1, 5, 1, None, None)]), ["p", "q"], 8).collect()
    assert len(got) == 3 and all(0 <= r.shard < 8 for r in got)


def test_shard_query(spark):
    import zlib

    import pandas as pd

    got = op9_shard.op9_shard(spark, SMALL).toPandas()
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").set_index("doc_id")["text"]
    assert sorted(got["doc_id"]) == sorted(docs.index) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_pipeline_against_its_rules(spark):
    from test_jaccard import brute
    from test_texts import base_spans

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(90001, None, None, None, 0), (90002, "12 34", "en", "src0", 5), (90003, "", None, "src1", 0)], docs.schema)
    docs = docs.union(more).withColumn("extra", F.lit(1))
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SMALL), name)
        rows[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in rows[name]}
            assert gone == {90001, 90002, 90003} and all(r.lang for r in rows[name])
    kept = [(r.doc_id, r.text) for r in rows["language_id"]]
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(i for i, _, c in brute(kept) if i == c)
    texts = {r.doc_id: r.text for r in rows["near_duplicates"]}
    for r in rows["personal_data"]:
        assert len(r.text) == r.n_chars and not base_spans(r.text)
        if not base_spans(texts[r.doc_id]) and "[" not in r.text:
            assert r.text == texts[r.doc_id]
    sizes = Counter()
    for r in rows["personal_data"]:
        sizes[r.source] += len(r.text.split())
    taken, copies = Counter(), Counter()
    for r in rows["mixing"]:
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    largest = max(len(r.text.split()) for r in rows["personal_data"])
    assert max(copies.values()) <= 3 and all(abs(taken[s] - t) <= largest for s, t in shares(sizes).items())
    assert Counter(r.doc_id for r in rows["encoding"]) == copies and all(r.n_tokens > 0 for r in rows["encoding"])
