"""The Jaccard join against all pairs of sets, with small tiles too."""

import random

import pytest

from fleetlens.llm import components, op2_jaccard
from fleetlens.llm.shingles import WordHashes, shingle_sets


def shingles(text):
    w = [] if text is None else bytes(text, "utf8").lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = list(range(len(sets)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[root(a)] = root(b)
    least = {}
    for j, (i, _) in enumerate(sets):
        if i is not None:
            least[root(j)] = min(least.get(root(j), i), i)
    return sorted(((i, len(s), i if not s else least.get(root(j))) for j, (i, s) in enumerate(sets)), key=repr)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 30, 120, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words + passage
        if rng.random() < 0.1:
            words = words + [rng.choice(vocabulary) for _ in range(2)]
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three four five"),
         (9007, "one\x0btwo three four five"), (9008, "one two three four five six"), (9009, "été Été"), (9010, "été été")]


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,tile", [(1, 1_500_000), (2, 900), (3, 2500)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(op2_jaccard, "TILE", tile)
    monkeypatch.setattr(op2_jaccard, "SIDE", 20)
    monkeypatch.setattr(op2_jaccard, "PART", 3)
    rows = corpus(seed) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(op2_jaccard.jaccard_classes(df)) == brute(rows)


@pytest.mark.parametrize("counts,known,want", [
    ([1500] * 30, 10, 0), ([10**6] * 5 + [1500] * 30, 10, 5), ([10**6] * 5 + [1500] * 30, 35, 35), ([2**62] * 2 + [900, 2, 2], 4, 3),
    ([3] * 4, 3, 0), ([3] * 4, 4, 4), ([], 4, 0),
])
def test_known_shingles_are_bounded(spark, monkeypatch, counts, known, want):
    monkeypatch.setattr(op2_jaccard, "KNOWN", known)
    described = spark.createDataFrame([(1, None, c, i) for i, c in enumerate(counts)], "kind int, doc_id long, a long, b long")
    order = op2_jaccard._frequent(described, spark)
    assert sorted(order.shingles.tolist()) == list(range(want))


@pytest.mark.parametrize("known", [0, 40])
def test_few_known_shingles_change_no_class(spark, monkeypatch, known):
    monkeypatch.setattr(op2_jaccard, "KNOWN", known)
    rows = corpus(5) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(op2_jaccard.jaccard_classes(df)) == brute(rows)


def test_base_of_copies_that_do_not_link_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(op2_jaccard, "TILE", 4000)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(180)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        words = list(base)
        for place in rng.sample(range(5, 175), 3):
            words[place] = f"x{i}_{place}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answer(op2_jaccard.jaccard_classes(df)) == brute(rows)


def test_long_text_repeats_null_ids_and_other_columns(spark):
    long_text = " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, long_text, "x"), (2, long_text + " more", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z"),
            (None, "alone in the world of null ids", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert answer(op2_jaccard.jaccard_classes(df)) == sorted(
        [(1, 39_996, 1), (2, 39_997, 1), (3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 3, None)], key=repr)


def test_empty_table(spark):
    assert answer(op2_jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("contract", [12, 10**6])
def test_components_of_chains_and_stars(spark, monkeypatch, contract):
    monkeypatch.setattr(components, "CONTRACT", contract)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 40)] + [(40, 41), (41, 40), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {5: 5} | {i: 5 for i in range(10, 40)} | {40: 40, 41: 40}
    assert got == want


def test_bitmap_bound_is_never_below_the_overlap():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(5, 400))).encode() for _ in range(40)]
    sets = shingle_sets(texts, WordHashes())
    signs = op2_jaccard.signatures(sets, 256)
    for a in range(40):
        for b in range(a):
            apart = sum(int(x).bit_count() for x in signs[a] ^ signs[b])
            assert (len(sets[a]) + len(sets[b]) - apart) // 2 >= len(set(sets[a]) & set(sets[b]))
