"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Two sets link when 100 * |A and B| >= percent * |A or B|. Both then share ``ceil(percent * |A| / 100)`` shingles, so
they share one among the first |A| - that + 1 of any common order (prefix rule). The order puts shingles that many
documents share last, so common passages and lines hardly ever bring documents together.

1. Every distinct set gets an id; equal texts meet in it. Counts of frequent shingles are gathered in the same pass.
2. Sets that share a prefix shingle stand in its list. All pairs of a short list whose sizes allow a link are counted:
   sets of n >= m shingles that link share ``least_shared`` prefix shingles, so pairs that share fewer go. A long list
   is put in order of size and neighbours whose sizes allow a link are connected; sets that link are then joined by such
   a chain. A pair may also meet in long lists, as often as both stand in any: these count as shared.
   So no link leaves the components of these candidates.
3. A group of bounded size is one tile. A larger one is cut into bands of similar size and blocks of bounded weight.
   Each block meets itself and the group's most central sets; what that leaves apart meets the rest block by block,
   there with signatures only, and pairs that these leave open are decided on the texts.
4. In a tile, only sets whose sizes allow a link are compared, first by bitmaps: the bits in which two parity
   signatures differ are at most the symmetric difference, which bounds the overlap from above. Pairs that pass are
   decided on their sorted arrays. Sets already connected are not compared, so copies never make all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.llm.common import releasing, table, written
from fleetlens.llm.components import connected
from fleetlens.llm.shingles import WordHashes, chunks, shingle_sets

PERCENT = 80
#: Shingles that are counted together when frequent ones are looked for.
COUNTED = 4_000_000
#: Frequent shingles that the order knows, at most (12 bytes each). Any order gives right results: more known
#: shingles only make candidate groups smaller.
KNOWN = 2_000_000
#: Sets in a shingle's list of which all pairs are counted; longer lists are chained.
LIST = 12
#: Shingles in a tile: larger groups are cut.
TILE = 1_500_000
#: Bits (as a power of two) of the map that finds the documents whose texts are compared.
MAP_BITS = 24
#: Sets in a side of a tile of signatures, and partners of a set that are compared in one task.
SIDE, PART = 5000, 200
#: Most central sets that every block of a large group meets.
HUBS = 16
#: Bits of a signature: the next power of two of the largest set in the tile, within these bounds.
BITS = (256, 8192)


def set_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)))))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_shared(n, m, percent: int = PERCENT):
    """Shingles that the prefixes of sets of ``n >= m`` shingles have in common at least, if the sets link.

    Of ``t`` common shingles at least, the j-th in the order lies among the first ``j + n - t`` of the larger set.
    """
    least = lambda a, b: (a + b - 1 - (a + b - 1) % b) / b  # noqa: E731  a / b, rounded up
    return least(percent * (n + m), 100 + percent) - least(percent * n, 100) + 1


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, set size, set id) of a document; kind 1: (null, count, shingle) of shingles seen twice nearby."""
    words, held, weight, seen = WordHashes(), [], 0, set()

    def rows(kind, ids, a, b):
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), ids, pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                               names=["kind", "doc_id", "a", "b"])

    def counted():
        shingles, count = np.unique(np.concatenate(held), return_counts=True)
        twice = count > 1
        return rows(1, pa.nulls(int(twice.sum()), pa.int64()), count[twice], shingles[twice].view(np.int64))

    for batch, texts in chunks(batches):
        sets = shingle_sets(texts, words)
        keys = [set_id(s) for s in sets]
        yield rows(0, batch.column(0), [len(s) for s in sets], keys)
        for key, s in zip(keys, sets):
            if len(s) and key not in seen:
                seen.add(key)
                held.append(s)
                weight += len(s)
        if weight >= COUNTED:
            yield counted()
            held, weight, seen = [], 0, set()
    if held:
        yield counted()


class Order:
    """Shingles by how many sets are known to share them, then by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        self.shingles, self.counts = shingles, counts
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[shingles >> np.uint64(40)] = True

    def prefix(self, s: np.ndarray, length: int) -> np.ndarray:
        if not len(self.shingles):
            return s[:length]
        count = np.zeros(len(s), np.int64)
        may = np.flatnonzero(self.maybe[s >> np.uint64(40)])
        if len(may):
            at = np.minimum(np.searchsorted(self.shingles, s[may]), len(self.shingles) - 1)
            count[may] = np.where(self.shingles[at] == s[may], self.counts[at], 0)
        rare = s[count == 0]
        if len(rare) >= length:
            return rare[:length]
        return s[np.argsort(count, kind="stable")[:length]]


def _frequent(described: DataFrame, spark) -> Order:
    """The most frequent shingles, never more than ``KNOWN`` of them, as one small table for all tasks."""
    total = written(described.filter("kind = 1").groupBy(F.col("b").alias("shingle")).agg(F.sum("a").alias("count")), "frequent")
    # counts above 1000 are classes one hundredth wide, so this is a table of at most 5000 rows whatever the counts
    wide = 1000 + F.floor(100 * F.log(F.col("count") / 1000))
    total = total.withColumn("class", F.when(F.col("count") < 1000, F.col("count")).otherwise(wide))
    classes = total.groupBy("class").agg(F.count("*").alias("n")).collect()
    taken, room = [], KNOWN
    for r in sorted(classes, key=lambda r: -r["class"]):
        if r["n"] > room:  # nothing of a class that does not fit
            break
        room -= r["n"]
        taken.append(r["class"])
    known = total.filter(F.col("class") >= taken[-1] if taken else F.lit(False)).select("shingle", "count").toArrow()
    shingles = known.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return Order(shingles[order], np.minimum(known.column("count").to_numpy()[order], 2**31 - 1).astype(np.int32))


def _prefixes(order, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for _, texts in chunks(batches):
            shingles, keys, sizes = [], [], []
            for s in shingle_sets(texts, words):
                if len(s) and (key := set_id(s)) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    part = order.value.prefix(s, prefix_length(len(s), percent))
                    shingles.append(part)
                    keys.append(np.full(len(part), key))
                    sizes.append(np.full(len(part), len(s)))
            if shingles:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (shingles, keys, sizes)],
                                      names=["shingle", "set_id", "n"])

    return run


def signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity of the shingles that hash to each bit, as rows of 64-bit words."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)
        out[i] = np.packbits(odd).view(np.uint64)
    return out


def signature_bits(n: int) -> int:
    return min(BITS[1], max(BITS[0], 1 << max(0, n - 1).bit_length()))


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """A signature of fewer bits: the parity of a wider one's halves."""
    while len(signature) > words:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return signature


def may_link(n: int, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` whose signatures differ in ``apart`` bits can overlap enough."""
    overlap = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return 100 * overlap >= percent * (n + m - overlap)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact decision on two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Tile:
    """Sets that are compared in one task; ``forest`` gets a link for every two components that grow together."""

    def __init__(self, keys: list[int], sets: list[np.ndarray], percent: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.keys, self.sets = [keys[i] for i in order], [sets[i] for i in order]
        self.place = {int(i): j for j, i in enumerate(order)}
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent
        self.signs = signatures(self.sets, signature_bits(int(self.sizes.max())))
        self.comp = np.arange(len(sets))
        self.forest: list[tuple[int, int]] = []

    def meet(self, i: int, others: np.ndarray) -> None:
        """Compares set ``i`` with those of ``others`` it is not yet connected to."""
        others = others[self.comp[others] != self.comp[i]]
        if not len(others):
            return
        apart = np.bitwise_count(self.signs[others] ^ self.signs[i]).sum(axis=1, dtype=np.int64)
        for j in others[may_link(self.sizes[i], self.sizes[others], apart, self.percent)]:
            if self.comp[i] != self.comp[j] and links(self.sets[i], self.sets[j], self.percent):
                self.forest.append((self.keys[i], self.keys[j]))
                self.comp[self.comp == self.comp[j]] = self.comp[i]

    def fitting(self, i: int, below: bool = True) -> np.ndarray:
        """Sets whose size allows a link with ``i``: from it upwards, or on both sides."""
        n = int(self.sizes[i])
        start = np.searchsorted(self.sizes, -(-self.percent * n // 100)) if below else i + 1
        return np.arange(start, np.searchsorted(self.sizes, 100 * n // self.percent, side="right"))


def compare_all(keys: list[int], sets: list[np.ndarray], central: list[float], percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets: the most central sets meet the rest first, then what is left apart."""
    if len(sets) < 2:
        return []
    tile = Tile(keys, sets, percent)
    for i in np.argsort([-c for c in central], kind="stable")[:HUBS]:
        tile.meet(tile.place[int(i)], tile.fitting(tile.place[int(i)]))
    for i in range(len(sets)):
        tile.meet(i, tile.fitting(i, below=False))
    return tile.forest


FOREST = "a long, b long"


def _tile_sets(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The tile's rows with their sets; rows whose text is not that of their set, and repeats, go."""
    pdf = pdf.drop_duplicates(["set_id", "text"])
    sets = shingle_sets([t.encode() for t in pdf["text"]], WordHashes())
    good = [i for i, (s, k) in enumerate(zip(sets, pdf["set_id"])) if set_id(s) == k]
    pdf, sets = pdf.iloc[good], [sets[i] for i in good]
    one = ~pdf["set_id"].duplicated().to_numpy()
    return pdf[one], [s for s, keep in zip(sets, one) if keep]


def _whole_tiles(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, sets = _tile_sets(pdf.sort_values("set_id"))
        return pd.DataFrame(compare_all(list(pdf["set_id"]), sets, list(pdf["central"]), percent), columns=["a", "b"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, signature) of rows (set_id, text) whose text has that set."""
    words = WordHashes()
    for batch, texts in chunks(batches):
        sets = shingle_sets(texts, words)
        keys = batch.column(0).to_pylist()
        good = [i for i, (s, k) in enumerate(zip(sets, keys)) if set_id(s) == k]
        signs = [signatures([sets[i]], signature_bits(len(sets[i])))[0].tobytes() for i in good]
        yield pa.record_batch([pa.array([keys[i] for i in good], pa.int64()), pa.array(signs, pa.binary())], names=["set_id", "sign"])


def _side_tiles(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a left and a right set with different labels whose signatures allow a link."""
        signs = [np.frombuffer(x, np.uint64) for x in pdf["sign"]]
        words = min(map(len, signs))
        signs = np.stack([folded(x, words) for x in signs])
        left = pdf["left"].to_numpy(bool)
        n, label, key = pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["set_id"].to_numpy()
        right = np.flatnonzero(~left)
        right = right[np.argsort(n[right], kind="stable")]
        found = []
        for i in np.flatnonzero(left):
            low, high = np.searchsorted(n[right], [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])
            near = right[low:high]
            near = near[label[near] != label[i]]
            apart = np.bitwise_count(signs[near] ^ signs[i]).sum(axis=1, dtype=np.int64)
            near = near[may_link(n[i], n[near], apart, percent)]
            found += [(min(key[i], k), max(key[i], k)) for k in key[near]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _exact_links(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the set ``key[0]`` with the others of its part."""
        pdf, sets = _tile_sets(pdf.sort_values("set_id"))
        ids = list(pdf["set_id"])
        if key[0] not in ids:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        own = sets[ids.index(key[0])]
        return pd.DataFrame([(key[0], k) for k, s in zip(ids, sets) if k != key[0] and links(own, s, percent)], columns=["a", "b"], dtype="int64")

    return run


def _band(n) -> F.Column:
    """Sets that can link lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / math.log(1.26)).cast("int")


def _with_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with their texts; few other texts are shuffled.

    Members' ids set bits of a map of fixed size, kept as at most 2**MAP_BITS / 64 rows, so it may be broadcast
    whatever the number of members. Documents without their bit are left out before the exact join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    word, bit = F.shiftright(place, 6).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << MAP_BITS}) & 63 as int))")
    bits = written(members.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bits")
    likely = texts.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word").filter(
        F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits")
    return likely.join(members.hint("merge"), "doc_id")


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """(set_id, n, before, m, shared): pairs that connect all sets that link; rows (shingle, set_id, n) may repeat."""
    by_size = W.partitionBy("shingle").orderBy("n", "set_id")
    one = prefixes.withColumn("last", F.lag("set_id").over(by_size)).filter("last is null or last <> set_id").drop("last")
    lists = one.withColumn("long", F.count("*").over(W.partitionBy("shingle"))).filter("long > 1").withColumn("long", F.col("long") > LIST)
    own = F.struct("set_id", "n")
    near = F.collect_list(F.when(~F.col("long"), own)).over(by_size.rowsBetween(1 - LIST, -1))
    # in a long list a set meets its neighbour, and itself so that its long lists are counted
    met = lists.withColumns({"near": near, "next": F.lag(own).over(by_size)}).withColumn(
        "met", F.when(F.col("long"), F.array("next", own)).otherwise(F.col("near")))
    fits = lambda x: x.isNotNull() & (100 * x["n"] >= percent * F.col("n"))
    met = met.select("set_id", "n", "long", F.explode(F.filter("met", fits)).alias("met"))
    pairs = met.groupBy("set_id", "n", F.col("met.set_id").alias("before"), F.col("met.n").alias("m")).agg(
        F.count(F.when(~F.col("long"), 1)).alias("shared"), F.count(F.when(F.col("long"), 1)).alias("chained"))
    pairs = written(pairs, "pairs")

    longs = pairs.filter("before = set_id").select("set_id", F.col("chained").alias("lists"))
    pairs = pairs.filter("before <> set_id")
    enough = least_shared(F.col("n"), F.col("m"), percent)
    kept = pairs.filter((F.col("chained") > 0) | (F.col("shared") >= enough))
    unsure = pairs.filter((F.col("chained") == 0) & (F.col("shared") < enough)).join(longs, "set_id").join(
        longs.select(F.col("set_id").alias("before"), F.col("lists").alias("others")), "before")
    unsure = unsure.filter(F.col("shared") + F.least("lists", "others") >= enough)
    columns = ["set_id", "n", "before", "m", (F.col("shared") + F.col("chained")).alias("shared")]
    return written(kept.select(columns).union(unsure.select(columns)), "chain")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id long, text string).

    component_id is the least doc_id that links reach, the row's own included. Null texts and texts without words
    have the empty set, are linked with nothing and keep their own id. A row without an id is in the class of the
    documents that have its shingles and brings no further links; its own id stays null. Rows that repeat give a
    row each; other columns are ignored. Set identity and intersections use 64-bit hashes of the shingles.
    """
    if not 78 <= percent <= 100:
        raise ValueError("bands are made for 78 to 100 per cent")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = written(docs.mapInArrow(releasing(_described), "kind int, doc_id long, a long, b long"), "sets")
    # documents without words share no set: each has a key of its own, so that they don't meet in one task
    key = F.when(F.col("a") > 0, F.col("b")).otherwise(F.xxhash64("doc_id")).alias("set_id")
    sets = described.filter("kind = 0").select("doc_id", F.col("a").alias("n_shingles"), key)
    order = spark.sparkContext.broadcast(_frequent(described, spark))
    prefixes = docs.mapInArrow(releasing(_prefixes(order, percent)), "shingle long, set_id long, n long")
    chain = _candidates(prefixes, percent)

    ends = chain.select("set_id", "n", "shared").union(chain.select("before", "m", "shared"))
    share = F.sum("shared") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    central = ends.groupBy("set_id", "n").agg(share.alias("central"))
    groups = connected(chain, "set_id", "before")

    # one document stands for all that have its set
    chosen = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    members = groups.select(F.col("node").alias("set_id"), F.col("root").alias("group")).join(central, "set_id").join(chosen, "set_id")
    members = written(members.withColumn("band", _band(F.col("n"))), "members")
    weights = members.groupBy("group").agg(F.sum("n").alias("weight"))
    large = written(weights.filter(F.col("weight") > TILE).select("group"), "large")

    small = members.join(large, "group", "left_anti").select("set_id", "group", "central", "doc_id")
    texts = docs.filter("doc_id is not null and text is not null")
    forest = _with_texts(texts, small).groupBy("group").applyInPandas(_whole_tiles(percent), FOREST)
    rest = members.join(large, "group")
    found = [written(forest, "forest")]
    if not large.isEmpty():
        rest = written(_with_texts(texts, rest), "rest")
        found += _large_groups(rest, percent)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    labels = connected(edges, "a", "b")

    known = sets.join(labels.select(F.col("node").alias("set_id"), F.col("root")), "set_id", "left").withColumn(
        "class", F.coalesce("root", "set_id"))
    least = known.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    return known.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _large_groups(rest: DataFrame, percent: int) -> list[DataFrame]:
    """Links inside groups that are too large for one tile; rows (doc_id, text, set_id, group, n, central, band)."""
    # first every block of a band with itself and with the group's most central sets
    top = rest.withColumn("_r", F.row_number().over(W.partitionBy("group").orderBy(F.col("central").desc(), "set_id")))
    top = top.filter(F.col("_r") <= HUBS).drop("_r")
    blocks = rest.groupBy("group", "band").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    own = rest.join(blocks, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    slots = blocks.select("group", F.col("band").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    guests = top.join(slots, "group").filter(F.abs(F.col("at") - F.col("band")) <= 1)
    columns = ["group", "at", "block", "set_id", "central", "text"]
    tiles = own.withColumn("at", F.col("band")).select(columns).union(guests.select(columns))
    first = written(tiles.groupBy("group", "at", "block").applyInPandas(_whole_tiles(percent), FOREST), "forest")

    # then what is not in its group's largest component meets all fitting blocks, by signature
    labels = connected(first, "a", "b").select(F.col("node").alias("set_id"), "root")
    signed = written(rest.select("set_id", "text").mapInArrow(releasing(_signed), "set_id long, sign binary").dropDuplicates(["set_id"]), "signed")
    flat = rest.select("set_id", "group", "n", "band").distinct().join(signed, "set_id").join(labels, "set_id", "left")
    flat = written(flat.withColumn("label", F.coalesce("root", "set_id")).drop("root"), "labelled")
    main = flat.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(
        F.max(F.struct("c", "label"))["label"].alias("main"))
    apart = flat.join(main, "group").filter("label <> main").drop("main")
    cut = lambda df, name: df.groupBy("group", "band").agg(F.ceil(F.count("*") / SIDE).cast("int").alias(name))
    left_blocks, right_blocks = cut(apart, "lefts"), cut(flat, "rights")
    grid = left_blocks.withColumnRenamed("band", "l_band").join(right_blocks.withColumnRenamed("band", "r_band"), "group").filter(
        F.abs(F.col("l_band") - F.col("r_band")) <= 1)
    grid = written(grid.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn(
        "r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))), "grid")
    hashed = F.xxhash64("set_id")
    columns = ["group", "l_band", "l", "r_band", "r", "set_id", "n", "label", "sign"]
    lefts = apart.withColumnRenamed("band", "l_band").join(grid, ["group", "l_band"]).filter(F.pmod(hashed, "lefts") == F.col("l"))
    rights = flat.withColumnRenamed("band", "r_band").join(grid, ["group", "r_band"]).filter(F.pmod(hashed, "rights") == F.col("r"))
    tiles = lefts.select(*columns, F.lit(True).alias("left")).union(rights.select(*columns, F.lit(False).alias("left")))
    pairs = written(tiles.groupBy("group", "l_band", "l", "r_band", "r").applyInPandas(_side_tiles(percent), FOREST).distinct(), "pairs")

    # pairs that the signatures leave open are decided on the texts, at most PART partners of a set in a task
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    body = rest.select("set_id", "text")
    both = placed.select("a", "part", F.col("b").alias("set_id")).union(placed.select("a", "part", F.col("a").alias("set_id")).distinct())
    decided = both.join(body, "set_id").groupBy("a", "part").applyInPandas(_exact_links(percent), FOREST)
    return [first, written(decided, "forest")]


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
