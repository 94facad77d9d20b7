"""Resampling towards a target distribution: hashed-feature weights, Gumbel noise, and an exact cutoff by selection.

A document's weight sums the log ratios (gains) of its features' buckets, target over documents; an array of fixed
size holds all gains, so scoring is a lookup. With Gumbel noise added, the highest scores are a sample without
replacement in proportion to exp(weight). The cutoff is found without sorting: every partition reports the weighted
median of its batches' medians among the keys still possible, the weighted median of those splits the keys, and the
side that cannot hold the cutoff goes: at least an eighth of what is left, a half as a rule. Only winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import table, written

#: Buckets that features are hashed to.
BUCKETS = 10_000
#: Longest run of words that is a feature, words that a document needs, percent drawn, seed of the noise.
RUNS, LEAST_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: Keys that the driver may finish with.
FINISH = 10_000
#: Distinct features whose buckets a task remembers.
REMEMBERED = 300_000

_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
#: ASCII capitals to small letters; ASCII signs that are neither letter nor digit to spaces.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b" " * len(_BREAKS))


class FeatureBuckets(dict):
    """Bucket of each feature, kept for the features seen lately."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value


def features(text: bytes | None, runs: int) -> tuple[int, list[bytes]]:
    """Number of words of a text in UTF-8, and all runs of 1 to ``runs`` consecutive words, joined by one space."""
    words = text.translate(_FOLD).split() if text else []
    out = words
    for n in range(2, runs + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    return (x.as_py() for x in column)  # one text at a time


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sends one table of fixed size; null texts have no features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = FeatureBuckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                _, found = features(text, runs)
                total += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket a thousand times the log ratio of its smoothed shares, rounded down."""
    s, t, n = documents.astype(np.float64), target.astype(np.float64), len(documents)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = FeatureBuckets(len(shared.value))
        for batch in batches:
            words, counts, weights = [], [], []
            for text in _texts(batch):
                n, found = features(text, runs)
                words.append(n)
                counts.append(len(found))
                weights.append(int(shared.value[np.fromiter(map(bucket.__getitem__, found), np.int64, len(found))].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, counts, weights)]], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    return docs.select("doc_id", "text").mapInArrow(score, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id; null ids hash as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


#: The order of the draw: high scores first, then small ids, null ids last. Rows equal in all of these are alike.
KEY = ["score", "doc_id", "n_features"]


def draw_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def _place(row) -> tuple:
    """A key as a tuple that sorts in the order of the draw."""
    return -row[0], row[1] is None, row[1] if row[1] is not None else 0, row[2]


def _ahead(key: tuple, or_equal: bool = False) -> Column:
    """Whether a row comes before ``key``."""
    score, doc_id, n = key
    later = F.col("n_features") <= n if or_equal else F.col("n_features") < n
    if doc_id is None:
        tie = F.col("doc_id").isNotNull() | later
    else:
        tie = (F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & later)
    return (F.col("score") > score) | ((F.col("score") == score) & F.coalesce(tie, F.lit(False)))


def weighted_median(keys: list[tuple], sizes: list[int]) -> tuple:
    """The first key in order at which half of the sizes is reached."""
    order = sorted(range(len(keys)), key=lambda i: _place(keys[i]))
    reached = np.cumsum([sizes[i] for i in order])
    return keys[order[int(np.searchsorted(reached, (reached[-1] + 1) // 2))]]


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: the weighted median of its batches' medians, and its number of keys."""
    keys, sizes, schema = [], [], None
    for batch in batches:
        schema = batch.schema
        if batch.num_rows:
            rows = sorted(zip(*[c.to_pylist() for c in batch.columns]), key=_place)
            keys.append(rows[(len(rows) - 1) // 2])
            sizes.append(len(rows))
    if keys:
        score, doc_id, n = weighted_median(keys, sizes)
        yield pa.RecordBatch.from_arrays([pa.array([x], schema.field(i).type) for i, x in enumerate((score, doc_id, n))] + [pa.array([sum(sizes)], pa.int64())],
                                         names=[*KEY, "size"])


def cutoff(keys: DataFrame, k: int, finish: int = FINISH) -> tuple | None:
    """The k-th key of ``keys`` (score, doc_id, n_features) in the order of the draw, or None if k is 0.

    A round is two passes over the keys; the driver gets one row per task. Once ``finish`` keys are left, these are
    sorted there.
    """
    if k <= 0:
        return None
    rest, sure = keys.select(*KEY), 0  # keys that may be the cutoff; keys known to come before them
    schema = T.StructType([*rest.schema.fields, T.StructField("size", T.LongType())])
    while True:
        found = rest.mapInArrow(_medians, schema).collect()
        if sum(r["size"] for r in found) <= finish:
            return tuple(sorted(map(tuple, rest.collect()), key=_place)[k - sure - 1])
        pivot = weighted_median([tuple(r)[:3] for r in found], [r["size"] for r in found])
        before, upto = rest.agg(F.count_if(_ahead(pivot)), F.count_if(_ahead(pivot, True))).first()
        if sure + before >= k:
            rest = rest.filter(_ahead(pivot))
        elif sure + upto >= k:
            return pivot
        else:
            rest, sure = rest.filter(~_ahead(pivot, True)), sure + upto


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS,
             buckets: int = BUCKETS, seed: int = SEED, finish: int = FINISH) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank (from 1) is null for rows not drawn.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn. Both tables need ``text``;
    doc_id must be a number. Null and empty texts have no feature and weight 0. Equal scores go to the smaller id,
    null ids last, then to fewer features; rows equal in these are alike and as many are drawn as there is room for.
    Rows that repeat take part each. An empty ``docs`` gives no rows; an empty ``target`` has equal shares. Other columns
    are not read.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = weigh(docs, gain, runs).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = written(rows, "scores")
    able = rows.filter(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    last = cutoff(able, k, finish)
    none = F.lit(None).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, none.alias("rank"))
    won = (F.col("n_words") >= least_words) & _ahead(last, True)
    # sorted ranges number their rows; the rows in earlier ranges are added
    place = F.monotonically_increasing_id()
    ranked = rows.filter(won).repartitionByRange(*draw_order()).sortWithinPartitions(*draw_order()).select(*columns, place.alias("_at"))
    ranked = written(ranked, "winners").withColumn("_part", F.shiftright("_at", 33))
    before, starts = 0, []
    for r in sorted(ranked.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row per range
        starts.append((r["_part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.join(F.broadcast(starts), "_part")
    ranked = ranked.select(*columns, rank.cast("long").alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.union(rows.filter(~won).select(*columns, none.alias("rank")))


def op11_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


# crc32 in SQL: a table of 256 remainders, then one step per byte
SQL = r"""
with crc as (select list(c order by i) as t from (
    select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i))),
words as (
  select 'd' as side, doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', null, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
each as (select side, row, unnest(w) as word from words),
per as (select side, row, word, count(*) as n from each group by all),
bucket as (
  select word, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as b
  from (select distinct word from per), crc),
hist as (select b, sum(case when side = 'd' then n else 0 end) as s, sum(case when side = 'b' then n else 0 end) as t
  from per join bucket using (word) group by b),
total as (select sum(s) as ss, sum(t) as tt from hist),
gain as (select b, cast(floor(1000 * ln(cast((t + 1) * (ss + 10000) as double) / cast((s + 1) * (tt + 10000) as double))) as bigint) as g from hist, total),
weights as (select row, sum(n * g) as weight from per join bucket using (word) join gain using (b) where side = 'd' group by row),
scored as (
  select doc_id, row, len(w) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
  from words left join weights using (row) where side = 'd'),
able as (select row, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from scored where n_features >= 20)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
  cast(case when place <= 10 * total // 100 then place end as bigint) as rank
from scored left join able using (row)
"""
