"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Along the source, in
order of size and id, these expectations add up; one random offset is added, and a document is emitted once for
every whole number that the running sum crosses. Ordered by size, neighbours weigh about the same, so the words
taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.llm.common import gapless_rank, table, written

#: No document is emitted more often than this, so no target exceeds this times its source's size.
MOST_COPIES = 3
SEED = "mix-2024"
#: Offsets are multiples of 2**-20, so sums of whole expectations stay exact.
OFFSET_BITS = 20


def word_count(text: Column) -> Column:
    """Runs of signs other than ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def cycling_weights(cycle: int = 3) -> Column:
    """Weights 1, 2, ... ``cycle`` repeating over the sources in code point order, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return ((place - 1) % cycle + 1).cast("double")


def source_targets(sized: DataFrame, weight: Column, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, none above ``most`` times its source.

    What a full source cannot take is dealt anew by weight, which fills sources in order of capacity per weight.
    The windows run over one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most))
    order = [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    per = per.withColumn("_level", level).withColumn("_at", F.row_number().over(W.orderBy(*order)))
    # the first source in this order that does not fill up sets the level of all later ones
    first = F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct("_at", "_level"))
    final = F.min(first).over(everything)["_level"]
    target = F.when(final.isNull() | (F.col("_cap") / F.col("_w") <= final), F.col("_cap")).otherwise(final * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random start of a source in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, OFFSET_BITS // 4), 16, 10).cast("double") / float(1 << OFFSET_BITS)


def mix_sources(docs: DataFrame, weight: Column | None = None, share: float = 1.0, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size): source_size, target and ``copies``, how often the mix emits it.

    Null sources are a source of their own, last in order. Sources without words get target 0 and no copies. Null
    ids come first in their source; rows that repeat are separate documents. Empty tables give no row.
    """
    targets = source_targets(docs, cycling_weights() if weight is None else weight, share, most)
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target")
    ranked = gapless_rank(docs.select("doc_id", "source", "size"), ["source"], ["size", "doc_id"], "_place")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("source"), seed)
    copies = F.floor(start + (F.col("_place") + 1) * rate) - F.floor(start + F.col("_place") * rate)
    return ranked.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def sized_documents(docs: DataFrame, size: Column) -> DataFrame:
    return written(docs.select("doc_id", "source", size.alias("size")), "sizes")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    docs = sized_documents(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
with sized as (
  select doc_id, source,
    case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end::bigint as size
  from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size,
    cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as w, 3e0 * sum(size) as cap
  from sized group by source
), levels as (
  select *, (sum(source_size) over (rows between unbounded preceding and unbounded following)
      - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level,
    row_number() over (order by cap / w, source nulls last) as place
  from per
), final as (select min_by(level, place) filter (where cap / w > level) as level from levels),
targets as (
  select source, source_size,
    case when f.level is null or cap / w <= f.level then cap else f.level * w end as target,
    cast('0x' || substr(md5('mix-2024:' || coalesce(source, chr(0))), 1, 5) as bigint) / 1048576e0 as start
  from levels, final f
), placed as (
  select *, row_number() over (partition by source order by size, doc_id) - 1 as place from sized
)
select p.doc_id, p.size, t.source_size, cast(t.target as double) as target,
  cast(p.size * case when t.source_size > 0 then
    floor(t.start + (p.place + 1) * (t.target / t.source_size)) - floor(t.start + p.place * (t.target / t.source_size))
    else 0 end as bigint) as taken
from placed p join targets t on p.source is not distinct from t.source
"""
