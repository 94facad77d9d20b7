"""Results per key that rows of any age may change, kept as revisions.

A stream cannot know that no earlier row will come, so nothing here is final. Rows go to an archive by day as they
arrive. For every key that a micro-batch touches, the batch operator runs again from the last row before the earliest
new one at which nothing earlier matters (a reset), and what it finds replaces what was found after that row. Results
that lie in the future (a silence that would grow, a hold time that would end) are found as well: they count once the
reader's time has passed them, without a further row, and are replaced if a row comes first.

Every micro-batch writes its own parts, so a retry overwrites them. ``compact`` folds the parts into one base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import alerts as A
from fleetlens.operators import presence as P
from fleetlens.session import cut_lineage
from fleetlens.sources import sinks as K

DAY_US = 86_400_000_000
#: Days before the earliest new row in which a reset is looked for first; older ones only for keys without one there.
LOOK_BACK_DAYS = 2
BEGINNING = -(1 << 62)


@dataclass(frozen=True)
class Revisions:
    """Results of ``evaluate`` over the rows of every key.

    ``at`` is the column of the rows' time in microseconds, ``reset`` tells rows at which nothing earlier matters.
    ``evaluate`` takes rows and gives (keys, ``start_us``, ...). ``own`` says whether results at the very time of a
    reset follow from the rows from there on (alerts), or belong to what came before (changes of a state).
    """

    root: str
    keys: tuple[str, ...]
    at: str
    reset: Column
    evaluate: Callable[[DataFrame], DataFrame]
    own: bool

    def take(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        spark, keys = rows.sparkSession, list(self.keys)
        day = F.floor(F.col(self.at) / DAY_US).cast("int")
        rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/rows/b={batch_id}")
        schema = T.StructType([*rows.schema.fields, T.StructField("b", T.IntegerType()), T.StructField("day", T.IntegerType())])
        known = spark.read.schema(schema).parquet(f"{self.root}/rows").filter(F.col("b") <= batch_id)
        new = known.filter(F.col("b") == batch_id).groupBy(*keys).agg(F.min(self.at).alias("_first"))
        spans = cut_lineage(self._spans(known, cut_lineage(new)))
        spans.select(*keys, (F.col("_from") - int(self.own)).alias("after_us")).write.mode("overwrite").parquet(f"{self.root}/spans/b={batch_id}")
        start = spans.agg(F.min("_from")).first()[0]
        if start is None:  # no rows
            return
        if start > BEGINNING:
            known = known.filter(F.col("day") >= start // DAY_US)
        again = known.join(spans, keys).filter(F.col(self.at) >= F.col("_from"))
        found = self.evaluate(again.select(*rows.columns)).join(spans.select(*keys, "_from"), keys)
        found = found.filter(F.col("start_us") > F.col("_from") - int(self.own)).drop("_from")
        found.write.mode("overwrite").parquet(f"{self.root}/found/b={batch_id}")

    def _spans(self, known: DataFrame, new: DataFrame) -> DataFrame:
        """(keys, _from): where each touched key is evaluated from."""
        keys = list(self.keys)
        first = new.agg(F.min("_first")).first()[0]
        if first is None:
            return new.select(*keys, F.col("_first").alias("_from"))
        near = first // DAY_US - LOOK_BACK_DAYS
        resets = known.filter(self.reset).select(*keys, self.at, "day")
        last = lambda rows, of: rows.join(of, keys).filter(F.col(self.at) < F.col("_first")).groupBy(*keys).agg(F.max(self.at).alias("_from"))
        recent = new.join(last(resets.filter(F.col("day") >= near), new), keys, "left")
        recent = cut_lineage(recent)
        older = last(resets.filter(F.col("day") < near), recent.filter("_from is null").select(*keys, "_first"))
        older = older.withColumnRenamed("_from", "_older")
        return recent.join(older, keys, "left").select(*keys, F.coalesce("_from", "_older", F.lit(BEGINNING)).alias("_from"))

    def current(self, spark: SparkSession) -> DataFrame | None:
        """What holds after all micro-batches so far; None before the first result."""
        keys, base = list(self.keys), self._base(spark)
        parts = [c for c in K.list_children(spark, f"{self.root}/found") if c.startswith("b=") and int(c[2:]) > base]
        rows = [] if base < 0 else [spark.read.parquet(f"{self.root}/base/v={base}").withColumn("b", F.lit(base))]
        if parts:
            rows.append(spark.read.parquet(f"{self.root}/found").filter(F.col("b") > base))
        if not rows:
            return None
        found = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        # a result goes when a later micro-batch has evaluated its key from before it
        spans = spark.read.parquet(f"{self.root}/spans").filter(F.col("b") > base)
        floor = found.select(*keys, "b", F.lit(None).cast("long").alias("after_us")).distinct()
        later = Window.partitionBy(*keys).orderBy(F.col("b").desc()).rangeBetween(Window.unboundedPreceding, -1)
        limits = spans.select(*keys, "b", "after_us").unionByName(floor).withColumn("_limit", F.min("after_us").over(later))
        limits = limits.groupBy(*keys, "b").agg(F.min("_limit").alias("_limit"))
        kept = found.join(limits, [*keys, "b"]).filter(F.col("_limit").isNull() | (F.col("start_us") <= F.col("_limit")))
        return kept.drop("b", "_limit")

    def _base(self, spark: SparkSession) -> int:
        done = [int(v[2:]) for v in K.list_children(spark, f"{self.root}/base") if K.exists(spark, f"{self.root}/base/{v}/_SUCCESS")]
        return max(done, default=-1)

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Fold the results up to ``batch_id``, the last micro-batch taken, into one base; readers go on meanwhile."""
        rows = self.current(spark)
        if rows is not None:
            K.write_versioned(rows, f"{self.root}/base", batch_id)


def run_revisions(rows: DataFrame, revisions: Revisions, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Everything available, micro-batch by micro-batch. ``prepare`` makes the rows that are kept of each micro-batch;
    what it reads, it reads anew every time."""

    def take(batch: DataFrame, batch_id: int) -> None:
        revisions.take(batch if prepare is None else prepare(batch), batch_id)

    (rows.writeStream.option("checkpointLocation", f"{revisions.root}/checkpoint").foreachBatch(take)
     .trigger(availableNow=True).start().awaitTermination())


def bound_by(versions: Callable[[], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Binds subjects of a micro-batch to the rules as ``versions()`` reads them then, each row to the version in force."""
    return lambda subjects: hit_rows(A.bind_rules_as_of(subjects, versions()))


def presence_revisions(root: str, offline_after_s: float = P.OFFLINE_AFTER_S, stale_after_s: float = P.STALE_AFTER_S) -> Revisions:
    """Presence of rows of ``presence.signals``: a data arrival forgets all before it."""
    changes = lambda rows: P.presence_changes(rows, None, offline_after_s, stale_after_s).withColumnRenamed("piece_us", "start_us")
    return Revisions(root, ("robot_id",), "at_us", F.col("up").isNull(), changes, False)


def presence_at(revisions: Revisions, spark: SparkSession, as_of: str) -> DataFrame:
    """The timeline of ``presence.presence_timeline`` up to ``as_of``, from everything that has arrived."""
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return P.timeline_of(revisions.current(spark).withColumnRenamed("start_us", "piece_us").filter(F.col("piece_us") < at), at)


def alert_revisions(root: str) -> Revisions:
    """Alerts of rows of ``alerts.with_hits``: a row that neither hits nor holds forgets all before it."""

    def intervals(rows: DataFrame) -> DataFrame:
        found = A.alert_intervals_by_time(rows.drop("_at_us"), None)
        return found.withColumn("start_us", F.unix_micros(F.col("started_at").cast("timestamp")))

    return Revisions(root, ("rule_id", "robot_id"), "_at_us", ~F.col("hit") & ~F.col("hold"), intervals, True)


def alerts_at(revisions: Revisions, spark: SparkSession, as_of: str) -> DataFrame:
    """Alerts that have started before ``as_of``, open ones without an end."""
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    rows = revisions.current(spark).filter(F.col("start_us") < at).drop("start_us")
    return rows.withColumn("resolved_at", F.when(F.unix_micros(F.col("resolved_at").cast("timestamp")) < at, F.col("resolved_at")))


def hit_rows(hits: DataFrame) -> DataFrame:
    """Rows of ``alerts.with_hits`` as ``alert_revisions`` keeps them."""
    columns = ["rule_id", "robot_id", "ts", "event_id", "num", "raw", "op", "limit", "clear_value", "hit", "hold", "for_seconds", "cooldown_min"]
    return hits.select(*columns, F.unix_micros(F.col("ts").cast("timestamp")).alias("_at_us"))

