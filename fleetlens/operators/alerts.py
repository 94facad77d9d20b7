"""Threshold rules over robot state: hits, hold time, hysteresis, intervals, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.scalars import decimal_text, from_micros, micros
from fleetlens.operators import presence as P
from fleetlens.operators.chain import FIRST, RATE, Rule, sampled
from fleetlens.operators.fold import fold
from fleetlens.operators.sequence import SLICE, Slices, drop_slice, lag, last_known, lead, next_known, running, scan
from fleetlens.session import broadcast_if_small, cut_lineage

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType()), T.StructField("rule_name", T.StringType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("scope", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("op", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("value2", T.DoubleType()), T.StructField("text_value", T.StringType()),
    T.StructField("for_seconds", T.DoubleType()), T.StructField("clear_value", T.DoubleType()),
    T.StructField("severity", T.StringType()), T.StructField("cooldown_min", T.DoubleType()),
    T.StructField("channels", T.ArrayType(T.StringType())), T.StructField("message_template", T.StringType()),
])

# Rule vocabulary and notification levels.
OPS = ["lt", "gt", "outside", "inside", "eq", "ne", "offline", "stale"]
NUMERIC_FIELDS = ["battery", "v", "w", "temp", "wifi", "odom"]
ANY_ROBOT = "*"


def load_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules in id order. A stream reads them again in every micro-batch."""
    return rules.filter("enabled").orderBy("rule_id")


def rules_x_robots(rules: DataFrame, robots: DataFrame) -> DataFrame:
    """Rules with the robots they apply to, as an equality join on the scope.

    A robot answers to its own id and to the wildcard, so no cross join is needed.
    """
    scoped = rules.withColumn("scope", F.coalesce("scope", F.lit(ANY_ROBOT)))
    names = robots.withColumn("scope", F.explode(F.array(F.lit(ANY_ROBOT), F.col("robot_id"))))
    return names.join(broadcast_if_small(scoped), "scope").drop("scope")


def watched_fields(rules: DataFrame) -> list[str]:
    """State fields some rule looks at; never more than there are fields."""
    known = rules.filter((F.col("source") == "field") & F.col("key").isin([*NUMERIC_FIELDS, "state", "errors"]))
    return sorted(r.key for r in known.select("key").distinct().collect())


def field_subjects(state: DataFrame, only: list[str] | None = None) -> DataFrame:
    """State rows -> (robot, ts, source, key, num, raw), one row per rule-addressable field.

    ``only`` keeps the fields rules watch, so that the others are never unpivoted.
    """
    entries = {f: F.struct(F.lit(f).alias("key"), F.col(f).alias("num"), F.col(f).cast("string").alias("raw"))
               for f in NUMERIC_FIELDS}
    count = F.when(F.col("errors") == "", 0).otherwise(F.size(F.split("errors", ","))).cast("double")
    entries["state"] = F.struct(F.lit("state").alias("key"), F.lit(None).cast("double").alias("num"), F.col("state").alias("raw"))
    entries["errors"] = F.struct(F.lit("errors").alias("key"), count.alias("num"), count.cast("string").alias("raw"))
    picked = [e for f, e in entries.items() if only is None or f in only]
    if not picked:
        return field_subjects(state).limit(0)
    rows = state.select("robot_id", "ts", "event_id", F.lit("field").alias("source"), F.explode(F.array(*picked)).alias("_e"))
    return rows.select("robot_id", "ts", "event_id", "source", "_e.key", "_e.num", "_e.raw")


def topic_subjects(samples: DataFrame) -> DataFrame:
    return samples.select("robot_id", "ts", "event_id", F.lit("topic").alias("source"), F.col("topic").alias("key"), "num",
                          F.coalesce(F.col("num").cast("string"), F.col("payload")).alias("raw"))


def _in_scope(rows: DataFrame) -> DataFrame:
    """A row answers to its own robot and to the wildcard, so scope is part of a join's key."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(ANY_ROBOT), F.col("robot_id"))))


def bind_rules(subjects: DataFrame, rules: DataFrame, more: list[str] = ()) -> DataFrame:
    """Rule columns, with ``more`` of them, beside every subject row they watch (equality on source, key and scope)."""
    picked = rules.select("rule_id", F.coalesce("scope", F.lit(ANY_ROBOT)).alias("scope"), "source", "key", "op", F.col("value").alias("limit"), F.col("value2").alias("limit2"),
                          "text_value", "for_seconds", "clear_value", "severity", "cooldown_min", *more)
    return _in_scope(subjects).join(broadcast_if_small(picked), ["source", "key", "scope"]).drop("scope")


def bind_rules_as_of(subjects: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of ``with_hits`` under the version of each rule in force at the row's time.

    ``versions`` are rules with ``valid_from``; a version holds until the next one of its rule. Rows before a rule's
    first version are not its rows. Under a version that is not enabled nothing hits or holds, so an alert ends with
    its rule.
    """
    own = Window.partitionBy("rule_id").orderBy("valid_from")
    picked = versions.select(
        "rule_id", F.coalesce("scope", F.lit(ANY_ROBOT)).alias("scope"), "source", "key", "op", F.col("value").alias("limit"), F.col("value2").alias("limit2"),
        "text_value", "for_seconds", "clear_value", "severity", "cooldown_min", "enabled", "valid_from", F.lead("valid_from").over(own).alias("valid_to"))
    rows = _in_scope(subjects).join(broadcast_if_small(picked), ["source", "key", "scope"]).drop("scope")
    rows = rows.filter((F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to"))))
    on = F.coalesce("enabled", F.lit(False))
    return with_hits(rows).withColumns({"hit": F.col("hit") & on, "hold": F.col("hold") & on})


def presence_subjects(timeline: DataFrame) -> DataFrame:
    """Presence as a subject at every change: the word, and 0 while the robot is ok, 1 otherwise."""
    num = F.when(F.col("presence") == P.OK, 0.0).otherwise(1.0)
    return timeline.select("robot_id", F.col("start_ts").alias("ts"), F.lit(0).cast("long").alias("event_id"), F.lit("presence").alias("source"),
                           F.lit("").alias("key"), num.alias("num"), F.col("presence").alias("raw"))


def extra_keys(rules: DataFrame) -> list[str]:
    """Keys that rules on fields look at and that are no fields of their own; never more than there are rules."""
    known = [*NUMERIC_FIELDS, "state", "errors", "age"]
    return sorted(r.key for r in rules.filter((F.col("source") == "field") & ~F.col("key").isin(known)).select("key").distinct().collect())


def extra_subjects(status: DataFrame, only: list[str], order=("ts", "event_id")) -> DataFrame:
    """Messages with a map ``extra`` -> subjects of the watched keys; a key keeps its value until it is sent again."""
    entries = F.filter(F.map_entries("extra"), lambda e: e["key"].isin(only) if only else F.lit(False))
    rows = status.select("robot_id", F.col(order[0]).alias("ts"), "event_id", F.explode(entries).alias("_e"))
    yes = F.when(F.col("_e.value") == "true", 1.0).when(F.col("_e.value") == "false", 0.0)
    return rows.select("robot_id", "ts", "event_id", F.lit("field").alias("source"), F.col("_e.key").alias("key"),
                       F.coalesce(yes, decimal_text("_e.value")).alias("num"), F.col("_e.value").alias("raw"))


def age_rows(data: DataFrame, rules: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Rows of rules on ``age``, the seconds since a robot's last data, bound to the rules.

    Age starts at 0 with every arrival and grows by itself. A rule can only change its mind where age reaches one of
    its limits, so there is a row at each arrival and, if no other arrival comes first, at each limit and just after it.
    """
    # the next arrival is the same for every rule, and the steps are the same for every row: both come before the join
    seen = drop_slice(scan(data.select("robot_id", "ts", "event_id").withColumn("_us", micros("ts")), "robot_id", ["ts", "event_id"],
                           {"_next": lead("_us")}, F.col("_us"), slices))
    limits = F.transform(F.array_compact(F.array("value", "value2", "clear_value")), lambda x: F.round(x * 1e6).cast("long"))
    steps = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), limits, F.transform(limits, lambda x: x + 1)))
    about = rules.filter("source = 'field' and key = 'age'").withColumn("_step", F.explode(F.filter(steps, lambda x: x >= 0)))
    rows = bind_rules(seen.withColumns({"source": F.lit("field"), "key": F.lit("age")}), about, ["_step"])
    rows = rows.filter(F.col("_next").isNull() | (F.col("_us") + F.col("_step") < F.col("_next")))
    age = F.col("_step") / F.lit(1e6)
    return rows.withColumns({"ts": from_micros(F.col("_us") + F.col("_step")), "num": age, "raw": age.cast("string")}).drop("_us", "_next", "_step")


#: Silence that an offline rule without a value of its own waits for, in seconds.
OFFLINE_VALUE_S = 60.0


def offline_rows(signals: DataFrame, rules: DataFrame, offline_after_s: float = P.OFFLINE_AFTER_S,
                 stale_after_s: float = P.STALE_AFTER_S, slices: Slices | None = None) -> DataFrame:
    """Rows of offline rules: hit while the robot is not ok, or its last data is older than the rule's value.

    A robot that is ok has data no older than ``offline_after_s``, so both conditions are one: presence under the
    smaller of the two limits.
    """
    picked = rules.filter("op = 'offline'").select(
        "rule_id", F.coalesce("scope", F.lit(ANY_ROBOT)).alias("scope"), "op", F.col("value").alias("limit"), "for_seconds", "cooldown_min",
        F.round(F.least(F.lit(offline_after_s), F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(OFFLINE_VALUE_S))) * 1e6).cast("long").alias("_off"))
    rows = _in_scope(signals).join(broadcast_if_small(picked), "scope").drop("scope")
    steps = {"_seen": last_known("seen_us"), "_link": last_known(F.when(F.col("up").isNotNull(), F.struct("up", "at_us"))), "_next": lead("at_us")}
    rows = drop_slice(scan(rows, KEYS, ["at_us", "rank", "event_id"], steps, F.col("at_us"), slices))
    end = F.coalesce("_next", F.lit(1 << 62))
    cuts = F.array_distinct(F.filter(F.array("at_us", F.col("_seen") + F.col("_off") + 1), lambda c: c.isNotNull() & (c >= F.col("at_us")) & (c < end)))
    rows = rows.withColumn("_piece", F.explode(cuts))
    down = ~F.coalesce(F.col("_link.up"), F.lit(True)) & (F.col("_link.at_us") >= F.coalesce("_seen", F.lit(0)))
    hit = down | F.col("_seen").isNull() | (F.col("_piece") - F.col("_seen") > F.col("_off"))
    # at one instant data comes before a link message
    place = F.col("event_id") + F.col("rank").cast("long") * (1 << 48)
    return rows.select(*KEYS, from_micros("_piece").alias("ts"), place.alias("event_id"), F.lit(None).cast("double").alias("num"),
                       F.lit(None).cast("string").alias("raw"), "op", "limit", F.lit(None).cast("double").alias("clear_value"), hit.alias("hit"),
                       hit.alias("hold"), "for_seconds", "cooldown_min")


HIT_COLUMNS = ["rule_id", "robot_id", "ts", "event_id", "num", "raw", "op", "limit", "clear_value", "hit", "hold", "for_seconds", "cooldown_min"]


def rule_coverage(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """Every rule with the number of subject rows it has; rules whose subject never comes have 0."""
    counts = rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("subject_rows"))
    return rules.select("rule_id", "rule_name").join(counts, "rule_id", "left").withColumn("subject_rows", F.coalesce("subject_rows", F.lit(0)))


def reminders_by_time(intervals: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Repeats of alerts of any kind as a clock sends them: every ``cooldown_min`` from the start until the end."""
    until = F.unix_micros(F.lit(as_of).cast("timestamp"))
    step = F.round(F.col("cooldown_min") * 60e6).cast("long")
    about = broadcast_if_small(rules.filter("cooldown_min > 0").select("rule_id", step.alias("_step")))
    rows = intervals.join(about, "rule_id").withColumns({"_a": micros("started_at"), "_b": F.coalesce(micros("resolved_at"), until)})
    times = F.sequence(F.col("_a") + F.col("_step"), F.col("_b") - 1, F.col("_step"))
    rows = rows.filter(F.col("_a") + F.col("_step") < F.col("_b"))
    return rows.select("rule_id", "robot_id", F.explode(times).alias("_at")).select("rule_id", "robot_id", from_micros("_at").alias("ts"))


def predicate(op="op", num="num", raw="raw", limit="limit", limit2="limit2", text="text_value") -> Column:
    """Is the rule hit? A missing number or threshold is no hit."""
    op, num, raw, limit, text = (F.col(c) if isinstance(c, str) else c for c in (op, num, raw, limit, text))
    upper = F.coalesce(F.col(limit2) if isinstance(limit2, str) else limit2, limit)
    within = (num >= limit) & (num <= upper)
    hit = (F.when(op == "eq", raw.eqNullSafe(text)).when(op == "ne", ~raw.eqNullSafe(text))
           .when(op == "lt", num < limit).when(op == "gt", num > limit)
           .when(op == "inside", within).when(op == "outside", ~within))
    return F.coalesce(hit, F.lit(False))


def with_hits(bound: DataFrame) -> DataFrame:
    """``hit`` against the trigger limit and ``hold`` against the clear limit."""
    clear = F.when(F.col("op").isin("lt", "gt"), F.coalesce("clear_value", "limit")).otherwise(F.col("limit"))
    return bound.withColumns({"hit": predicate(), "hold": predicate(limit=clear)})


ORDER = ["ts", "event_id"]
KEYS = ["rule_id", "robot_id"]


def _sane(rows: DataFrame) -> Column:
    """A clear limit that is not stricter than the trigger: every hit is also a hold."""
    c, v = F.col("clear_value"), F.col("limit")
    return ~F.coalesce(((F.col("op") == "lt") & (c < v)) | ((F.col("op") == "gt") & (c > v)), F.lit(False))


def firing_rows(rows: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Rows with ``fires`` and the number of the hold run they lie in (sane clear limits only).

    Runs of ``hold`` rows start after a row without it; inside one, the alert fires on the
    first ``hit`` row whose run of hits is old enough and which did not start that run.
    """
    us = micros("ts")
    rows = scan(rows, KEYS, ORDER, {"_hit_before": lag("hit"), "_island": running((~F.col("hold")).cast("int"))}, us, slices)
    starts = F.col("hit") & ~F.coalesce("_hit_before", F.lit(False))
    rows = scan(rows, KEYS, ORDER, {"_run_us": last_known(F.when(starts, us))})
    held_s = (us - F.col("_run_us")) / F.lit(1e6)
    return rows.withColumn("fires", F.col("hit") & ~starts & (held_s >= F.col("for_seconds")))


def _first_of_runs(rows: DataFrame, due: str) -> DataFrame:
    """The first ``due`` row of every hold run, with ``_stop_us``, the time of the row that ends the run.

    Of due rows and rows that do not hold, those that differ from the one before are in turn the first due row of a
    run and the end of that run. Everything goes forward, so rows are sorted once and most are gone before the last
    two scans.
    """
    kept = rows.filter(F.col(due) | ~F.col("hold"))
    if SLICE in kept.columns:  # scans of slices read their rows twice
        kept = cut_lineage(kept)
    kept = scan(kept, KEYS, ORDER, {"_due_before": lag(due)}).filter(F.col(due) != F.coalesce("_due_before", F.lit(False)))
    return drop_slice(scan(kept, KEYS, ORDER, {"_stop_us": lead(micros("ts"))})).filter(due)


def alert_intervals(rows: DataFrame, slices: Slices | None = None) -> DataFrame:
    """One row per alert: (rule, robot, started, resolved or null, value at the start)."""
    first = _first_of_runs(firing_rows(rows.filter(_sane(rows)), slices).drop("_island"), "fires")
    out = first.select(*KEYS, F.col("ts").alias("started_at"), from_micros("_stop_us").alias("resolved_at"),
                       F.col("num").alias("value"), "raw")
    return out.unionByName(_strict_intervals(rows, slices))


def alert_intervals_by_time(rows: DataFrame, as_of: str | None, slices: Slices | None = None) -> DataFrame:
    """Alerts as a clock sees them: the last known value holds until the next row, up to ``as_of`` (None: for ever).

    A run of hits fires once it is ``for_seconds`` old, whether or not a row comes at that instant; the alert ends
    at the first row that does not hold. Under a clear limit stricter than the trigger a clock would start and end
    alerts at every tick, so such rules follow rows, as in ``alert_intervals``.
    """
    us, until = micros("ts"), F.lit(1 << 62) if as_of is None else F.unix_micros(F.lit(as_of).cast("timestamp"))
    rows = rows.filter(us < until)
    strict = _strict_intervals(rows, slices)
    rows = rows.filter(_sane(rows))
    rows = scan(rows, KEYS, ORDER, {"_hit_before": lag("hit"), "_next_us": lead(us)}, us, slices)
    starts = F.col("hit") & ~F.coalesce("_hit_before", F.lit(False))
    rows = scan(rows, KEYS, ORDER, {"_run_us": last_known(F.when(starts, us))})
    rows = rows.withColumn("_fire_us", F.col("_run_us") + F.round(F.col("for_seconds") * 1e6).cast("long"))
    due = F.col("hit") & (F.col("_fire_us") >= us) & (F.col("_fire_us") < F.coalesce("_next_us", until))
    first = _first_of_runs(rows.withColumn("_due", due), "_due")
    return first.select(*KEYS, from_micros("_fire_us").alias("started_at"), from_micros("_stop_us").alias("resolved_at"),
                        F.col("num").alias("value"), "raw").unionByName(strict)


STRICT = T.StructType([T.StructField("at_us", T.LongType()), T.StructField("pending_us", T.LongType()),
                       T.StructField("firing", T.BooleanType()), T.StructField("sent_us", T.LongType())])
MARK = T.StructType([T.StructField("mark", T.StringType())])


def alert_step(now, row):
    """ok -> pending -> firing -> ok, for clear limits stricter than the trigger."""
    at, hit, hold, for_s, cool_us = row
    pending, firing, sent = now[1:] if now else (None, False, None)
    if firing and not hold:
        return (at, None, False, None), ("stop",)
    if firing:
        if cool_us > 0 and at - sent >= cool_us:
            return (at, None, True, at), ("repeat",)
        return (at, None, True, sent), (None,)
    if not hit:
        return (at, None, False, None), (None,)
    if pending is None:
        return (at, at, False, None), (None,)
    if (at - pending) / 1e6 >= for_s:
        return (at, None, True, at), ("start",)
    return (at, pending, False, None), (None,)


def _strict_marks(rows: DataFrame, slices: Slices | None) -> DataFrame:
    """A firing alert may resolve while the trigger still hits: needs the state machine."""
    rows = _with_clock(rows.filter(~_sane(rows))).select(*KEYS, *ORDER, "num", "raw", "hit", "hold", "for_seconds", "_at", "_cool")
    marks = fold(rows, KEYS, ORDER, ["_at", "hit", "hold", "for_seconds", "_cool"], alert_step, STRICT, MARK,
                 F.col("_at"), slices)
    return marks.filter("mark is not null")


def _with_clock(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_at": micros("ts"), "_cool": F.round(F.col("cooldown_min") * 60e6).cast("long")})


def _strict_intervals(rows: DataFrame, slices: Slices | None) -> DataFrame:
    # reminders do not matter here
    marks = drop_slice(scan(_strict_marks(rows.withColumn("cooldown_min", F.lit(0.0)), slices), KEYS, ORDER,
                            {"_stop_us": next_known(F.when(F.col("mark") == "stop", F.col("_at")))}, F.col("_at"), slices))
    return marks.filter("mark = 'start'").select(
        *KEYS, F.col("ts").alias("started_at"), from_micros("_stop_us").alias("resolved_at"),
        F.col("num").alias("value"), "raw")


def presence_intervals(timeline: DataFrame, rules: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Alerts of the offline / stale ops: presence runs that outlast the hold time."""
    picked = rules.filter(F.col("op").isin("offline", "stale")).withColumn(
        "presence", F.when(F.col("op") == "stale", F.array(F.lit(P.STALE)))
        .otherwise(F.array(F.lit(P.UNKNOWN), F.lit(P.STALE), F.lit(P.OFFLINE))))
    picked = picked.select("rule_id", F.coalesce("scope", F.lit(ANY_ROBOT)).alias("scope"), "for_seconds", F.explode("presence").alias("presence"))
    hits = _in_scope(timeline).join(broadcast_if_small(picked), ["presence", "scope"]).drop("scope")
    hits = hits.withColumns({"_a": micros("start_ts"), "_b": micros("end_ts")})
    if slices is not None:
        hits = slices.assign(hits, F.col("_a"))
    # touching pieces (stale, then offline) form one run
    hits = scan(hits, KEYS, ["_a"], {"_prev_end": lag("_b")})
    hits = drop_slice(scan(hits, KEYS, ["_a"], {"_run": running(F.coalesce((F.col("_prev_end") != F.col("_a")).cast("int"), F.lit(1)))}))
    runs = hits.groupBy(*KEYS, "_run", "for_seconds").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.bool_or("current").alias("open"))
    fire = F.col("_a") + F.round(F.col("for_seconds") * 1e6).cast("long")
    return runs.filter(fire < F.col("_b")).select(
        *KEYS, from_micros(fire).alias("started_at"), F.when(~F.col("open"), from_micros("_b")).alias("resolved_at"))


def reminders(rows: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Repeat notifications while an alert keeps firing, at least ``cooldown_min`` apart."""
    strict = _strict_marks(rows, slices).filter("mark = 'repeat'").select(*KEYS, "ts", "num")
    rows = firing_rows(rows.filter(_sane(rows)), slices)
    us = micros("ts")
    island_start = F.when(~F.col("hold"), us)
    rows = drop_slice(scan(rows, KEYS, ORDER, {"_fired_us": last_known(F.when(F.col("fires"), us)),
                                               "_island_us": last_known(island_start)}))
    burning = rows.filter(F.col("hold") & F.col("_fired_us").isNotNull()
                          & (F.col("_fired_us") > F.coalesce("_island_us", F.lit(-1))) & (F.col("cooldown_min") > 0))
    burning = burning.select(*KEYS, *ORDER, "num", "cooldown_min", "_island")  # what goes through Python
    kept = _spaced_by_cooldown(burning, slices)
    return kept.filter(~F.col("_opening")).select(*KEYS, "ts", "num").unionByName(strict)


def _spaced_by_cooldown(rows: DataFrame, slices: Slices | None) -> DataFrame:
    """Of each alert's rows the first, which opened it, and every one a cooldown after the last one kept."""
    rows = _with_clock(rows).withColumn("_island", F.col("_island").cast("long"))
    none = F.lit(None)
    kept = sampled(rows, [*KEYS, "_island"], ORDER, micros("ts"), none, none.cast("string"), F.col("_cool"), Rule(on_change=False), slices)
    return kept.filter(F.col("decision") != RATE).withColumn("_opening", F.col("decision") == FIRST).drop("decision")


def active_alerts(intervals: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Open alerts with their age, critical first, then oldest."""
    named = intervals.filter("resolved_at is null").join(
        broadcast_if_small(rules.select("rule_id", "rule_name", "severity")), "rule_id")
    age = (micros(F.lit(as_of).cast("timestamp_ntz")) - micros("started_at")) / F.lit(1e6)
    return named.withColumn("for_s", F.round(age, 1)).orderBy(F.col("severity") != "critical", "started_at")


# ------------------------------------------------------------------ texts

PLACEHOLDERS = ["robot", "id", "key", "value", "limit", "limit2", "rule", "severity"]


def shown_value(num="num", raw="raw") -> Column:
    return F.coalesce(F.bround(F.col(num), 3).cast("string"), F.col(raw))


def alert_message(robot: Column, robot_id: Column, key: Column, shown: Column, limit: Column, limit2: Column,
                  rule: Column, severity: Column, op: Column, text: Column, template: Column) -> Column:
    """Text of an alert: the rule's template, or wording by op when it is absent or broken."""
    parts = dict(zip(PLACEHOLDERS, (robot, robot_id, key, shown, limit, limit2, rule, severity)))
    filled = F.trim(template)
    for name, value in parts.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("None")))
    bare = F.trim(template)
    for name in PLACEHOLDERS:
        bare = F.replace(bare, F.lit("{" + name + "}"), F.lit(""))
    usable = (F.trim(template) != "") & ~bare.rlike(r"[{}]")
    subject = F.coalesce(F.nullif(key, F.lit("")), F.lit("state"))
    lead = F.concat(robot, F.lit(" "), subject, F.lit("="), F.coalesce(shown, F.lit("None")))
    span = F.concat(limit.cast("string"), F.lit("~"), F.coalesce(limit2.cast("string"), F.lit("None")))
    auto = (F.when(op == "offline", F.concat(robot, F.lit(" offline")))
            .when(op == "stale", F.concat(robot, F.lit(" connected but silent")))
            .when(op == "lt", F.concat(lead, F.lit(" below "), limit.cast("string")))
            .when(op == "gt", F.concat(lead, F.lit(" above "), limit.cast("string")))
            .when(op == "outside", F.concat(lead, F.lit(" outside "), span))
            .when(op == "inside", F.concat(lead, F.lit(" inside "), span))
            .otherwise(F.concat(lead, F.lit(" ("), op, F.lit(" "), F.coalesce(text, F.lit("None")), F.lit(")"))))
    return F.when(F.coalesce(usable, F.lit(False)), filled).otherwise(auto)


def describe_rule(source: Column, key: Column, op: Column, value: Column, value2: Column, text: Column) -> Column:
    subject = F.when(source == "presence", "presence").otherwise(F.coalesce(F.nullif(key, F.lit("")), F.lit("?")))
    number, upper = value.cast("string"), value2.cast("string")
    return (F.when(op == "offline", F.concat(F.lit("offline for more than "), F.coalesce(number, F.lit("60")), F.lit("s")))
            .when(op == "stale", F.lit("connected but data stopped"))
            .when(op.isin("eq", "ne"), F.concat(subject, F.lit(" "), op, F.lit(' "'), text, F.lit('"')))
            .when(op.isin("outside", "inside"), F.concat(subject, F.lit(" "), op, F.lit(" "), number, F.lit("~"), upper))
            .otherwise(F.concat(subject, F.lit(" "), op, F.lit(" "), number)))


def alert_log(intervals: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """Alert rows with rule name, severity and message."""
    r = broadcast_if_small(rules.select("rule_id", "rule_name", "severity", "key", "op", F.col("value").alias("limit"), "value2",
                                        "text_value", "message_template", "channels"))
    rows = intervals.join(r, "rule_id").join(names, "robot_id", "left")
    return rows.withColumn("message", alert_message(
        F.coalesce("robot_name", "robot_id"), F.col("robot_id"), F.col("key"), shown_value("value", "raw"), F.col("limit"),
        F.col("value2"), F.col("rule_name"), F.col("severity"), F.col("op"), F.col("text_value"), F.col("message_template")))


def notification_outbox(log: DataFrame, repeats: DataFrame, rules: DataFrame, channels: list[str]) -> DataFrame:
    """One row per (notification, accepted channel). Resolutions go out for critical rules only."""
    over = (F.col("severity") == "critical") & F.col("resolved_at").isNotNull()
    notes = F.array(F.struct(F.col("started_at").alias("ts"), F.lit("fired").alias("reason")),
                    F.when(over, F.struct(F.col("resolved_at").alias("ts"), F.lit("resolved").alias("reason"))))
    told = log.select("rule_id", "robot_id", F.explode(F.array_compact(notes)).alias("n")).select(
        "rule_id", "robot_id", "n.ts", "n.reason")
    again = repeats.select("rule_id", "robot_id", "ts", F.lit("repeat").alias("reason"))
    about = broadcast_if_small(rules.select("rule_id", "rule_name", "severity", "channels"))
    rows = told.unionByName(again).join(about, "rule_id")
    enabled = F.array(*[F.lit(c) for c in channels])
    wanted = F.array_intersect(F.coalesce("channels", enabled), enabled)
    resolved = F.col("reason") == "resolved"
    critical = F.col("severity") == "critical"
    return rows.select(
        "rule_id", "robot_id", "ts", "reason", F.explode(wanted).alias("channel"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule_name")).alias("title"),
        F.when(resolved, 3).when(critical, 5).otherwise(4).alias("priority"),
        F.when(resolved, "white_check_mark").when(critical, "rotating_light").otherwise("warning").alias("tag"))
