"""Personal data in texts with built-in expressions only: regular expressions propose spans, checksums confirm
them, nearby context words adjust the score.

Patterns are written so that a long run of characters is tried once, not once per start: a match may begin only
where its run begins or where the match before it ended (``\\G``), and repetitions are possessive. They find the
same leftmost, non-overlapping matches as the plain patterns quoted beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import table

# The patterns of each kind; the plain form that they must agree with stands in the comment.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 16 to 19 digits; longer and shorter runs are passed over whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # two letters, two check digits, groups of letters and digits; confirmed by mod 97
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # only together with one of its context words
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Score of a confirmed span, what a context word adds, and the least score of a span that is kept.
# Confidence by kind.
CONFIDENCE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS = 0.3
LEAST = 0.5
#: Code points before a span that are searched for context words.
WINDOW = 40
# Context words by kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|address|host|server)\b",
    "card": r"(?i)\b(card|credit|visa|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|bank|account)\b",
    "ssn": r"(?i)\b(ssn|social security)\b",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")

    def weigh(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(each, weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """True if an IBAN (spaces allowed) leaves 1 modulo 97 once its first four signs are moved to the end."""
    tight = F.regexp_replace(text, "\x20", "")
    moved = F.concat(F.substring(tight, 5, 64), F.substring(tight, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(text, "\\."), lambda p: F.regexp_replace(p, "^0++", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return mod97(text)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of one kind; code points from 0, end exclusive; text is not null."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    empty = F.expr("cast(array() as array<struct<m: string, start: int, end: int>>)")

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(x["m"].alias("m"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    # the last gap has no match; it is the null partner that zip_with adds
    placed = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()),
                         F.struct(F.lit(0).alias("at"), empty.alias("out")), place)["out"]
    kept = F.filter(placed, lambda s: _confirmed(kind, s["m"]))

    def scored(s: Column) -> Column:
        from_ = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = F.substring(text, from_ + 1, s["start"] - from_)
        near = F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.least(F.lit(1.0), F.lit(CONFIDENCE[kind]) + near).alias("score"))

    return F.filter(F.transform(kept, scored), lambda s: s["score"] >= LEAST)


#: A cheap test that a text can hold the kind at all; the rest is skipped for texts without it.
# What every match of a kind contains.
SIGNS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}


def spans(text: Column, kinds=tuple(PATTERNS)) -> Column:
    """All spans by kind as listed, then start."""
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int, score: double>>)")
    return F.concat(none, *[F.when(text.rlike(SIGNS[k]), kind_spans(text, k)).otherwise(none) for k in kinds])


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``, the array of (kind, start, end, score) in ``text``; all rows and columns stay.

    Null texts count as empty and have no span. Base kinds (email, ip, card, phone) are kept whenever confirmed;
    ``iban`` must pass mod 97 and ``ssn`` needs a context word before it. A column called ``out`` is replaced.
    """
    return docs.withColumn(out, spans(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def redact(docs: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replaces every found span of ``text`` by its kind in brackets; overlapping spans make one replacement."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = F.array_sort(F.transform(F.col(pii), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"],
                     F.array(F.substring(body, state["at"] + 1, s["start"] - state["at"]),
                             F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), cut)
    rest = F.substring(body, done["at"] + 1, 2**31 - 1)
    replaced = F.concat(F.array_join(done["out"], ""), rest)
    return docs.withColumn(text, F.when(F.size(F.col(pii)) > 0, replaced).otherwise(F.col(f"`{text}`")))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return docs.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"),
                       _listed(F.col("pii")).alias("spans"))
