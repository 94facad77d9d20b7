"""Scan of whole texts for credentials and personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a finding, and placeholders that do not.
PATTERNS = {
    "tailnet url": r"[\w-]+\.ts\.net",
    "tailnet ip": r"\b100\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}\b",
    "database dsn": r"postgres(?:ql)?://",
    "enroll token": r"\b[A-Z2-9]{4}-[A-Z2-9]{4}-[A-Z2-9]{4}\b",
    "tailnet authkey": r"tskey-auth-\S+",
    "private key": r"\bprivate_key\b\s*[:=]",
    "user path": r"[A-Za-z]:\\Users\\",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
}
#: Text every match of a pattern contains; looking for it first skips most regular expressions.
NEEDLES = {
    "tailnet url": ".ts.net", "tailnet ip": "100.", "database dsn": "postgres", "enroll token": "-",
    "tailnet authkey": "tskey-auth-", "private key": "private_key", "user path": "\\Users\\", "email": "@",
}
ALLOWED = ["XXXX-XXXX-XXXX", "tskey-auth-XXXXX", "tskey-auth-XXXX"]


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _findings(text: Column, label: str, pattern: str) -> Column:
    """Matches of one pattern with their line: newlines before a match are counted up from match to match."""
    pattern = f"(?U){pattern}"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    none = F.array().cast("array<struct<label:string,hit:string,line:int>>")

    def place(state: Column, x: Column) -> Column:
        line = state["line"] + _newlines(x["gap"])
        found = F.struct(F.lit(label).alias("label"), x["hit"].alias("hit"), line.alias("line"))
        return F.struct((line + _newlines(x["hit"])).alias("line"), F.concat(state["out"], F.array(found)).alias("out"))

    found = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), F.struct(F.lit(1).alias("line"), none.alias("out")), place)["out"]
    needle = NEEDLES.get(label)
    possible = text.rlike(pattern) if needle is None else text.contains(needle)
    return F.when(possible, found).otherwise(none)


def secret_scan(df: DataFrame, key: str, text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: (key, label, hit, line). ``more`` adds site-specific patterns."""
    lists = [_findings(F.col(text), label, p) for label, p in {**PATTERNS, **(more or {})}.items()]
    rows = df.select(key, F.explode(F.concat(*lists)).alias("f")).select(key, "f.label", "f.hit", "f.line")
    return rows.filter(~F.col("hit").isin(ALLOWED))
