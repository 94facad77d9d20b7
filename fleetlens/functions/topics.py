"""MQTT topic filters and publish rights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.scalars import col

# What a robot may publish.
PUBLISH_LEAVES = ["status", "lwt", "samples", "raw"]


def filter_pattern(topic_filter: str, guard_system: bool = True) -> str | None:
    """Regular expression for one filter; None if it can match nothing.

    ``+`` is one level and ``#`` the rest. With ``guard_system`` a leading wildcard does
    not match topics that start with ``$``.
    """
    levels = topic_filter.split("/")
    if "#" in levels[:-1]:
        # a `#` that is not last ends the match there, whatever follows
        return None
    parts = ["[^/]*" if x == "+" else re.escape(x) for x in levels]
    guard = r"(?!\$)" if guard_system and levels[0] in ("+", "#") else ""
    if levels[-1] == "#":
        head = "/".join(parts[:-1])
        return f"^{guard}.*$" if not head else f"^{guard}{head}(/.*)?$"
    return f"^{guard}{'/'.join(parts)}$"


def topic_matches(topic, topic_filter: str, guard_system: bool = True) -> Column:
    pattern = filter_pattern(topic_filter, guard_system)
    return F.lit(False) if pattern is None else col(topic).rlike(f"(?s){pattern}")


def should_relay(topic, include: list[str], exclude: list[str]) -> Column:
    """True for topics that some ``include`` filter and no ``exclude`` filter matches; without ``include`` all count."""
    def hits(filters):
        found = F.lit(False)
        for f in filters:
            found = found | topic_matches(topic, f, guard_system=False)
        return found
    return ~hits(exclude) & (hits(include) if include else F.lit(True))


def publish_allowed(username, topic, action) -> Column:
    """A robot may publish on the four leaves of its own branch, and nothing else."""
    parts = F.split(col(topic), "/")
    return ((col(username) != "") & (col(action) == "publish") & (F.size(parts) == 3) & (F.get(parts, 0) == "fleet")
            & (F.get(parts, 1) == col(username)) & F.get(parts, 2).isin(PUBLISH_LEAVES))
