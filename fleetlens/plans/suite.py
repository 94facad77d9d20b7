"""Registry of named queries: a DataFrame builder and, where possible, its SQL text."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.inputs import DUCK, SPARK, TABLES, view_sql
from fleetlens.session import configure

#: Shuffled bytes that one task reads, unless the session says otherwise. Rows of these tables take ten to twenty times
#: their shuffled size in a sort, and several sorts share a task.
TASK_BYTES = "8m"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

_VIEW = re.compile(r"\bfx_\w+")


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """Views ``text`` uses, directly or through other views, in definition order."""
    todo, found = [text], set()
    while todo:
        for name in _VIEW.findall(todo.pop()):
            if name in views and name not in found:
                found.add(name)
                todo.append(views[name])
    return [v for v in views if v in found]


class Tables:
    """The given tables and the fleet views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        if spark.conf.get(ADVISORY, None) is None:
            spark.conf.set(ADVISORY, TASK_BYTES)
        self.path = path.rstrip("/")
        self.tag = hashlib.md5(self.path.encode()).hexdigest()[:8]
        self._views = view_sql(SPARK)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, f"{name}.parquet"))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views by name."""
        views = _needed(text, self._views)
        body = with_views(text, views, self._views)
        for table in TABLES:
            if re.search(rf"\bfrom {table}\b|\bjoin {table}\b", body):
                name = f"given_{table}_{self.tag}"
                self.table(table).createOrReplaceTempView(name)
                body = re.sub(rf"\b(from|join) {table}\b", rf"\1 {name}", body)
        return self.spark.sql(body)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")


def with_views(text: str, names: list[str], views: dict[str, str]) -> str:
    if not names:
        return text
    ctes = ",\n".join(f"{n} as ({views[n]})" for n in names)
    text = text.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{text[len('with recursive '):]}"
    if text.lower().startswith("with "):
        return f"with {ctes},\n{text[5:]}"
    return f"with {ctes}\n{text}"


class Suite:
    def __init__(self) -> None:
        self.builders: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register ``fn(tables) -> DataFrame``; ``sql`` is the checking engine's text."""

        def register(fn: Callable[[Tables], DataFrame]):
            self.builders[name] = lambda spark, path: fn(Tables(spark, path))
            if sql is not None:
                views = view_sql(DUCK)
                self.sql[name] = with_views(sql, _needed(sql, views), views)
            return fn

        return register
