"""The catalogue of queries: list, search, show, run, run a group, check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    name: str
    group: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    @property
    def summary(self) -> str:
        return (self.run.__doc__ or "").strip().split("\n")[0]


class Registry:
    def __init__(self, tasks: list[Task]):
        self.tasks = {t.name: t for t in sorted(tasks, key=lambda t: (t.group, t.name))}

    def list(self, prefix: str = "", keyword: str = "", group: str = "") -> list[Task]:
        """Tasks whose name starts with ``prefix``, that mention ``keyword`` and whose group contains ``group``."""
        k = keyword.lower()
        return [t for t in self.tasks.values() if t.name.startswith(prefix) and group in t.group and (k in t.name.lower() or k in t.summary.lower() or k in t.group.lower())]

    def search(self, keyword: str) -> list[Task]:
        return self.list(keyword=keyword)

    def show(self, name: str) -> dict[str, str]:
        t = self.tasks[name]
        return {"name": t.name, "group": t.group, "summary": t.summary, "sql": "yes" if t.sql else "no"}

    def run(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.tasks[name].run(spark, sf_dir)

    def run_group(self, group: str, spark: SparkSession, sf_dir: str, keep_going: bool = False) -> dict[str, int | Exception]:
        """Rows of every task of a group in order of name; the first failure ends the run unless ``keep_going``."""
        out: dict[str, int | Exception] = {}
        for t in self.list(group=group):
            try:
                out[t.name] = t.run(spark, sf_dir).count()
            except Exception as e:
                if not keep_going:
                    raise
                out[t.name] = e
        return out

    def doctor(self) -> dict[str, bool]:
        """Whether each task has a callable and a summary."""
        return {t.name: callable(t.run) and bool(t.summary) for t in self.tasks.values()}


def chosen(tasks: DataFrame, prefix: str = "", keyword: str = "", group: str = "") -> DataFrame:
    """Rows of a table of tasks (name, grp, summary) whose name starts with ``prefix``, that mention ``keyword`` in either case
    and whose group contains ``group``: what ``Registry.list`` does for a table of any size."""
    k = F.lit(keyword.lower())
    mentioned = F.contains(F.lower("name"), k) | F.contains(F.lower("summary"), k) | F.contains(F.lower("grp"), k)
    return tasks.where(F.startswith("name", F.lit(prefix)) & F.contains("grp", F.lit(group)) & mentioned)
