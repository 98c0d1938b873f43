"""Shaping of results: trimmed lists with their true size, coverage, registries of queries and plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 100


@dataclass
class Response:
    """Rows up to the limit, how many there were, and what was cut: ``rows:<before>→<after>``."""

    rows: DataFrame
    total: int
    returned: int
    truncated: bool = False
    truncated_lists: list[str] = field(default_factory=list)
    error_code: str | None = None


def trim(df: DataFrame, order: list[str], max_items: int = MAX_ITEMS, name: str = "rows") -> Response:
    """The first ``max_items`` rows in order (0 for all), with the count before trimming."""
    total = df.count()
    if not max_items or total <= max_items:
        return Response(df.orderBy(*order), total, total)
    return Response(df.orderBy(*order).limit(max_items), total, max_items, True, [f"{name}:{total}→{max_items}"])


def trim_arrays(df: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Array columns cut to ``max_items``, with ``truncated_lists`` naming those that were longer."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if not arrays:
        return df.withColumn("truncated_lists", F.array().cast("array<string>"))
    noted = F.filter(F.array(*[F.when(F.size(c) > max_items, F.concat(F.lit(f"{c}:"), F.size(c).cast("string"), F.lit(f"→{max_items}"))) for c in arrays]), lambda x: x.isNotNull())
    return df.withColumn("truncated_lists", noted).withColumns({c: F.slice(c, 1, max_items) for c in arrays})


def coverage(meta: DataFrame) -> DataFrame:
    """(project_slug, calls_indexed, embedder_id, indexed_at) from the latest successful run of each project."""
    ok = meta.where("run_status = 'ok'")
    last = ok.groupBy("project_slug").agg(F.max_by(F.struct("lsp_server", "embedder_id", "indexed_at"), F.struct("started_at", "run_id")).alias("m"))
    return last.select("project_slug", F.col("m.lsp_server").isNotNull().alias("calls_indexed"), F.col("m.embedder_id").alias("embedder_id"), F.col("m.indexed_at").alias("indexed_at"))


def attribution(package: str, version: str | None, authors: list[str], homepage: str | None = None) -> dict:
    """A package block with a footer of at most three lines and three authors."""
    lines = [f"Source: {package}" + (f" {version}" if version else ""), "Authors: " + ", ".join(authors[:3]) + (" and others" if len(authors) > 3 else "") if authors else None, homepage]
    return {"package": {"name": package, "version": version}, "footer": [x for x in lines if x]}


class Registry:
    """Named factories; a name can be taken once."""

    def __init__(self) -> None:
        self._items: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable) -> None:
        if name in self._items:
            raise ValueError(f"already registered: {name}")
        self._items[name] = factory

    def get(self, name: str) -> Callable:
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)
