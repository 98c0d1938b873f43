"""Which conventions a project follows: weighted signals over its files and packages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.glob import glob_regex


@dataclass(frozen=True)
class Signal:
    kind: str  # path_exists, composer_requires, class_suffix_frequency, interface_usage
    value: str
    weight: int
    threshold: int = 1


#: The built-in profiles.
PROFILES: dict[str, list[Signal]] = {
    "laravel-actions": [Signal("path_exists", "app/Actions", 40), Signal("composer_requires", "lorisleiva/laravel-actions", 30), Signal("class_suffix_frequency", "Action", 30, 5)],
    "laravel-api": [Signal("path_exists", "routes/api.php", 40), Signal("path_exists", "app/Http/Controllers/Api", 30), Signal("path_exists", "app/Http/Resources", 30)],
    "laravel-ddd-cqrs": [
        Signal("path_exists", "app/Modules/*/Domain", 40), Signal("path_exists", "app/Modules/*/Application/CommandHandlers", 25), Signal("path_exists", "app/Modules/*/Application/QueryHandlers", 15),
        Signal("class_suffix_frequency", "Handler", 10, 5), Signal("class_suffix_frequency", "Command", 10, 5),
    ],
    "laravel-ddd": [Signal("path_exists", "app/Modules/*/Domain", 50), Signal("path_exists", "app/Modules/*/Application", 30), Signal("path_exists", "app/Modules/*/Infrastructure", 20)],
    "laravel-default": [Signal("path_exists", "app/Http/Controllers", 40), Signal("path_exists", "app/Models", 30), Signal("composer_requires", "laravel/framework", 30)],
    "laravel-filament": [Signal("composer_requires", "filament/filament", 50), Signal("path_exists", "app/Filament", 30), Signal("class_suffix_frequency", "Resource", 20, 3)],
    "laravel-repository": [
        Signal("path_exists", "app/Repositories", 30), Signal("path_exists", "app/Services", 25), Signal("path_exists", "app/Contracts", 15), Signal("class_suffix_frequency", "Repository", 15, 3),
        Signal("class_suffix_frequency", "Service", 15, 3),
    ],
}


def profile_scores(files: DataFrame, packages: DataFrame, profiles: dict[str, list[Signal]] = PROFILES) -> DataFrame:
    """(project_slug, profile, score, position): 100 times the fired share of each profile's weights, best first, ties by name.

    ``files``: (project_slug, path, and optionally text); ``packages``: (project_slug, package). All signals are counted in one
    aggregation over the files and one over the packages. A directory exists if a file lies in it; ``*`` in a path stays within
    one directory level.
    """
    signals = sorted({s for ss in profiles.values() for s in ss}, key=lambda s: (s.kind, s.value, s.threshold))
    text = F.col("text") if "text" in files.columns else F.lit(None).cast("string")

    def hit(s: Signal):
        if s.kind == "path_exists":
            return F.col("path").rlike(glob_regex(s.value).replace("(?s)", "").replace(".*", "[^/]*").rstrip("$") + "(/|$)")
        if s.kind == "class_suffix_frequency":
            return F.col("path").startswith("app/") & F.col("path").endswith(f"{s.value}.php")
        if s.kind == "interface_usage":
            return F.col("path").startswith("app/") & F.coalesce(text.rlike(r"implements\s+(?:[\w\\,\s]+,\s*)?\Q" + s.value + r"\E"), F.lit(False))
        return F.lit(False)

    on_files = [(i, s) for i, s in enumerate(signals) if s.kind != "composer_requires"]
    on_packages = [(i, s) for i, s in enumerate(signals) if s.kind == "composer_requires"]
    a = files.groupBy("project_slug").agg(*[F.count_if(hit(s)).alias(f"s{i}") for i, s in on_files])
    b = packages.groupBy("project_slug").agg(*[F.count_if(F.col("package") == s.value).alias(f"s{i}") for i, s in on_packages]) if on_packages else packages.select("project_slug").distinct()
    rows = a.join(b, "project_slug", "full").na.fill(0)
    number = {s: i for i, s in enumerate(signals)}
    scores = []
    for name, own in profiles.items():
        total = sum(s.weight for s in own)
        fired = sum((F.when(F.col(f"s{number[s]}") >= s.threshold, s.weight).otherwise(0) for s in own), F.lit(0))
        scores.append(F.struct(F.lit(name).alias("profile"), (fired / F.lit(total or 1) * 100).alias("score")))
    rows = rows.select("project_slug", F.explode(F.array(*scores)).alias("p")).select("project_slug", "p.*")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("project_slug").orderBy(F.col("score").desc(), "profile")))
