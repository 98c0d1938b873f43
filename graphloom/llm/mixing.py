"""Mixing sources to target shares of the total size, repeating small sources at most a capped number of times.

Tokens are totalled per source, each source's repetition rate follows from its target, and every document is emitted
floor(rate) times plus once more if a coin seeded by its id says so, with the fraction as its probability. The decision about
one document needs nothing but its id, its source's rate and the source's seed. Where a source has few or very uneven
documents, independent coins miss its share by much; so every source tries a fixed number of seeds in one aggregation and
keeps the one whose total comes nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.truncation import source_key

MAX_TARGETS = 10_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets by canonical source; spellings of one source are added up, with the smaller cap. Null or negative shares count as 0, a null cap as 1."""
    rows = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
    rows = rows.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [Target(r["source"], float(r["share"]), int(r["repeats"])) for r in rows]


def repetition_rates(targets: list[Target], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """How often each source's documents appear on average.

    Sources without tokens, share or permitted repeat cannot contribute; the others' shares are scaled to sum to 1. The total
    is the largest at which every source can give its share within its cap, or ``total`` if that is smaller.
    """
    usable = [t for t in targets if tokens.get(t.source, 0) > 0 and t.share > 0 and t.repeats > 0]
    whole = sum(t.share for t in usable)
    if not usable:
        return {}
    most = min(t.repeats * tokens[t.source] * whole / t.share for t in usable)
    size = most if total is None else min(most, total)
    return {t.source: min(float(t.repeats), size * t.share / whole / tokens[t.source]) for t in usable}


def _sized(docs: DataFrame, doc_id: str, source: str, size: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n_tokens"))


def _coin(seed: Column) -> Column:
    """A number from 0 to 1 that depends on the document's id and the seed alone."""
    return F.pmod(F.xxhash64(seed.cast("int"), F.col("doc_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seeds: int = 1) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): the selection, one row per copy.

    ``docs`` holds each document's size. Documents without tokens, without a source or of a source without target are not
    selected; rows with equal ids share one coin. With ``seeds`` above 1 each source keeps the best of so many seeds. Other columns are ignored. The rates (at most MAX_TARGETS) travel in the plan.
    """
    sized = _sized(docs, doc_id, source, size)
    wanted = read_targets(targets)
    names = [t.source for t in wanted]
    totals = sized.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()  # one row per target
    rates = repetition_rates(wanted, {r["source"]: r["n"] for r in totals}, total)
    caps = {t.source: t.repeats for t in wanted}
    spark = docs.sparkSession
    known = spark.createDataFrame([(s, r, caps[s]) for s, r in rates.items()], "source string, rate double, cap int")
    usable = sized.where("n_tokens > 0").join(F.broadcast(known), "source")
    extra = F.col("rate") - F.floor("rate")
    best = [(s, r, caps[s], 0) for s, r in rates.items()]
    if seeds > 1:
        sums = [F.sum(F.when(_coin(F.lit(i)) < extra, F.col("n_tokens")).otherwise(0)).alias(f"s{i}") for i in range(seeds)]
        best = []
        for r in usable.groupBy("source").agg(*sums, F.sum("n_tokens").alias("n")).collect():  # one row per target
            goal = (rates[r["source"]] % 1) * r["n"]
            best.append((r["source"], rates[r["source"]], caps[r["source"]], min(range(seeds), key=lambda i: (abs(r[f"s{i}"] - goal), i))))
    chosen = spark.createDataFrame(best, "source string, rate double, cap int, seed int")
    copies = F.least("cap", F.floor("rate") + F.when(_coin(F.col("seed")) < extra, 1).otherwise(0))
    chosen = sized.where("n_tokens > 0").join(F.broadcast(chosen), "source").withColumn("copies", copies).where("copies > 0")
    return chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")


def share_report(docs: DataFrame, targets: DataFrame, mixed: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """(source, target_share, documents, tokens, copies, mixed_tokens, actual_share) of every source that has documents or a target."""
    sized = _sized(docs, source, source, size)
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    got = mixed.groupBy("source").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("mixed_tokens"))
    spark = docs.sparkSession
    want = spark.createDataFrame([(t.source, t.share) for t in read_targets(targets)], "source string, target_share double")
    whole = mixed.agg(F.sum("n_tokens").alias("n")).collect()[0]["n"] or 1
    zero = {"documents": 0, "tokens": 0, "target_share": 0.0, "copies": 0, "mixed_tokens": 0}
    merged = have.join(want, "source", "full").join(got, "source", "left").na.fill(zero)
    return merged.select("source", "target_share", "documents", "tokens", "copies", "mixed_tokens", (F.col("mixed_tokens") / F.lit(whole)).alias("actual_share"))
