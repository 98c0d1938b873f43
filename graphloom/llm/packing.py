"""Filling containers of fixed capacity with items, by exact-complement hashing over the histogram of lengths.

Only lengths decide how items combine, and there are at most ``capacity`` of them, so the plan is made from the histogram: it
holds patterns (a multiset of lengths) with the number of containers each fills. For the longest length left, the gap it leaves
is looked up among single lengths, pair sums and triple sums under the counts still available; what no combination fills
exactly goes to best fit. Items then take the slots of their length in order, so the assignment itself is distributed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Stock:
    """Counts of lengths still available, and hashed indexes of the sums of pairs and triples that fill a gap exactly.

    Both indexes are arrays by sum and built once. ``pair_first`` holds the longer length of a pair, ``third`` the shortest length
    that leaves a pair's sum. Counts only fall, so an entry that no longer holds is replaced by the next one there is, and a
    sum that has none left never has one again.
    """

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths, self.exhausted = np.flatnonzero(self.left), 0
        self.pair_first, self.third = np.zeros(capacity + 1, np.int32), np.zeros(capacity + 1, np.int32)
        for i, longer in enumerate(self.lengths):  # later ones, longer still, take precedence
            shorter = self.lengths[: i + 1] if self.left[longer] > 1 else self.lengths[:i]
            sums = shorter[: np.searchsorted(shorter, capacity - longer, side="right")] + longer
            self.pair_first[sums] = longer
        open_sums = np.arange(3, capacity + 1)
        for c in self.lengths:  # short lengths are the plentiful ones
            if not len(open_sums):
                break
            rest = open_sums - c
            hit = (rest > 0) & (self.pair_first[np.maximum(rest, 0)] > 0)
            self.third[open_sums[hit]] = c
            open_sums = open_sums[~hit]

    def available(self) -> np.ndarray:
        """The lengths there may still be; exhausted ones are dropped from time to time."""
        if self.exhausted > len(self.lengths) // 16:
            self.lengths, self.exhausted = self.lengths[self.left[self.lengths] > 0], 0
        return self.lengths

    def fits(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        self.exhausted += sum(self.left[x] == 0 for x in set(lengths))

    def times(self, lengths: tuple[int, ...]) -> int:
        return int(min(self.left[x] // lengths.count(x) for x in set(lengths)))

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of available lengths with this sum, its longer one as long as possible."""
        a = int(self.pair_first[total])
        if a == 0 or self.fits((a, total - a)):
            return (a, total - a) if a else None
        first = self.available()
        first = first[np.searchsorted(first, (total + 1) // 2) : np.searchsorted(first, total)]
        first = first[(self.left[first] > 0) & (self.left[total - first] > 0)]
        if len(first) and first[0] * 2 == total and self.left[first[0]] < 2:
            first = first[1:]
        self.pair_first[total] = first[-1] if len(first) else 0
        return (int(first[-1]), int(total - first[-1])) if len(first) else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three available lengths with this sum."""
        c = int(self.third[total])
        if c == 0:
            return None
        if self.left[c] > 0 and (p := self.pair(total - c)) and self.fits((c, *p)):
            return (c, *p)
        some = self.available()
        some = some[: np.searchsorted(some, total)]
        some = some[(self.left[some] > 0) & (self.pair_first[total - some] > 0)]
        stands = False
        for c in some.tolist():
            if p := self.pair(total - c):
                if self.fits((c, *p)):
                    self.third[total] = c
                    return (c, *p)
                stands = True  # only the counts of equal lengths stood in the way
        if not stands:
            self.third[total] = 0
        return None

    def complement(self, length: int) -> tuple[int, ...] | None:
        """One, two or three further lengths that fill the rest of a container exactly.

        The item itself is taken out meanwhile. What the indexes then lose can only be combinations that hold it, and if none
        of those fills a container now none ever will.
        """
        gap = self.capacity - length
        if gap == 0:
            return ()
        self.left[length] -= 1
        found = (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)
        self.left[length] += 1
        return found


def patterns(capacity: int, counts: dict[int, int]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(lengths of one container with how many of each, number of containers) that hold every item of the histogram exactly once.

    Every step uses up at least one length or all of a combination, so there are a few steps per distinct length.
    """
    stock, out = Stock(capacity, counts), []
    for length in stock.lengths[::-1].tolist():
        while stock.left[length] > 0 and (rest := stock.complement(length)) is not None:
            lengths = (length, *rest)
            n = stock.times(lengths)
            stock.take(lengths, n)
            out.append((tuple((x, lengths.count(x)) for x in sorted(set(lengths))), n))
    some = np.flatnonzero(stock.left).tolist()  # best fit of the residuals, all equal containers at once
    left = {x: int(stock.left[x]) for x in some}
    while some:
        held: dict[int, int] = {}
        gap = capacity
        while gap > 0 and (i := bisect_right(some, gap)):
            best = some[i - 1]
            k = min(left[best], gap // best) if held else 1
            held[best] = held.get(best, 0) + k
            left[best] -= k
            gap -= k * best
            if not left[best]:
                del some[i - 1]
        n = 1 + min(left[x] // k for x, k in held.items())
        for x, k in held.items():
            if n > 1:
                left[x] -= k * (n - 1)
                if not left[x]:
                    del some[bisect_right(some, x) - 1]
        out.append((tuple(sorted(held.items())), n))
    return out


def plan(capacity: int, counts: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """The same with every length written out."""
    return [(tuple(x for x, k in held for _ in range(k)), n) for held, n in patterns(capacity, counts)]


def _plan_budget(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The slots of one budget: which ranks of a length go to which containers, how many to each."""
    rank: dict[int, int] = {}
    container, rows = 0, []
    for number, (held, n) in enumerate(patterns(int(frame["capacity"].iloc[0]), dict(zip(frame["length"].tolist(), frame["n"].tolist())))):
        for x, k in held:
            first = rank.get(x, 0)
            rank[x] = first + k * n
            rows.append((key[0], x, first, k, container, number))
        container += n
    return pd.DataFrame(rows, columns=["budget_id", "length", "first_rank", "per_container", "first_container", "pattern"])


SLOTS = "budget_id string, length int, first_rank bigint, per_container int, first_container bigint, pattern bigint"


def ranked(df: DataFrame, keys: list[str], row_id: list[str], parts: int, name: str = "rank") -> DataFrame:
    """A distinct number from 0 for the rows of each key, without bringing a key's rows together.

    Rows are spread over ``parts`` by a hash of their id and numbered there; the parts' totals (few rows) give the offsets.
    """
    spread = df.withColumn("_part", F.pmod(F.xxhash64(*row_id), F.lit(parts)))
    totals = spread.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = spread.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*row_id)) - 1)
    return numbered.join(offsets, [*keys, "_part"]).withColumn(name, F.col("_inner") + F.col("_offset")).drop("_part", "_inner", "_offset")


def _place(table):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container = np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for budget, index in batch.groupby("budget_id").indices.items():
                keys, first, per, base = table.value[budget]
                want = lengths[index].astype(np.int64) << 40 | ranks[index]
                at = np.searchsorted(keys, want, side="right") - 1
                container[index] = base[at] + (ranks[index] - first[at]) // per[at]
            yield batch[["budget_id", "item_id", "piece_no", "start", "length"]].assign(container_id=container)

    return run


def pack(items: DataFrame, budgets: DataFrame, item_id: str = "doc_id", size: str = "n_tokens", max_slots: int = 2_000_000) -> DataFrame:
    """(budget_id, container_id, item_id, piece_no, start, length): every item assigned to a container of every budget.

    An item above the capacity is split: full pieces fill containers of their own, the rest is packed like other items. Items
    of size 0 or null take no space and go to container 0. ``start`` is the piece's first unit within its item. Items without
    an id and repeated ids are packed row by row. Budgets need distinct ids (at most 1,000) and capacities of at least 1.
    Other columns are ignored. What the driver holds is the histogram's plan: it grows with the capacity, not with the items.
    """
    spark = items.sparkSession
    limits = [(r["budget_id"], r["capacity_tokens"]) for r in budgets.select("budget_id", "capacity_tokens").limit(1_001).collect()]
    if len(limits) > 1_000 or len({b for b, _ in limits}) < len(limits) or any(b is None or c is None or c < 1 for b, c in limits):
        raise ValueError("budgets need distinct ids, at most 1,000, and capacities of at least 1")
    if not limits:
        limits = [(None, 1)]
    kind = items.schema[item_id].dataType.simpleString()
    sizes = items.select(F.col(item_id).alias("item_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    budget = F.explode(F.array(*[F.struct(F.lit(b).cast("string").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in limits])).alias("b")
    each = sizes.select("item_id", "size", budget).select("item_id", "size", "b.*").where("budget_id IS NOT NULL")
    # Piece numbers 0..n-1, where n counts full pieces and a rest if there is any; an empty item has one empty piece.
    pieces = each.select("item_id", "size", "budget_id", "capacity", F.explode(F.expr("sequence(0L, greatest(0L, (size - 1) div capacity))")).alias("piece_no"))
    pieces = pieces.select(
        "item_id", "budget_id", "capacity", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("start"),
        F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity")).cast("int").alias("length"),
    )
    histogram = pieces.where("length > 0").groupBy("budget_id", "capacity", "length").agg(F.count("*").alias("n"))
    slots = histogram.groupBy("budget_id").applyInPandas(_plan_budget, SLOTS).toPandas()
    if len(slots) > max_slots:
        raise ValueError(f"the plan has {len(slots)} slots, more than {max_slots}")
    slots = slots.sort_values(["budget_id", "length", "first_rank"])
    table = {b: (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 1 << 41, np.int64), np.zeros(1, np.int64)) for b, _ in limits}
    for b, g in slots.groupby("budget_id"):
        keys = g["length"].to_numpy(np.int64) << 40 | g["first_rank"].to_numpy(np.int64)
        # Length 0 comes first: all of it is in container 0.
        table[b] = tuple(np.append(x, y) for x, y in ((0, keys), (0, g["first_rank"].to_numpy()), (1 << 41, g["per_container"].to_numpy()), (0, g["first_container"].to_numpy())))
    shared = spark.sparkContext.broadcast(table)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = ranked(pieces.drop("capacity"), ["budget_id", "length"], ["item_id", "piece_no"], parts)
    placed = numbered.mapInPandas(_place(shared), f"budget_id string, item_id {kind}, piece_no int, start bigint, length int, container_id bigint")
    return placed.select("budget_id", "container_id", F.col("item_id").alias(item_id), "piece_no", "start", "length")


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, containers, least_containers, tokens, unused_share) per budget."""
    used = packed.where("length > 0").groupBy("budget_id", "container_id").agg(F.sum("length").alias("used")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return used.join(budgets.select("budget_id", "capacity_tokens"), "budget_id").select(
        "budget_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "tokens",
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )
