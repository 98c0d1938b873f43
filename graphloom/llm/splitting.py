"""Splitting oversized texts at natural boundaries, with a sparse table over boundary strengths.

Every byte position of a text has a strength: how natural a cut before that byte is. A sparse table answers in constant time
which cut is the strongest in a window of permissible lengths, the rightmost on ties. A piece ends at the strongest cut within
its limit, the next one steps back by the overlap, as far as the limit allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strengths: inside a character, between characters, beside white space, at a line's edge, outside any run of non-blank lines.
NEVER, CHARACTER, SPACE, LINE, BLANK_LINE = 0, 1, 2, 3, 4
NAMES = {CHARACTER: "none", SPACE: "space", LINE: "line", BLANK_LINE: "blank_line"}
PIECE = "piece_no int, start_byte int, end_byte int, overlap_bytes int, cut_strength int, text string"


def _only_blanks(data: bytes, at: int, step: int) -> bool:
    """Whether the line that holds ``at`` has nothing but spaces, tabs and carriage returns before it (step -1) or from it on (step 1)."""
    reach = 4096
    while 0 < at if step < 0 else at < len(data):
        lo, hi = (max(0, at - reach), at) if step < 0 else (at, at + reach)
        part = data[lo:hi]
        feed = part.rfind(b"\n") if step < 0 else part.find(b"\n")
        rest = part if feed < 0 else part[feed + 1 :] if step < 0 else part[:feed]
        if rest.strip(b" \t\r"):
            return False
        if feed >= 0:
            return True
        at = lo if step < 0 else hi
    return True


def boundary_strengths(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Strength of a cut before byte p, for p in first..last (the length of the data if not given).

    Memory grows with last - first alone: of what lies outside only the lines at both ends are looked at.
    """
    last = len(data) if last is None else min(last, len(data))
    lo, hi = max(0, first - 1), min(len(data), last + 1)
    n = hi - lo
    b = np.frombuffer(data, np.uint8, n, lo)
    strength = np.full(n + 1, CHARACTER, np.int8)
    strength[:n][(b & 0xC0) == 0x80] = NEVER
    blank = (b == 32) | (b == 9) | (b == 13)
    newline = b == 10
    space = blank | newline
    strength[:n][space] = SPACE
    strength[1:][space] = SPACE
    strength[:n][newline] = LINE
    strength[1:][newline] = LINE
    # The lines: [start, end) without the line feed; a blank one holds nothing but spaces, tabs and carriage returns.
    ends = np.append(np.flatnonzero(newline), n)
    starts = np.append(0, ends[:-1] + 1)
    ink = np.append(np.int32(0), np.cumsum(~space, dtype=np.int32))
    is_blank = ink[ends] == ink[starts]
    is_blank[0] &= _only_blanks(data, lo, -1)
    is_blank[-1] &= _only_blanks(data, hi, 1)
    # Cuts from the start of a blank line to its end, and at the neighbours' edges, lie outside every run of non-blank lines.
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(starts[is_blank] - 1, 0), 1)
    np.add.at(edge, np.minimum(ends[is_blank] + 1, n) + 1, -1)
    strength[np.cumsum(edge[: n + 1], dtype=np.int32) > 0] = BLANK_LINE
    if lo == 0:
        strength[0] = BLANK_LINE
    if hi == len(data):
        strength[n] = BLANK_LINE
    elif (data[hi] & 0xC0) == 0x80:
        strength[n] = NEVER
    return strength[first - lo : last - lo + 1]


class RangeMax:
    """Sparse table: the index of the greatest value in a window of at most ``widest``, the rightmost on ties, in O(1)."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        key = values.astype(np.int32) * (n + 1) + np.arange(n, dtype=np.int32)  # of equal values the one further right is greater
        self.size, self.levels = n + 1, [key]
        width = 1
        while 2 * width <= min(n, widest):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """Index of the maximum in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1])) % self.size


def split_bytes(data: bytes, limit: int, overlap: int, block: int = 1 << 18) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, strength of the cut at end) of each piece. Pieces never exceed ``limit`` bytes.

    A cut that leaves room for the whole overlap is preferred unless a stronger one lies behind it. The overlap begins beside
    white space if there is any within reach, else between characters. The last piece's strength is that of the text's end.
    Strengths and table cover ``block`` bytes at a time, so besides the text memory stays bounded however long it is.
    """
    if not 4 <= limit or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 4 bytes, overlap at least 0 and below the limit")
    n = len(data)
    if n <= limit:
        return [(0, n, 0, BLANK_LINE)]
    base, pieces, cut = -1, [], 0
    while n - cut > limit:
        if base < 0 or cut - base > block:
            base = max(0, cut - overlap)  # the next piece may begin that far back
            strength = boundary_strengths(data, base, base + block + overlap + limit)
            table = RangeMax(strength, limit)
        end = base + table.query(cut + 1 - base, cut + limit - base)
        near = base + table.query(cut + 1 - base, cut + limit - (overlap if pieces else 0) - base)
        if strength[near - base] == strength[end - base]:
            end = near
        start = base + _overlap_start(strength, max(cut - overlap, end - limit, 0) - base, cut - base) if pieces else 0
        pieces.append((start, end, cut - start, int(strength[end - base])))
        cut = end
    lo = max(cut - overlap, n - limit, 0)
    start = lo + _overlap_start(boundary_strengths(data, lo, cut), 0, cut - lo)
    return [*pieces, (start, n, cut - start, BLANK_LINE)]


def _overlap_start(strength: np.ndarray, lo: int, cut: int) -> int:
    """The first natural place in lo..cut to begin an overlap: beside white space, else between characters."""
    if lo >= cut:
        return cut
    window = strength[lo:cut]
    natural = np.flatnonzero(window >= SPACE)
    if len(natural):
        return lo + int(natural[0])
    allowed = np.flatnonzero(window >= CHARACTER)
    return lo + int(allowed[0]) if len(allowed) else cut


def _pieces(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["_key"], batch["_text"]):
                data = text.encode("utf-8", "surrogatepass")
                for i, (s, e, o, strength) in enumerate(split_bytes(data, limit, overlap)):
                    out.append((key, i, s, e, o, strength, data[s:e].decode("utf-8", "replace") if with_text else None))
            yield pd.DataFrame(out, columns=["_key", "piece_no", "start_byte", "end_byte", "overlap_bytes", "cut_strength", "text"])

    return run


def latest_rows(df: DataFrame, key: str, at: str, payload: list[Column]) -> DataFrame:
    """Of the rows of one key the one with the latest ``at``; null times are the oldest, equal times go to the greater payload.

    The rank limit also runs before the shuffle, so a key that holds a third of all rows sends few of them.
    """
    kept = df.select(F.col(key), F.col(at).alias("_at"), *payload)
    rest = [c for c in kept.columns if c not in (key, "_at")]
    w = Window.partitionBy(key).orderBy(F.col("_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def split_oversized(
    df: DataFrame, key: str = "id", text: str = "text", at: str | None = "indexed_at", limit: int = 1600, overlap: int = 160, with_text: bool = True
) -> DataFrame:
    """Ordered pieces of every text above ``limit`` UTF-8 bytes: (key, piece_no, start_byte, end_byte, overlap_bytes, cut_strength, text).

    Byte positions count from the start of the text. Of several rows with one key the latest by ``at`` counts (all rows if
    ``at`` is None). Null and empty texts and texts within the limit give no rows; rows without a key count as one key. Other
    columns are ignored, whatever their names.
    """
    size = F.octet_length(F.col(text))
    rows = df
    if at:
        long_text = F.when(size > limit, F.col(text)).alias("_text")  # a short latest version only has to be known, not moved
        rows = latest_rows(df, key, at, [long_text]).where("_text IS NOT NULL")
    else:
        rows = df.where(size > limit).select(key, F.col(text).alias("_text"))
    kind = df.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("_key"), "_text").mapInPandas(_pieces(limit, overlap, with_text), f"_key {kind}, {PIECE}")
    return found.withColumnRenamed("_key", key)


def weakest_boundary(pieces: DataFrame, key: str = "id") -> DataFrame:
    """(key, boundary): the kind of boundary that sufficed to cut each text, from its weakest cut."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return pieces.groupBy(key).agg(names[F.min("cut_strength")].alias("boundary"))
