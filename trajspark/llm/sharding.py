"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group. Groups are ordered by the MD5 of their text, and that order is cut into
contiguous shards so that the largest shard is as small as possible: the smallest feasible capacity is found by
binary search, each capacity being checked by filling shards greedily, and the greedy cuts at that capacity are taken.

The driver never holds the groups. It holds boundaries: cumulative sizes at the ends of ranges of the MD5 order, first
4096 equal ranges. A range is closed if it holds one group, else open: a cut may lie anywhere in it. Filling shards at
known boundaries only gives a capacity that is feasible; filling them as if open ranges could be cut anywhere gives one
that can't be beaten. Between the two, each cut is confined to a window, and only the open ranges inside windows are
split 256-fold by another aggregation. This ends when both capacities agree, after about log256(groups / 4096) rounds;
how many ranges are held doesn't depend on the number of groups.

Defined results: null text counts as the empty text. An empty table gives an empty result. A group larger than the mean
shard fills a shard alone. Repeated rows each get a slot. The result has the input's columns (columns of the result's
names are replaced).
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, unused

FIRST, MORE = 3, 2  # hex digits of the first ranges and of each split
CHUNKS = 256  # numbering of slots: parts of each shard


def greedy(ends: list[int], capacity: int) -> list[int]:
    """Indexes of the boundaries where shards end when each takes as much as fits; empty if a piece doesn't fit."""
    cuts, start, i = [], 0, 0
    while i < len(ends):
        j = bisect_right(ends, start + capacity, lo=i)
        if j == i:
            return []
        cuts.append(j - 1)
        start, i = ends[j - 1], j
    return cuts


def smallest(feasible, low: int, high: int) -> int:
    """The smallest value in low..high that is feasible; high must be."""
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


class Ranges:
    """Ranges of the group order as the driver knows them: (prefix, end of cumulative size, is one group)."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        """rows: prefix, size, groups, largest group."""
        self.rows = sorted(rows)
        self.ends, total = [], 0
        for _, size, _, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total
        self.largest = max((r[3] for r in self.rows), default=0)

    def step(self, start: int, capacity: int) -> int:
        """How far a shard from start may reach if open ranges can be cut anywhere, but closed ones only at their end."""
        to = min(start + capacity, self.total)
        i = bisect_right(self.ends, to)
        if i < len(self.ends) and self.rows[i][2] == 1:
            return self.ends[i - 1] if i else 0
        return to

    def optimistic(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.step(at, capacity)
        return at >= self.total

    def bounds(self, shards: int) -> tuple[int, int]:
        """(capacity that can't be beaten, capacity that is feasible at known boundaries)."""
        least = max(self.largest, -(-self.total // shards))
        high = smallest(lambda c: 0 < len(greedy(self.ends, c)) <= shards, least, self.total)
        return smallest(lambda c: self.optimistic(c, shards), least, high), high

    def windows(self, shards: int, low: int, high: int) -> list[str]:
        """Prefixes of the open ranges in which a greedy cut at any capacity in low..high may lie."""
        found, early, late = set(), 0, 0
        for _ in range(shards):
            i = bisect_right(self.ends, early + low)
            early = self.ends[i - 1] if i else 0
            late = self.step(late, high)
            for k in range(bisect_right(self.ends, early), len(self.rows)):
                if self.rows[k][2] > 1:
                    found.add(self.rows[k][0])
                if self.ends[k] >= late:
                    break
        return sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """(last prefix of each shard but the final one, capacity) for groups (key hex string, size long)."""

    def ranges(df: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        cut = df.groupBy(F.substring("key", 1, digits).alias("p")).agg(
            F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")
        )
        return [(r.p, r.s, r.n, r.m) for r in cut.collect()]

    known = Ranges(ranges(groups, FIRST))
    if not known.rows:
        return [], 0
    while True:
        low, high = known.bounds(shards)
        split = known.windows(shards, low, high)
        if not split:
            break
        digits = min(len(p) for p in split)
        split = [p for p in split if len(p) == digits]
        inside = groups.where(F.substring("key", 1, digits).isin(split))
        finer = ranges(inside, digits + MORE)
        gone = set(split)
        known = Ranges([r for r in known.rows if r[0] not in gone] + finer)
    capacity = smallest(lambda c: 0 < len(greedy(known.ends, c)) <= shards, max(known.largest, 1), known.total)
    return [known.rows[i][0] for i in greedy(known.ends, capacity)[:-1]], capacity


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard and slot (gapless from 0 in each shard), grown_shard (null)."""
    text = text_of(text_col)
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in own]
    key, chunk, before, at = (unused(docs, name) for name in ("key", "chunk", "before", "at"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept]).select(
        "*", F.md5(text).alias(key), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size")
    )
    groups = materialize(
        keyed.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("size")), "groups"
    )
    cuts, _ = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.substring(key, 1, len(cut)) > F.lit(cut)).cast("int")
    placed = keyed.select(
        "*",
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64(id_col, key), F.lit(CHUNKS)).cast("int").alias(chunk),
    )
    counts = placed.groupBy("shard", chunk).count()
    offsets = counts.select(
        "shard",
        chunk,
        (F.sum("count").over(Window.partitionBy("shard").orderBy(chunk)) - F.col("count")).alias(before),
    )
    row = F.row_number().over(Window.partitionBy("shard", chunk).orderBy(id_col, key)) - 1
    # offsets: shards x CHUNKS rows at most, whatever the input
    return (
        placed.withColumn(at, row)
        .join(F.broadcast(offsets), ["shard", chunk])
        .withColumn("slot", (F.col(before) + F.col(at)).cast("long"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*[F.col(f"`{c}`") for c in kept], *own)
    )
