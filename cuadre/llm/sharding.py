"""Sharding by minimax contiguous partition (operator 9).

Documents with equal texts form one atomic group. Groups lie in the order of their text digest;
the smallest capacity with which ``shards`` runs of whole groups hold everything is found by
binary search, each capacity being checked greedily. The driver never sees single groups beyond
the few near a cut: it holds sums by digest prefix and asks for finer prefixes only there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cuadre.llm.common import whole_text, with_rank, written

SHARDS = 24
#: Hexadecimal digits of the first prefixes (16^3 sums) and of each finer step.
FIRST, STEP = 3, 2
#: Larger than any digest.
END = "g"


class Prefixes:
    """Byte sums of runs of groups, by digest prefix; a run of one group cannot be split."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.rows = self._sums(F.lit(True), FIRST)
        self._index()

    def _sums(self, where, digits: int) -> list[tuple[str, int, int, int]]:
        prefix = F.substring("key", 1, digits)
        sums = self.groups.filter(where).groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m"))
        return [tuple(r) for r in sums.collect()]

    def _index(self) -> None:
        self.rows.sort()
        self.ends = np.cumsum([r[1] for r in self.rows], dtype=np.int64)
        self.starts = self.ends - np.array([r[1] for r in self.rows], np.int64)
        self.many = np.array([r[2] > 1 for r in self.rows], bool)
        self.total = int(self.ends[-1]) if len(self.rows) else 0
        self.largest = max((r[3] for r in self.rows), default=0)

    def refine(self, which: set[int]) -> None:
        by_length: dict[int, list[str]] = {}
        for i in which:
            by_length.setdefault(len(self.rows[i][0]), []).append(self.rows[i][0])
        kept = [r for i, r in enumerate(self.rows) if i not in which]
        for digits, prefixes in by_length.items():
            kept += self._sums(F.substring("key", 1, digits).isin(prefixes), digits + STEP)
        self.rows = kept
        self._index()

    def after(self, limit: int, optimistic: bool) -> int:
        """The last place at or before ``limit`` where a run may end; optimistic: inside a splittable run too."""
        i = int(np.searchsorted(self.ends, limit, "right"))
        if i == len(self.ends):
            return self.total
        return limit if optimistic and self.many[i] else int(self.starts[i])

    def greedy(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = max(at, self.after(at + capacity, optimistic))
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, optimistic: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, optimistic)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def splittable(self, low: int, high: int) -> set[int]:
        """Splittable runs that reach into [low, high]."""
        a, b = int(np.searchsorted(self.ends, low, "right")), int(np.searchsorted(self.starts, high, "left"))
        return {i for i in range(a, max(a, b)) if self.many[i]}


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity and the ``shards - 1`` digests at which shards begin.

    ``groups``: key (hexadecimal digest), bytes. Among the partitions of that capacity, each shard
    ends as near as it can to an equal part of what is left, so that shards stay near equal even
    where one large group sets the capacity.
    """
    runs = Prefixes(groups)
    if not runs.total:
        return 0, [END] * (shards - 1)
    while True:
        low, high = runs.smallest(shards, True), runs.smallest(shards, False)
        if low == high:
            break
        least, most = runs.greedy(low, shards, False), runs.greedy(high, shards, True)
        near = set().union(*(runs.splittable(a, b) for a, b in zip(least, most, strict=True)))
        if not near:
            raise RuntimeError("bounds differ although no run can be split")
        runs.refine(near)
    capacity = high
    while True:
        touched: set[int] = set()

        def first_at_or_after(place: int) -> int:
            if place <= 0:
                return 0
            i = int(np.searchsorted(runs.ends, place, "left"))
            if runs.starts[i] < place < runs.ends[i] and runs.many[i]:
                touched.add(i)
            return int(runs.ends[i])

        def last_at_or_before(place: int) -> int:
            i = int(np.searchsorted(runs.ends, place, "right"))
            if i < len(runs.ends) and runs.starts[i] < place and runs.many[i]:
                touched.add(i)
            return int(runs.ends[i - 1]) if i else 0

        needed, at = [runs.total], runs.total
        for _ in range(shards - 1):
            at = first_at_or_after(at - capacity)
            needed.append(at)
        cuts, at = [], 0
        for left in range(shards, 1, -1):
            most, aim = last_at_or_before(at + capacity), at + (runs.total - at) // left
            below, above = last_at_or_before(aim), first_at_or_after(aim)
            nearest = below if aim - below <= above - aim else above
            at = max(at, min(max(nearest, needed[left - 1]), most))
            cuts.append(at)
        if not touched:
            break
        runs.refine(touched)
    first = [r[0] for r in runs.rows] + [END]
    return capacity, [first[int(np.searchsorted(runs.starts, c, "left"))] for c in cuts]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` has ``doc_id`` and ``text`` (null: empty); other columns are ignored. Size: bytes of
    the text plus 8. Law ``bytes``: the largest shard is as small as whole groups in digest order
    allow. Slots count from 0 in every shard; repeated rows get a slot each. An empty table gives
    no rows.
    """
    text = whole_text()
    facts = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("key"), F.spark_partition_id().alias("part"),
        ),
        "shard-facts",
    )
    groups = written(facts.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, begins = minimax_cuts(groups, shards)
    number = F.lit(0)
    for begin in begins:
        number = number + (F.col("key") >= F.lit(begin)).cast("int")
    placed = with_rank(facts.withColumn("shard", number), "shard", "part", ["key", "doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
