"""SimHash near-duplicates by a self-join of the binary trie of fingerprints (operator 4).

Node pairs of the trie are traversed together from the top: a pair carries the bits in which its
prefixes differ and is dropped when they exceed the budget. Spark traverses the upper levels as
joins of node tables, splitting a pair as long as it holds many fingerprints; the rest of each
subtree pair is traversed in one task. Equal fingerprints are one leaf, so copies are never paired,
and a fingerprint has at most 2,080 others within two bits, so links grow with the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuadre.llm.common import salted_lookup, whole_text, written
from cuadre.llm.components import components

BITS, SHINGLE, BUDGET, SEED = 64, 3, 2, 42
#: Fingerprints in a subtree where Spark hands over to the task, on average at most, and the
#: largest product of two subtrees' sizes that one task takes; larger pairs are split further.
SUBTREE, PRODUCT = 1024, 1 << 24
#: Bits that one split adds. Pairs are split only far beyond the average size: splitting the average
#: pair would make a hundred times as many groups, each of a few fingerprints.
STEP = 4
#: Node pairs that a task holds at a level; more are traversed one part after the other.
FRONTIER = 1 << 19


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in more than half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def prefix(column: str, depth: int) -> Column:
    return F.shiftrightunsigned(column, BITS - depth) if depth else F.lit(0).cast("long")


def masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(mask, set bits) of all masks over ``bits`` bits with at most ``budget`` set."""
    return [(sum(1 << p for p in places), k) for k in range(min(budget, bits) + 1) for places in combinations(range(bits), k)]


def _mask_rows(bits: int, budget: int) -> Column:
    # one constant, whatever the number of masks
    return F.from_json(F.lit(str([{"m": m, "d": d} for m, d in masks(bits, budget)]).replace("'", '"')), "array<struct<m:long,d:int>>")


def traverse(left: np.ndarray, right: np.ndarray, depth: int, differing: int, same: bool, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints within the budget; both arrays sorted, equal above ``depth``
    but for ``differing`` bits. With ``same`` both are one array and i < j."""
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ones_before(level: int) -> tuple[np.ndarray, np.ndarray]:
        """How many fingerprints before each place have a 1 in the bit below ``level``."""
        if level not in ones:
            shift, one = np.uint64(BITS - 1 - level), np.uint64(1)
            count = lambda side: np.concatenate([[0], np.cumsum((side >> shift) & one)]).astype(np.int32)
            mine = count(left)
            ones[level] = mine, mine if same else count(right)
        return ones[level]

    whole = (np.zeros(1, np.int32), np.full(1, len(left), np.int32), np.zeros(1, np.int32), np.full(1, len(right), np.int32), np.full(1, differing, np.int8))
    todo = [(depth, whole)]
    found_i, found_j = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    while todo:
        level, (a0, a1, b0, b1, d) = todo.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i != j
        found_i.append(i[near]), found_j.append(j[near])
        rest = ~single
        a0, a1, b0, b1, d = a0[rest], a1[rest], b0[rest], b1[rest], d[rest]
        if not len(a0) or level == BITS:
            continue
        ones_left, ones_right = ones_before(level)
        am, bm = a1 - (ones_left[a1] - ones_left[a0]), b1 - (ones_right[b1] - ones_right[b0])
        own = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        once = d + np.int8(1)
        parts = [(a0, am, b0, bm, d, d <= budget), (am, a1, bm, b1, d, d <= budget), (a0, am, bm, b1, once, d < budget), (am, a1, b0, bm, once, (d < budget) & ~own)]
        kept = []
        for x0, x1, y0, y1, dd, keep in parts:
            keep = keep & (x1 > x0) & (y1 > y0)
            kept.append(tuple(x[keep] for x in (x0, x1, y0, y1, dd)))
        below = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        for k in range(0, len(below[0]), FRONTIER):
            todo.append((level + 1, tuple(x[k : k + FRONTIER] for x in below)))
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links are enough to connect what all of them connect."""
    parent = list(range(n))
    keep = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            keep[k] = True
    return keep


def subtree_pairs(prints: DataFrame, n: int, budget: int = BUDGET) -> tuple[DataFrame, list[int]]:
    """Pairs of subtrees that may hold links: depth, a, b, d; and the depths that occur."""
    depth = min(24, math.ceil(math.log2(n / SUBTREE))) if n > SUBTREE else 0
    nodes = lambda at: prints.groupBy(prefix("fp", at).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    top = nodes(depth)
    pairs = (
        top.select(F.col("p").alias("a"), F.col("n").alias("na"), F.explode(_mask_rows(depth, budget)).alias("x"))
        .select("a", "na", F.col("a").bitwiseXOR(F.col("x.m")).alias("b"), F.col("x.d").alias("d")).filter("a <= b")
        .join(top.select(F.col("p").alias("b"), F.col("n").alias("nb")), "b")
    )
    done, depths = [], []
    while True:
        pairs = written(pairs.select("a", "b", "d", "na", "nb"), "trie-pairs")
        small = F.col("na") * F.col("nb") <= PRODUCT
        done.append(pairs.filter(small).select(F.lit(depth).alias("depth"), "a", "b", "d"))
        depths.append(depth)
        large = pairs.filter(~small)
        if depth == BITS or large.isEmpty():
            return reduce(DataFrame.union, done), depths
        step = min(STEP, BITS - depth)
        depth += step
        below = nodes(depth)
        low = F.lit((1 << step) - 1).cast("long")
        children = below.select(F.shiftrightunsigned("p", step).alias("a"), F.col("p").alias("ca"), F.col("n").alias("na"))
        split = (
            large.select("a", "b", F.col("d").alias("d0")).join(children, "a").withColumn("x", F.explode(_mask_rows(step, budget)))
            .withColumn("d", F.col("d0") + F.col("x.d")).filter(F.col("d") <= budget)
            .withColumn("cb", F.shiftleft("b", step).bitwiseOR(F.col("ca").bitwiseAND(low).bitwiseXOR(F.col("x.m"))))
            .filter("a <> b OR ca <= cb")
        )
        pairs = split.join(below.select(F.col("p").alias("cb"), F.col("n").alias("nb")), "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "d", "na", "nb")


def links(prints: DataFrame, n: int, budget: int = BUDGET, every: bool = True) -> DataFrame:
    """Links (u, v) between different fingerprints within the budget.

    ``prints``: distinct ``fp`` (long), ``n`` of them. With ``every`` all links; else, for each
    subtree pair, as many as connect the same fingerprints.
    """
    pairs, depths = subtree_pairs(prints, n, budget)
    at = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix("fp", d).alias("p")) for d in depths))).alias("x")).select("fp", "x.depth", "x.p")
    left = pairs.join(at.withColumnRenamed("p", "a"), ["depth", "a"]).select("depth", "a", "b", "d", F.lit(0).alias("side"), "fp")
    right = pairs.filter("a <> b").join(at.withColumnRenamed("p", "b"), ["depth", "b"]).select("depth", "a", "b", "d", F.lit(1).alias("side"), "fp")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        side = rows["side"].to_numpy()
        one = np.sort(fps[side == 0])
        same = bool(rows["a"].iloc[0] == rows["b"].iloc[0])
        two = one if same else np.sort(fps[side == 1])
        i, j = traverse(one, two, int(rows["depth"].iloc[0]), int(rows["d"].iloc[0]), same, budget)
        if not every and len(i):
            keep = forest(i, j if same else j + len(one), len(one) + len(two))
            i, j = i[keep], j[keep]
        return pd.DataFrame({"u": one[i].view(np.int64), "v": two[j].view(np.int64)})

    return left.union(right).groupBy("depth", "a", "b").applyInPandas(join, "u long, v long")


def _members(classes: DataFrame, budget: int) -> DataFrame:
    """``classes`` (distinct fp) with the root fingerprint of their component."""
    found = links(classes.select("fp"), classes.count(), budget, every=False)
    return classes.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def first_of_components(classes: DataFrame, first: str, budget: int = BUDGET) -> DataFrame:
    """The smallest ``first`` of each component of ``classes`` (distinct fp, ``first``); none of an empty table."""
    return _members(classes, budget).groupBy("root").agg(F.min(first).alias(first)).select(first)


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row for each document: doc_id, fp (long), fingerprint (hex), component_id.

    ``docs`` has ``doc_id`` and ``text`` (null: empty); other columns are ignored. Texts without
    words have fingerprint zero and are linked like others. ``component_id`` is the smallest
    doc_id reachable over links, null ids not counted. Repeated rows stay. An empty table gives
    no rows.
    """
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(whole_text()).alias("fp")), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    member = _members(classes, budget)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_lookup(member.select("fp", "root"), least, "root", F.hash("fp")).select("fp", "component_id")
    out = salted_lookup(prints, named, "fp", F.hash("doc_id"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
