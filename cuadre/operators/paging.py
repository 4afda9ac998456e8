"""Deep pages of a sorted list without sorting the list.

Ranges of the sort key are counted and only the range that holds the page is looked at again, until it
is small; then it is sorted. The driver sees a fixed number of range bounds and counts in each round, the
range filter reaches the scan, and the last sort has at most about ``SMALL`` rows. The rows are made once
and kept as Parquet for the rounds, whatever it takes to make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuadre.session import kept

#: Ranges that one round counts, and rows of a range that are sorted at once.
RANGES, SMALL = 64, 10_000


def _before(flag: Column, key: Column, row_id: Column, bound, desc: bool) -> Column:
    """Whether a row sorts before ``bound``; nulls of the key go last when descending, else first."""
    if bound["key"] is None:
        same, ahead = F.lit(True), F.lit(False)
    else:
        limit = F.lit(bound["key"])
        same, ahead = key == limit, key > limit if desc else key < limit
    inside = F.coalesce(ahead | (same & (row_id < F.lit(bound["id"]))), F.lit(False))
    return (flag < bound["flag"]) | ((flag == bound["flag"]) & inside)


def page_range(rows: DataFrame, offset: int, size: int, sort_by: str, desc: bool, row_id: str = "id", small: int = SMALL) -> tuple[DataFrame, int]:
    """The rows of a range that holds places ``offset`` .. ``offset + size - 1``, and the place of the page in it.

    ``row_id`` is not null. The range shrinks until it has at most ``small`` rows or cannot be split, as when
    its rows are all alike.
    """
    key, ident = F.col(sort_by), F.col(row_id)
    flag = (key.isNull() if desc else key.isNotNull()).cast("int")
    order = [flag, key.desc() if desc else key.asc(), ident]
    left = rows.count()
    while left > small:
        # a sample by hash: the same bounds whenever the round runs again
        drawn = rows.select(flag.alias("flag"), key.alias("key"), ident.alias("id")).orderBy(F.xxhash64(ident), ident).limit(RANGES - 1)
        bounds = drawn.orderBy("flag", F.col("key").desc() if desc else F.col("key").asc(), "id").collect()
        place = sum((F.when(_before(flag, key, ident, b, desc), 0).otherwise(1) for b in bounds), F.lit(0))
        counts = {r["place"]: r["n"] for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        passed, first, before = 0, None, 0
        last = len(bounds)
        for k in range(len(bounds) + 1):
            n = counts.get(k, 0)
            if first is None and passed + n > offset:
                first, before = k, passed
            passed += n
            if passed >= offset + size:
                last = k
                break
        if first is None:  # beyond the end
            return rows.limit(0), 0
        inside = F.lit(True)
        if first > 0:
            inside = inside & ~_before(flag, key, ident, bounds[first - 1], desc)
        if last < len(bounds):
            inside = inside & _before(flag, key, ident, bounds[last], desc)
        now = sum(counts.get(k, 0) for k in range(first, last + 1))
        rows, offset = rows.where(inside), offset - before
        if now >= left:
            break
        left = now
    return rows.orderBy(*order), offset


def seek_page(rows: DataFrame, page: int, page_size: int, sort_by: str, sort_order: str = "desc", row_id: str = "id") -> DataFrame:
    """Page ``page`` (from 1) of ``rows`` by ``sort_by``, ties by ``row_id``: the rows that sorting all of them gives.

    Rows alike in both are taken in any order. A page beyond the end, or of an empty table, is empty.
    """
    found, offset = page_range(kept(rows), (page - 1) * page_size, page_size, sort_by, sort_order == "desc", row_id)
    return found.offset(offset).limit(page_size)
