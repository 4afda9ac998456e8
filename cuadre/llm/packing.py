"""Best-fit packing of documents into fixed-length sequences (operator 5).

Exact-complement hashing: for a piece of length a the gap ``capacity - a`` is looked up as one,
as the sum of two and as the sum of three available lengths; what fills the gap exactly is used
as often as the counts allow. What is left is packed by best fit, longest first. Only the
histogram of lengths decides, at most ``capacity`` numbers at any size of the corpus; pieces take
the slots of their length by rank, and ranks come from counts of bounded parts.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cuadre.llm.common import pylists, whole_text, written
from cuadre.llm.encoding import WIDTH, default_tokenizer, encode_in_blocks

CAPACITY = 2048

Pattern = tuple[tuple[int, ...], int]


def _pair(free: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two available lengths with this sum, the larger one as large as possible."""
    if total < 2:
        return None
    high = np.arange(total - 1, (total - 1) // 2, -1)
    low = total - high
    fits = (free[high] > 0) & (free[low] > (high == low))
    found = int(np.argmax(fits))
    return (int(high[found]), int(low[found])) if fits[found] else None


def complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap exactly."""
    if free[gap] > 0:
        return (gap,)
    if pair := _pair(free, gap):
        return pair
    for first in np.flatnonzero(free[: max(gap - 1, 0)])[::-1].tolist():
        if 3 * first < gap:
            break
        free[first] -= 1
        pair = _pair(free, gap - first)
        free[first] += 1
        if pair:
            return (first, *pair)
    return None


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, on counts: bins with equal gaps and contents move together."""
    bins: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            gap = next((g for g in range(length, capacity + 1) if bins.get(g)), None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(n, each)
                for size, times in ((each, whole), (rest, 1 if rest else 0)):
                    if times:
                        bins[capacity - size * length][(length,) * size] += times
                break
            held = next(iter(bins[gap]))
            times = min(n, bins[gap][held])
            bins[gap][held] -= times
            if not bins[gap][held]:
                del bins[gap][held]
            bins[gap - length][(*held, length)] += times
            n -= times
    return [(held, times) for gap in sorted(bins) for held, times in bins[gap].items() if times]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Contents of sequences and how often each occurs, using every length as often as it is there."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        free[length] = n
    out: list[Pattern] = [((capacity,), int(free[capacity]))] if free[capacity] else []
    free[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            free[length] -= 1
            rest = complement(free, capacity - length)
            free[length] += 1
            if rest is None:
                break
            need = Counter((length, *rest))
            times = int(min(free[x] // k for x, k in need.items()))
            for x, k in need.items():
                free[x] -= k * times
            out.append(((length, *rest), times))
    return out + best_fit({int(x): int(free[x]) for x in np.flatnonzero(free)}, capacity)


def slots(chosen: list[Pattern], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset.

    The pieces of a length with ranks from the first one on, up to the next key, lie at the
    offset in sequences that follow one another.
    """
    used: Counter = Counter()
    rows = []
    sequence = 0
    for held, times in chosen:
        at = 0
        for length in held:
            rows.append((length * (1 << 44) + used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only longer documents are cut, the first piece is the rest."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()),
    ("inside", pa.int64()), ("ids", pa.binary()),
])


def _pieces(tokenizer: str, capacity: int, keep_ids: bool):
    end = np.zeros(1, "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for doc_ids, texts in pylists(batches, "doc_id", "text"):
            rows = []
            for (doc_id, _), raw in encode_in_blocks(tokenizer, list(zip(doc_ids, texts, strict=True)), 1):
                raw += end
                start = 0
                for k, length in enumerate(cut_lengths(len(raw) // WIDTH, capacity)):
                    ids = raw[start * WIDTH : (start + length) * WIDTH]
                    rows.append((doc_id, k, start, length, zlib.crc32(ids), part, seen[length], ids if keep_ids else None))
                    seen[length] += 1
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    ``docs`` has ``doc_id`` and ``text`` (null: empty, one end id); other columns are ignored and
    repeated rows are packed each for itself. An empty table gives no rows. ``ids`` (little-endian
    unsigned 32-bit) is null without ``keep_ids``. Which of several pieces of one length takes which
    slot follows the order of scan partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, inside long, ids binary"
    pieces = written(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, keep_ids), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, sequences, offsets = slots(patterns(histogram, capacity), capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        wanted = length.to_numpy() * (1 << 44) + rank.to_numpy()
        at = np.searchsorted(keys, wanted, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + wanted - keys[at], "offset": offsets[at]})

    placed = ranked.withColumn("at", place("length", F.col("before") + F.col("inside")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids, one row for each sequence: sequence_id, n_tokens, ids (needs ``keep_ids``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))
