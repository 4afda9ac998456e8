"""Token-id output in Simple-8b words (operator 1).

A word has 64 bits: a selector in the upper 4 and a payload of 60. Selectors 0 to 13 pack
``COUNTS[s]`` ids of ``WIDTHS[s]`` bits, the first in the lowest bits; 14 stands for a run of
240 zeros; 15 is an escape: the payload is the place, in the segment's escape list, of one
value of more than 60 bits.

A segment is a run of whole documents: words, escapes, the documents' ids and lengths, and
for every block of ``BLOCK_WORDS`` words the number of ids and of escapes before it. A reader
finds the block of any id by bisection and decodes blocks by selector, without a loop over
words. Segments are the rows of a Parquet file, in ascending order of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cuadre.llm.common import pylists, whole_text
from cuadre.llm.encoding import default_tokenizer, encode_in_blocks

#: Fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ZERO_RUN, ZEROS, ESCAPE = 14, 240, 15
BLOCK_WORDS = 1024
#: Ids after which a segment closes, at the end of a document.
SEGMENT_IDS = 500_000
END = 0

SEGMENT = (
    "part int, segment int, first long, n_ids long, words binary, escapes binary, "
    "block_ids array<long>, block_escapes array<long>, doc_ids array<long>, doc_lengths array<long>"
)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths, the narrowest width that holds the value being all that matters."""
    limits = np.array([0, *((1 << w) - 1 for w in WIDTHS)], np.uint64)
    lengths = np.array([0, *WIDTHS, 64], np.uint8)
    if int(values.max()) < 1 << 16:
        return lengths[np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64))][values.astype(np.int64)]
    return lengths[np.searchsorted(limits, values)]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of unsigned 64-bit values, packing as many as fit in each word."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # widest[k]: the largest bit length among k values from each place on, for growing k
    widest, size = _bits(values), 1
    choice = np.full(n, ESCAPE, np.int8)
    for s in (*reversed(range(len(COUNTS))), ZERO_RUN):
        count, width = (COUNTS[s], WIDTHS[s]) if s != ZERO_RUN else (ZEROS, 0)
        while size < count and len(widest):
            more = min(size, count - size)
            widest = np.maximum(widest[: len(widest) - more], widest[more:]) if len(widest) > more else widest[:0]
            size += more
        choice[: len(widest)][widest <= width] = s
    step = np.array([*COUNTS, ZEROS, 1], np.uint8)[choice].tobytes()
    starts = []
    at = 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    kind = choice[first]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind).tolist():
        if s < len(COUNTS):
            of = np.flatnonzero(kind == s)
            packed = words[of]
            for k in range(COUNTS[s]):
                packed |= values[first[of] + k] << np.uint64(k * WIDTHS[s])
            words[of] = packed
    escaped = np.flatnonzero(kind == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, values[first[escaped]]


def counts_of(words: np.ndarray) -> np.ndarray:
    """Ids in each word."""
    return np.array([*COUNTS, ZEROS, 1], np.int64)[(words >> np.uint64(60)).astype(np.int64)]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of words; escapes are the whole segment's."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(counts_of(words))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts_of(words)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(kind).tolist():
        of = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[first[of]] = escapes[payload[of].astype(np.int64)]
        elif s < len(COUNTS):
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for k in range(COUNTS[s]):
                out[first[of] + k] = (payload[of] >> np.uint64(k * WIDTHS[s])) & mask
    return out


def directory(words: np.ndarray) -> tuple[list[int], list[int]]:
    """Ids and escapes before each block of words."""
    held = np.concatenate([[0], np.cumsum(counts_of(words))])
    escaped = np.concatenate([[0], np.cumsum((words >> np.uint64(60)) == ESCAPE)])
    return held[:-1][::BLOCK_WORDS].tolist(), escaped[:-1][::BLOCK_WORDS].tolist()


def read_ids(segment: dict, start: int, length: int) -> np.ndarray:
    """``length`` ids of a segment from ``start``, decoding only the blocks that hold them."""
    words = np.frombuffer(segment["words"], "<u8")
    escapes = np.frombuffer(segment["escapes"], "<u8")
    if not length:
        return np.empty(0, np.uint64)
    before = np.asarray(segment["block_ids"])
    a = int(np.searchsorted(before, start, "right")) - 1
    b = int(np.searchsorted(before, start + length - 1, "right"))
    out = decode(words[a * BLOCK_WORDS : b * BLOCK_WORDS], escapes)
    return out[start - before[a] : start - before[a] + length]


def _segments(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[bytes] = []
        docs: list[int | None] = []
        lengths: list[int] = []
        number = done = 0

        def close() -> pa.RecordBatch:
            nonlocal number, done
            values = np.frombuffer(b"".join(ids), "<u4")
            words, escapes = encode(values)
            blocks, before = directory(words)
            row = [part, number, done, len(values), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), blocks, before, list(docs), list(lengths)]
            number, done = number + 1, done + len(values)
            ids.clear(), docs.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW.types, strict=True)], schema=ARROW)

        size = 0
        end = np.array([END], "<u4").tobytes()
        for doc_id, text in pylists(batches, "doc_id", "text"):
            for (doc, _), raw in encode_in_blocks(tokenizer, list(zip(doc_id, text, strict=True)), 1):
                ids.append(raw + end)
                docs.append(doc)
                lengths.append(len(ids[-1]) // 4)
                size += lengths[-1]
                if size >= SEGMENT_IDS:
                    yield close()
                    size = 0
        if docs:
            yield close()

    return run


_LONGS = pa.list_(pa.int64())
ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary()),
    ("block_ids", _LONGS), ("block_escapes", _LONGS), ("doc_ids", _LONGS), ("doc_lengths", _LONGS),
])


def write_segments(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode whole texts, end each document with id 0 and write segments to ``path``.

    ``docs`` has ``doc_id`` (null sorts first) and ``text`` (null: empty); other columns are
    ignored. Order: ``doc_id``, then a hash of the text and the text, so equal ids keep one
    defined order. Rows are dealt by ranges of (doc_id, hash): a repeated doc_id is split too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key, F.col("text"))
    ordered.mapInArrow(_segments(tokenizer or default_tokenizer()), SEGMENT).write.option("compression", "zstd").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """One row for each document of the files at ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The driver holds one total for each
    partition that wrote.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = dict(sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()))
    starts = dict(zip(totals, np.concatenate([[0], np.cumsum(list(totals.values()))])[:-1].tolist(), strict=True)) if totals else {}
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                raw = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8")).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_lengths"])
                begin = ends - row["doc_lengths"]
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                first = starts[row["part"]] + row["first"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array((first + begin).tolist(), pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64()),
                ], schema=out)

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
