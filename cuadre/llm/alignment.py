"""Alignment of the tokens of two tokenizers (operator 13).

Both tokenizers' tokens cover the same bytes. Offsets where a token of each ends are shared cuts: divide
and conquer finds one near the middle by bisection and goes on with both sides; an interval without one
is a leaf group. Tokens whose byte ranges overlap are linked; Spark counts the linked id pairs over the
corpus and brings the counts back to the documents by blocks of them, so a frequent pair is looked up
once for each block and not once for each document.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cuadre.llm.common import pylists, salted_lookup, whole_text, written

#: A space between two non-spaces starts a token of both tokenizers, so the text may be cut there:
#: the byte-level pattern starts a word, and no piece holds a space after another character.
#: U+180E counts as a space in some Unicode versions.
_CUT = re.compile(r" (?<=[^\s᠎] )(?=[^\s᠎])")
SPACE = "▁"
#: Aligned chunks that a worker keeps, in two generations of this size, and the longest of them in characters.
CACHE, KEPT_CHARS = 300_000, 48
#: Characters of texts that are aligned together.
TOGETHER = 500_000
#: Characters of a block of documents; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: An id pair is the A id times this plus the B id.
PAIR = 1 << 32

Chunk = tuple[int, int, int, str, bytes]


def shared_cut(ends_a: list[int], ends_b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """Of tokens a0..a1 and b0..b1, both ending together, the numbers of tokens before a cut inside, near the middle; None without one."""
    middle = (a0 + a1) // 2
    left, right = middle, middle + 1
    while left > a0 or right < a1:
        for at in (left, right):
            if a0 < at < a1:
                end = ends_a[at - 1]
                k = bisect_left(ends_b, end, b0, b1)
                if k < b1 - 1 and ends_b[k] == end:
                    return at, k + 1
        left, right = left - 1, right + 1
    return None


def groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups (a0, a1, b0, b1) of tokens between shared cuts, in order; ``ends``: byte offsets, the last ones equal."""
    out, todo = [], [(0, len(ends_a), 0, len(ends_b))] if ends_a else []
    while todo:
        interval = a0, a1, b0, b1 = todo.pop()
        cut = shared_cut(ends_a, ends_b, a0, a1, b0, b1) if a1 - a0 > 1 and b1 - b0 > 1 else None
        if cut is None:
            out.append(interval)
        else:
            a, b = cut
            todo.append((a, a1, b, b1))
            todo.append((a0, a, b0, b))
    return out


def links(ends_a: list[int], ends_b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Pairs of tokens of a group whose byte ranges overlap."""
    i, a1, j, b1 = group
    if i + 1 == a1:
        return [(i, k) for k in range(j, b1)]
    if j + 1 == b1:
        return [(k, j) for k in range(i, a1)]
    out = []
    while i < a1 and j < b1:
        out.append((i, j))
        a, b = ends_a[i], ends_b[j]
        i, j = i + (a <= b), j + (b <= a)
    return out


class Aligner:
    """Alignments of texts under a byte-level tokenizer (A) and a sentence-piece one (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self._bytes_a()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        self.kept: dict[str, Chunk | None] = {}
        self.older: dict[str, Chunk | None] = {}
        self.text = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]

    def _bytes_a(self) -> list[bytes]:
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        out = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            out[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else b""
        return out

    def _align(self, chunk: str, a: list[int], b: list[int]) -> Chunk | None:
        """(tokens of A, of B, groups, the groups as text, id pairs of the links), or None where bytes differ."""
        raw = (" " + chunk).encode()
        token_a, token_b = [*map(self.bytes_a.__getitem__, a)], [*map(self.bytes_b.__getitem__, b)]
        if b"".join(token_a) != raw or b"".join(token_b) != raw:
            return None
        ends_a, ends_b = list(accumulate(map(len, token_a))), list(accumulate(map(len, token_b)))
        found = groups(ends_a, ends_b)
        text_a, text_b = [*map(self.text.__getitem__, a)], [*map(self.text.__getitem__, b)]
        text = ";".join([
            f"{text_a[a0] if a1 - a0 == 1 else ','.join(text_a[a0:a1])}|{text_b[b0] if b1 - b0 == 1 else ','.join(text_b[b0:b1])}" for a0, a1, b0, b1 in found])
        pairs = array("q")
        for g in found:
            a0, a1, b0, b1 = g
            if a1 - a0 == b1 - b0 == 1:
                pairs.append(a[a0] * PAIR + b[b0])
            else:
                pairs.extend([a[i] * PAIR + b[j] for i, j in links(ends_a, ends_b, g)])
        return len(a), len(b), len(found), text, pairs.tobytes()

    def learn(self, chunks: list[str]) -> dict[str, Chunk | None]:
        """Alignments of " " + chunk for chunks between cuts."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        return {c: self._align(c, x, y if c else [self.space]) for c, x, y in zip(chunks, a, b, strict=True)}

    def align(self, texts: list[str]) -> Iterator[Chunk | None]:
        """The alignment of each text; None for one that is empty or whose bytes a tokenizer does not give back."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[Chunk | None]:
        # plain splitting does but for a chunk that is empty, has white space at an end or holds U+180E
        cut = [t.split(" ") if t else [] for t in texts]
        wanted = set().union(*cut)
        odd = {c for c in wanted if c.strip() != c or not c or "\u180e" in c}
        if odd:
            cut = [chunks if odd.isdisjoint(chunks) else _CUT.split(t) for t, chunks in zip(texts, cut, strict=True)]
            wanted = set().union(*cut)
        if len(self.kept) > CACHE:
            self.older, self.kept = self.kept, {}
        new = wanted.difference(self.kept)
        again = new.intersection(self.older)
        self.kept.update((c, self.older[c]) for c in again)
        listed = list(new.difference(again))
        for i in range(0, len(listed), 2000):
            self.kept.update(self.learn(listed[i : i + 2000]))
        get = self.kept.__getitem__
        for chunks in cut:
            held = [*map(get, chunks)]
            if not held or None in held:
                yield None
            else:
                a, b, n, text, pairs = zip(*held, strict=True)
                yield sum(a), sum(b), sum(n), ";".join(text), b"".join(pairs)
        for c in listed:
            if len(c) > KEPT_CHARS:
                del self.kept[c]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One aligner for each Python worker."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


_LONGS = pa.list_(pa.int64())
_ALIGNED = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", _LONGS), ("times", _LONGS),
])
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _aligned(paths: tuple[str, str]):
    """Documents -> their alignment, with the id pairs of the links and how often each occurs in the document."""

    def rows(ids: list, texts: list[str], block: int) -> pa.RecordBatch:
        out = []
        for doc_id, found in zip(ids, aligner(paths).align(texts), strict=True):
            if found is None:
                out.append((block, doc_id, 0, 0, 0, 0, "", [], []))
                continue
            a, b, n, text, raw = found
            pairs, times = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
            out.append((block, doc_id, a, b, n, len(raw) // 8, sha256(text.encode()).hexdigest(), pairs, times))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ALIGNED.types, strict=True)], schema=_ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for doc_ids, texts in pylists(batches, "doc_id", "text"):
            done = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield rows(doc_ids[done : i + 1], texts[done : i + 1], block)
                    block, size, done = block + 1, 0, i + 1
            if done < len(texts):
                yield rows(doc_ids[done:], texts[done:], block)

    return run


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n) of every block, and (pair, count, best) of the corpus: best if no pair of its B id has a higher count."""
    blocks = aligned.select("block", F.inline(F.arrays_zip("pairs", "times"))).groupBy("block", F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    blocks = written(blocks, "pairs-of-blocks")
    counted = written(blocks.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % PAIR), "pairs")
    # as many rows as B has ids
    top = counted.groupBy("b").agg(F.max("count").alias("top"))
    return blocks, counted.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _sums(key: tuple, docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    counts = counts.sort_values("pair")
    pairs, n, best = counts["pair"].to_numpy(np.int64), counts["count"].to_numpy(np.int64), counts["best"].to_numpy(bool)
    sizes = docs["pairs"].map(len).to_numpy(np.int64)
    asked = np.concatenate([np.empty(0, np.int64), *docs["pairs"]]).astype(np.int64)
    times = np.concatenate([np.empty(0, np.int64), *docs["times"]]).astype(np.int64)
    at = np.searchsorted(pairs, asked)
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    bounds = before(sizes)
    of_docs = lambda x: np.diff(before(x)[bounds])
    return docs.drop(columns=["pairs", "times", "block"]).assign(n_best=of_docs(times * best[at]), count_sum=of_docs(times * n[at]))[OUT_COLUMNS]


OUT_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Texts that are null or empty, or whose bytes a tokenizer does
    not give back, have no tokens: zeros and an empty digest. ``n_best``: links whose id pair is, over the corpus, one of
    the most frequent of its B id; ``count_sum``: the sum of the corpus-wide counts of the links' pairs. Repeated rows
    count each and stay; texts are processed whole; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    aligned = written(rows.mapInArrow(_aligned(tokenizers or default_tokenizers()), ALIGNED), "alignments")
    blocks, counts = pair_counts(aligned)
    known = salted_lookup(blocks.select("block", "pair"), counts, "pair", F.hash("block"))
    return aligned.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_sums, OUT)
