"""Spelling variants by a dictionary of trie-node pairs (operator 11).

Prefixes of the words are nodes of a trie, suffixes nodes of the trie of the reversed words; both are
numbered. A word without its i-th code point is the pair (node of the prefix before it, node of the
suffix after it); a word cut at i is the pair (node before the cut, node after it). Two words that share
a skipping pair differ by one replaced code point; a skipping pair that is another word's cut says that
the other word is the first one with a code point deleted. So equal integer pairs are exact neighbours,
and no word is compared with another.

A pair is skipped to by at most one word for each code point of the alphabet and cut by at most one, so
no group grows with the corpus. Its best members are found in it without making pairs of them.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cuadre.llm.common import salted_lookup, whole_text, written

#: Fixed values.
WORD = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 5, 3, 2, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The node of the empty prefix.
ROOT = -1

_LOCAL = pa.schema([("word", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("made", pa.int64()), ("nodes", pa.list_(pa.int64()))])
_BASE = StructType([StructField("part", IntegerType()), StructField("rank", LongType()), StructField("base", LongType()), StructField("shared", ArrayType(LongType()))])


def occurrences(docs: DataFrame) -> DataFrame:
    """One row (word) for each run of letters of ``docs`` (doc_id, text), a 97th of them with a code point deleted."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one range in order -> the trie node of each prefix, numbered from 0 by first sight."""
    part, at, made, before, path = TaskContext.get().partitionId(), 0, 0, "", []
    for batch in batches:
        rows = []
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            shared = len(os.path.commonprefix((before, word)))
            new = len(word) - shared
            path = path[:shared] + list(range(made, made + new))
            rows.append((word, n, part, at, new, path))
            before, at, made = word, at + 1, made + new
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LOCAL.types, strict=True)], schema=_LOCAL)


def bases(ranges: list[tuple]) -> list[tuple]:
    """Ranges in order (part, words, made, first, last, path of the last) -> (part, rank, base, shared).

    A range numbers the path of its first word from 0. ``shared`` are the nodes on that path that earlier
    ranges made; any other local number has ``base`` added.
    """
    out, rank, base, before, path = [], 0, 0, "", []
    for part, words, made, first, last, local in ranges:
        shared = path[: len(os.path.commonprefix((before, first)))]
        out.append((part, rank, base, shared))
        path = [shared[x] if x < len(shared) else base + x for x in local]
        rank, base, before = rank + words, base + made, last
    return out


def number_trie(words: DataFrame) -> DataFrame:
    """``words`` (word, n: distinct words) with ``place``, the rank of the word in code-point order, and ``nodes``,
    the trie nodes of its prefixes from the first code point on.

    Spark sorts the words into ranges and each task numbers its own. The driver sees of each range only its
    first and last word and the last word's path.
    """
    local = written(words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_number, "word string, n long, part int, at long, made long, nodes array<long>"), "trie-ranges")
    ends = local.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.sum("made").alias("made"), F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "at").alias("path"))
    found = bases(sorted(tuple(r) for r in ends.collect()))
    # one row for each range
    placed = local.join(F.broadcast(words.sparkSession.createDataFrame(found, _BASE)), "part")
    node = lambda x: F.when(x < F.size("shared"), F.get("shared", x.cast("int"))).otherwise(F.col("base") + x)
    return placed.select("word", "n", (F.col("rank") + F.col("at")).alias("place"), F.transform("nodes", node).alias("nodes"))


#: Kinds of members of a pair.
CUT, SKIP, FIRST = 0, 1, 2


def _pairs(numbered: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, n, back) of every cut and every skipped place of ``numbered`` (word, n, place, prefixes, suffixes).

    Of equal code points side by side, skipping any gives one word; only the first such place is ``FIRST``.
    ``back`` is the negative place: the larger, the earlier the word.
    """
    length = F.size("suffixes")
    before = F.concat(F.array(F.lit(ROOT).cast("long")), "prefixes")
    after = F.reverse(F.concat(F.array(F.lit(ROOT).cast("long")), "suffixes"))
    letters = F.split("word", "")
    first = F.zip_with(letters, F.concat(F.array(F.lit("")), F.slice(letters, 1, length - 1)), lambda a, b: F.when(a == b, SKIP).otherwise(FIRST))
    cuts = F.zip_with("before", "after", lambda p, s: F.struct(p.alias("prefix"), s.alias("suffix"), F.lit(CUT).alias("kind")))
    skips = F.zip_with(F.zip_with(F.slice("before", 1, length), F.slice("after", 2, length), lambda p, s: F.struct(p.alias("p"), s.alias("s"))), "first",
                       lambda x, kind: F.struct(x["p"].alias("prefix"), x["s"].alias("suffix"), kind.alias("kind")))
    arrays = numbered.select("n", (-F.col("place")).alias("back"), before.alias("before"), after.alias("after"), first.alias("first"), "suffixes")
    return arrays.select("n", "back", F.inline(F.concat(cuts, skips))).select("prefix", "suffix", "kind", "n", "back")


def _better(*of: Column) -> Column:
    return F.array_max(F.array(*of))


def neighbours(words: DataFrame) -> DataFrame:
    """``words`` (word, n: distinct, not empty) -> word, n, place, n_near, best (n, back): how many words differ by one
    code point inserted, deleted or replaced, and the one of them with the largest n (then the smallest word).

    Words without neighbours have n_near 0 and a null best. No words give no rows.
    """
    forward = number_trie(words)
    backward = number_trie(words.select(F.reverse("word").alias("word"), "n"))
    # tables of all words go by merge joins: their files are several times smaller than what a broadcast would bring to the driver
    numbered = written(
        forward.withColumnRenamed("nodes", "prefixes").join(backward.select(F.reverse("word").alias("word"), F.col("nodes").alias("suffixes")).hint("merge"), "word"), "trie-words")
    member = F.struct("kind", "n", "back")
    held = _pairs(numbered).groupBy("prefix", "suffix").agg(F.collect_list(member).alias("held")).filter(F.size("held") > 1)
    rank = lambda m: F.struct(m["n"].alias("n"), m["back"].alias("back"))
    parts = held.select(
        F.transform(F.filter("held", lambda m: m["kind"] == CUT), rank).alias("cut"), F.filter("held", lambda m: m["kind"] != CUT).alias("skips"),
        F.transform(F.filter("held", lambda m: m["kind"] == FIRST), rank).alias("firsts"))
    parts = parts.withColumn("top", F.slice(F.sort_array(F.transform("skips", rank), asc=False), 1, 2))
    # of those that skip to the pair: all others are replaced neighbours, the cut word is a deleted one
    other = lambda m: F.when(F.get("top", F.lit(0)) == rank(m), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0)))
    is_first = lambda m: m["kind"] == FIRST
    skipping = F.transform("skips", lambda m: F.struct(
        m["back"].alias("back"), (F.size("skips") - 1 + F.when(is_first(m), F.size("cut")).otherwise(0)).alias("near"),
        _better(other(m), F.when(is_first(m), F.get("cut", F.lit(0)))).alias("best")))
    cutting = F.transform("cut", lambda m: F.struct(m["back"].alias("back"), F.size("firsts").alias("near"), F.array_max("firsts").alias("best")))
    near = parts.select(F.inline(F.concat(skipping, cutting))).filter("near > 0")
    near = near.groupBy("back").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    found = numbered.select("word", "n", "place").join(near.withColumn("place", -F.col("back")).drop("back").hint("merge"), "place", "left")
    return found.select("word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (place, to: no cycles) -> place, to: where following the links ends. Every round doubles the step."""
    now = written(forms.select("place", "to"), "forms")
    while True:
        further = now.select(F.col("place").alias("to"), F.col("to").alias("further"))
        after = written(salted_lookup(now, further, "to", F.hash("place")).select("place", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "forms")
        if after.filter("moved").isEmpty():
            return now
        now = after.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n: distinct, not empty) -> word, form, root, n, n_near, form_n.

    A word's form is its neighbour of largest n (ties: the smallest in code-point order) if that n is at least ``ratio``
    (2 or more) times its own, else null; its root is where following forms ends, the word itself if it has none.
    """
    found = written(neighbours(words).withColumn("to", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.back"))), "neighbours")
    end = roots(found.filter("to IS NOT NULL").select("place", "to")).withColumnRenamed("to", "end")
    joined = found.join(end.hint("merge"), "place", "left")
    names = found.select(F.col("place").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = salted_lookup(joined, names, "to", F.hash("place"))
    names = found.select(F.col("place").alias("end"), F.col("word").alias("root"))
    joined = salted_lookup(joined, names, "end", F.hash("place"))
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling(docs: DataFrame) -> DataFrame:
    """One row for each word of the corpus: word, form, root, n, n_near, form_n; see :func:`variants`.

    ``docs`` has ``doc_id`` (null: an empty id) and ``text`` (null: none); other columns are ignored, repeated rows
    count each. Words are the runs of letters after :func:`occurrences`, of at least ``LEAST_LENGTH`` code points and
    ``LEAST_COUNT`` occurrences. Texts and words of any length are processed whole. An empty table gives no rows.
    """
    counted = occurrences(docs).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return variants(written(counted.filter(F.col("n") >= LEAST_COUNT), "words"))
