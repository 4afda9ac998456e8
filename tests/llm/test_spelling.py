"""Spelling variants against every pair of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cuadre.llm import spelling
from cuadre.llm.common import salted_lookup

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, ratio=2):
    keys = {}
    for w in counts:  # words that share none of these are not near
        for i in range(len(w) + 1):
            keys.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            keys.setdefault((w[:i], w[i:]), set()).add(w)
    partners = {w: set() for w in counts}
    for held in keys.values():
        for a in held:
            partners[a] |= {b for b in held if b not in partners[a] and near(a, b)}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(partners[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def rows_of(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_spelling(request, name):
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = plain_variants(plain_words(rows))
    assert rows_of(spelling.spelling(df)) == expected
    if name == "documents":
        assert any(r[1] for r in expected) and any(r[4] > 1 for r in expected)


def test_every_distance_in_a_dense_set(spark):
    """All words over two letters: runs of equal letters, every kind of change, chains and ties."""
    words = [""]
    for _ in range(6):
        words += [w + c for w in words for c in "ab" if len(w + c) <= 6 and w + c not in words]
    counts = {w: 1 + sum(map(ord, w)) * 7919 % 61 for w in set(words) if w}
    counts |= {"aaaaü": 4, "aaaabü": 90, "üaaaa": 1, "x" * 3000: 5, "x" * 2999: 11, "x" * 1500 + "y" + "x" * 1500: 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df)) == plain_variants(counts)


def test_long_chains_of_forms(spark):
    counts = {"b" * k + "a" * (30 - k): 2**k for k in range(31)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.variants(df))
    assert got == plain_variants(counts) and {r[2] for r in got} == {"b" * 30}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, unique=True), st.lists(st.integers(0, 30), max_size=6))
def test_numbers_over_ranges(words, at):
    """Ranges cut anywhere number the trie as one range does: equal prefixes have one number, others another."""
    words.sort()
    cuts = sorted({0, len(words), *(x % len(words) for x in at)})
    made, local, ranges = 0, [], []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        before, path, made = "", [], 0
        for w in words[a:b]:
            shared = next((i for i, (x, y) in enumerate(zip(before, w)) if x != y), min(len(before), len(w)))
            path = path[:shared] + list(range(made, made + len(w) - shared))
            made, before = made + len(w) - shared, w
            local.append((part, w, path))
        ranges.append((part, b - a, made, words[a], words[b - 1], path))
    known = {part: (base, shared) for part, _, base, shared in spelling.bases(ranges)}
    number = {}
    for part, w, path in local:
        base, shared = known[part]
        for depth, x in enumerate(path):
            number.setdefault(w[: depth + 1], set()).add(shared[x] if x < len(shared) else base + x)
    assert all(len(x) == 1 for x in number.values())
    assert len({min(x) for x in number.values()}) == len(number)


def test_clashing_columns(documents):
    df = documents.limit(50)
    assert rows_of(spelling.spelling(df.withColumns({"word": F.lit("x"), "n": F.lit(1), "id": F.lit(2)}))) == rows_of(spelling.spelling(df))


def test_word_tables_are_not_broadcast(spark):
    """Spark sizes copies made by explode as one row and words by their files; neither may go through the driver for that."""
    words = spark.createDataFrame([(f"{a}{b}word", i + j) for i, a in enumerate("abcde") for j, b in enumerate("vwxyz")], "word string, n long")
    left, right = words.withColumn("key", F.length("word") - 6), spark.createDataFrame([(0, "x")], "key int, name string")
    looked = salted_lookup(left, right, "key", F.hash("word"))
    assert {r["name"] for r in looked.collect()} == {"x"} and looked.count() == 25
    for df in (looked, spelling.neighbours(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
