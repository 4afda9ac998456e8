"""The trie self-join and the components against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from cuadre.llm import simhash
from cuadre.llm.components import components
from tests.llm.conftest import texts_of


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(near, ids):
    label = list(ids)
    while True:
        new = [min((label[j] for j in np.flatnonzero(row) if label[j] is not None), default=None) for row in near]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_near_duplicates(request, name):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    prints = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    expected = sorted(zip([i for i, _ in rows], [f"{int(p):016x}" for p in prints], plain_components(near, [i for i, _ in rows])), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str) == expected


def test_spark_hash_agrees(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), max_size=4), min_size=1, max_size=60))
def test_traverse(base, flips):
    x = np.unique(np.array([base ^ sum(1 << b for b in set(f)) for f in flips], np.uint64))
    before, simhash.FRONTIER = simhash.FRONTIER, 7
    try:
        i, j = simhash.traverse(x, x, 0, 0, True)
        a, b = x[::2], x[1::2]
        p, q = simhash.traverse(a, b, 0, 0, False)
    finally:
        simhash.FRONTIER = before
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    assert sorted(tuple(sorted(t)) for t in zip(i.tolist(), j.tolist())) == [t for t in zip(*np.where(near)) if t[0] < t[1]]
    assert sorted(zip(p.tolist(), q.tolist())) == [tuple(t) for t in np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= 2).tolist()]


def test_links_split_and_large(spark, monkeypatch):
    """Several levels of Spark's traversal, down to single fingerprints, give the same links."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(6))]))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    expected = {tuple(sorted((int(x[i]), int(x[j])))) for i, j in np.argwhere(near) if i < j}
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for subtree, product in ((1024, 1 << 24), (16, 8), (4, 200)):
        monkeypatch.setattr(simhash, "SUBTREE", subtree)
        monkeypatch.setattr(simhash, "PRODUCT", product)
        got = [tuple(sorted((r["u"] % 2**64, r["v"] % 2**64))) for r in simhash.links(df, len(x)).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 200)] + [(300, 300), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 200)}}
