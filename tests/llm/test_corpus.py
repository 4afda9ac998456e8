"""Neighbours, language-model scores, shards, the pipeline and the registered queries."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cuadre.llm import maxent, neighbours, packing, quality, secret_scan, sharding, simhash, templates
from cuadre.llm.queries import QUERIES
from tests.llm.conftest import SF, texts_of
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import check_packing


def plain_nearest(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumns({"key": F.lit("x"), "rep": F.lit(1), "place": F.lit(1)})
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    expected = plain_nearest(ids, x, [i for i in ids if i % 100 == 0])
    got = found(neighbours.search(df))
    assert set(got) == set(expected) and all(len(got[q]) == 10 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * 10 * len(got)
    for q in got:
        for i, score in got[q]:
            assert abs(score - np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum())) < 1e-12


def test_neighbours_of_odd_vectors(spark):
    """Copies, ties, unusable vectors; everything lies in the least window, so the result is exact."""
    rng = np.random.default_rng(4)
    points = rng.integers(-2, 3, (120, 3)).astype(float)
    points[:, 0] += 3
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(200 + i, points[0].tolist()) for i in range(40)]
    rows += [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [1.0, float("nan"), 2.0]), (1400, [float("inf"), 1.0, 1.0]), (1500, [1.0]), (1600, []), (None, [1.0, 1.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: p for i, p in rows if i is not None and i < 1000}
    ids = np.array(sorted(good))
    expected = plain_nearest(ids, np.array([good[i] for i in ids]), [i for i in ids if i % 100 == 0])
    assert found(neighbours.search(df)) == expected
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert found(neighbours.search(few)) == {0: [(1, 1.0)]}
    assert neighbours.search(df.limit(0)).collect() == [] and neighbours.search(df.filter("vec_id >= 1000")).collect() == []


@pytest.mark.parametrize("axes,levels", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(axes, levels):
    grid = np.stack(np.meshgrid(*[np.arange(1 << levels)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = neighbours.hilbert(grid, levels)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_maxent(request, name):
    df = request.getfixturevalue(name)
    rows = [(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, maxent.tokenize(t)) for i, t in texts_of(df)]
    counts = Counter(w for _, held, words in rows if not held for w in words)
    total = sum(counts.values())
    norm = math.log10(total + 0.1 * (len(counts) + 1))
    expected = Counter((i, held, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10(counts[x] + 0.1) - norm for x in w), 4)) for i, held, w in rows)
    got = maxent.score(df).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    if name == "documents":
        for held in (True, False):
            assert sum(r["score"] for r in got if r["held_out"] == held) > sum(r["base_score"] for r in got if r["held_out"] == held)


def test_words_beyond_the_head_meet_their_counts(documents):
    whole = {r["doc_id"]: r for r in maxent.score(documents).collect()}
    for r in maxent.score(documents, head=100).collect():  # fewer: whole steps of the count
        w = whole[r["doc_id"]]
        assert tuple(r)[:5] == tuple(w)[:5] and abs(r["base_score"] - w["base_score"]) < 1e-6


def test_model_is_a_distribution(documents):
    """The probabilities of all known words and the unknown one, after any two words, sum to one."""
    rows = documents.select("doc_id", maxent.held_out().alias("held_out"), "text")
    counts = rows.select("held_out", "text").mapInArrow(maxent._count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    words = maxent.vocabulary(counts)
    model = maxent.train(rows, words)
    inside = model.inside.shape[1]
    for before in ([maxent.START, maxent.START], [5, 9], [maxent.RARE, 3], [0, 200]):
        _, one, features = maxent.contexts([np.array([*before, 1], np.int32)])
        p = maxent.class_probabilities(model.bias, model.weights, [f[-1:] for f in features])[0]
        total = sum(p[words.classes[w]] * 10 ** model.inside[words.classes[one[-1]], w] for w in range(inside))
        rest = (words.counts[inside:] + maxent.SMOOTH).sum() + maxent.SMOOTH * (words.distinct - len(words.counts) + 1) + (words.total - words.counts.sum())
        total += p[maxent.REST] * rest / words.rest_norm
        assert abs(total - 1) < 1e-5


def plain_minimax(sizes, shards):
    def fits(capacity):
        n, at = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if at + s > capacity:
                n, at = n + 1, 0
            at += s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_sharding(request, name):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    got = sharding.shard(df).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    slots, held = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    groups = Counter()
    for _, t in rows:
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 8
    if rows:
        assert max(held.values()) == plain_minimax([groups[k] for k in sorted(groups)], 24)


@settings(max_examples=25, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.lists(st.one_of(st.integers(1, 30), st.integers(1, 3000)), min_size=1, max_size=120), st.integers(1, 7), st.booleans())
def test_minimax_cuts(spark, sizes, shards, crowded):
    """Also where most digests share a prefix, so that runs are split several times."""
    digests = [("00000" if crowded and i % 3 else "") + hashlib.sha256(str(i).encode()).hexdigest() for i in range(len(sizes))]
    rows = sorted(zip(digests, sizes))
    class Fake(sharding.Prefixes):
        def _sums(self, where, digits):
            sums = defaultdict(list)
            for key, size in rows:
                if where is None or key[: where[0]] in where[1]:
                    sums[key[:digits]].append(size)
            return [(p, sum(s), len(s), max(s)) for p, s in sums.items()]

        def __init__(self, groups):
            self.rows = self._sums(None, 1)
            self._index()

        def refine(self, which):
            kept = [r for i, r in enumerate(self.rows) if i not in which]
            for i in which:
                p = self.rows[i][0]
                kept += self._sums((len(p), {p}), len(p) + 1)
            self.rows = kept
            self._index()

    before, sharding.Prefixes = sharding.Prefixes, Fake
    try:
        capacity, begins = sharding.minimax_cuts(None, shards)
    finally:
        sharding.Prefixes = before
    held = Counter()
    for key, size in rows:
        held[sum(key >= b for b in begins)] += size
    assert capacity == plain_minimax([s for _, s in rows], shards)
    assert max(held.values()) <= capacity and max(held) < shards and list(begins) == sorted(begins)


def test_prefixes_of_a_table(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), 1 + i * 7919 % 1000) for i in range(5000)]
    capacity, begins = sharding.minimax_cuts(spark.createDataFrame(rows, "key string, bytes long"), 24)
    assert capacity == plain_minimax([s for _, s in sorted(rows)], 24) and len(begins) == 23


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions of their decisions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"digest": F.lit("x"), "copy": F.lit(1)})
    docs = docs.union(docs.filter("doc_id % 10 = 0")).union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    score = quality.scorer(quality.train(docs, labels))
    kept = docs.filter(score(F.col("text")) >= quality.ACCEPT)
    rows = lambda df: Counter(map(str, df.select("doc_id", "text").collect()))
    outs = []
    df = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, SF)
        df.write.parquet(str(tmp_path / str(i)))
        df = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(df)
        if i < 4:
            assert df.columns == columns
    assert rows(outs[0]) == rows(kept)
    left = texts_of(kept)
    prints = np.array([plain_fingerprint(t) for _, t in left], np.uint64)
    place = list(range(len(left)))
    component = plain_components(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2, place)
    digest = lambda i, t: hashlib.sha256(f"{'' if i is None else i}|{t}".encode()).hexdigest()
    best = {}
    for c, (i, t) in zip(component, left):
        best[c] = min(best.get(c, (True, 10**9, "~", 0, "")), (i is None, -1 if i is None else i, digest(i, t), i, t))
    assert Counter((b[3], b[4]) for b in best.values()) == Counter((r["doc_id"], r["text"]) for r in outs[1].collect())
    hit = {r["doc_id"] for r in templates.contaminated(outs[1], bench).collect()}
    assert hit and rows(outs[2]) == rows(outs[1].filter(~F.col("doc_id").isin(list(hit))))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(outs[2]).collect()}
    assert {r["doc_id"]: r["text"] for r in outs[3].collect()} == clean
    assert not any(r["n_assign"] or r["n_hex"] or r["n_access"] for r in secret_scan.scan(outs[3]).collect())
    from tokenizers import Tokenizer

    from cuadre.llm.encoding import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    check_packing(outs[4].collect(), [(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t in texts_of(outs[3])], packing.CAPACITY)


def test_pipeline_of_no_and_odd_documents(spark, no_documents, odd_documents):
    for docs, least in ((no_documents, 0), (odd_documents, 1)):
        df = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, SF).cache()
            assert i == 4 or df.columns == docs.columns
        assert df.count() >= least


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


CONTRACTS = {
    1: ["doc_id", "start", "n_tokens", "ids_crc32"], 2: ["page_id", "host", "path", "rule", "verdict"], 3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "fingerprint", "component_id"], 5: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    6: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], 7: ["query_id", "rank", "vec_id", "score"],
    8: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 10: ["doc_id", "item_id", "n_windows"],
    11: ["word", "form", "root", "n", "n_near", "form_n"], 12: ["doc_id", "held_out", "lang_pred", "score"],
    13: ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}
KINDS = {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "piece": "int", "length": "bigint", "sequence_id": "bigint",
         "offset": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "rank": "int", "vec_id": "bigint", "query_id": "bigint", "n_known": "bigint", "train_tokens": "bigint",
         "base_score": "double", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "doc_id": "bigint", "n": "bigint",
         "n_near": "bigint", "form_n": "bigint", "lang_pred": "string", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_columns(spark, name):
    df = QUERIES[name](spark, SF)
    wanted = CONTRACTS[int(name[2:].split("_")[0])]
    assert df.columns[: len(wanted)] == wanted and df.count() >= 0
    assert {c: k for c, k in df.dtypes if c in KINDS} == {c: KINDS[c] for c in wanted if c in KINDS}
