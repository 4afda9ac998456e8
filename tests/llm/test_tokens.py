"""Encoding, Simple-8b files and packing against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cuadre.llm import packing, simple8b
from cuadre.llm.encoding import Encoder, default_tokenizer
from tests.llm.conftest import texts_of


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return [Encoder(default_tokenizer()), Encoder(default_tokenizer(), cache_pieces=4, piece_chars=6)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c ᠎'sab1."), st.characters(codec="utf-8")), max_size=25), max_size=4))
def test_encoder_equals_library(plain, encoders, texts):
    for encoder in encoders:
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain(t) for t in texts]


def test_encoder_keeps_pieces_that_are_used_again(plain, monkeypatch):
    encoder = Encoder(default_tokenizer(), cache_pieces=100)
    asked = []
    many = encoder._many
    monkeypatch.setattr(encoder, "_many", lambda pieces, lead: asked.extend(pieces) or many(pieces, lead))
    for k in range(60):
        text = " ".join(["a", *(["again"] if k % 2 else []), *(f"x{'abcdefghij'[i]}q{k}" for i in range(10))])
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain(text)
    assert asked.count("again") == 1
    assert len(encoder.cache) + len(encoder.older) < 200


def greedy(values):
    """Selectors by trying each in turn."""
    at, out = 0, []
    while at < len(values):
        for s in (simple8b.ZERO_RUN, *range(len(simple8b.COUNTS))):
            n, bits = (simple8b.ZEROS, 0) if s == simple8b.ZERO_RUN else (simple8b.COUNTS[s], simple8b.WIDTHS[s])
            if at + n <= len(values) and all(int(v) < 1 << bits for v in values[at : at + n]):
                break
        else:
            s, n = simple8b.ESCAPE, 1
        out.append(s)
        at += n
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(1, 300)), max_size=20))
def test_simple8b_round_trip(parts):
    values = np.array([v >> s for v, s, n in parts for _ in range(n if v >> s < 2 else n % 5 + 1)], np.uint64)
    words, escapes = simple8b.encode(values)
    assert (words >> np.uint64(60)).tolist() == greedy(values)
    assert (simple8b.decode(words, escapes) == values).all()


def test_read_by_blocks():
    values = np.random.default_rng(1).integers(0, 50_257, 50_000).astype(np.uint64)
    values[::1000] = 2**63
    words, escapes = simple8b.encode(values)
    blocks, before = simple8b.directory(words)
    segment = {"words": words.tobytes(), "escapes": escapes.tobytes(), "block_ids": blocks, "block_escapes": before}
    for a, n in ((0, 1), (49_999, 1), (12_345, 20_000), (7, 0), (0, 50_000)):
        assert (simple8b.read_ids(segment, a, n) == values[a : a + n]).all()


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_files(spark, plain, request, name, tmp_path):
    df = request.getfixturevalue(name)
    simple8b.write_segments(df, str(tmp_path / "ids"))
    got = simple8b.read_documents(spark, str(tmp_path / "ids")).collect()
    expected, start = [], 0
    by_id = defaultdict(list)
    for doc_id, text in texts_of(df):
        by_id[doc_id].append(np.array([*plain(text), 0], "<u4"))
    for doc_id in sorted(by_id, key=lambda i: (i is not None, i)):
        expected.append((doc_id, start, sorted((len(x), zlib.crc32(x.tobytes())) for x in by_id[doc_id])))
        start += sum(map(len, by_id[doc_id]))
    seen = defaultdict(list)
    for r in got:
        seen[r["doc_id"]].append(r)
    assert [(i, min(r["start"] for r in seen[i]), sorted((r["n_tokens"], r["ids_crc32"]) for r in seen[i])) for i, _, _ in expected] == expected
    assert len(got) == sum(map(len, by_id.values()))


def check_packing(rows, ids, capacity):
    """Pieces are those of the contract, and sequences are gapless and not over-full."""
    wanted = Counter()
    for doc_id, x in ids:
        start = 0
        for k, n in enumerate(packing.cut_lengths(len(x), capacity)):
            wanted[doc_id, k, start, n, zlib.crc32(x[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in filled.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_packing(plain, request, name):
    df = request.getfixturevalue(name)
    packed = packing.pack(df).cache()
    ids = [(i, np.array([*plain(t), 0], "<u4")) for i, t in texts_of(df)]
    n = check_packing(packed.collect(), ids, packing.CAPACITY)
    total = sum(len(x) for _, x in ids)
    assert n <= 1.02 * -(-total // packing.CAPACITY) + 1
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(joined) == n and sum(r["n_tokens"] for r in joined.values()) == total
    for r in packed.collect():
        assert joined[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_patterns_use_every_piece(histogram):
    chosen = packing.patterns(histogram, 40)
    used = Counter()
    for held, times in chosen:
        assert sum(held) <= 40 and times > 0
        for length in held:
            used[length] += times
    assert used == Counter(histogram)


def test_exact_complements():
    assert packing.patterns({60: 2, 40: 1, 25: 1, 15: 1}, 100) in ([((60, 40), 1), ((60, 25, 15), 1)],)
    free = np.zeros(101, np.int64)
    free[[30, 20]] = [1, 2]
    assert packing.complement(free, 70) == (30, 20, 20)
    assert packing.complement(free, 60) is None
