"""Alignments against whole texts, all pairs of tokens and plain counts."""

from collections import Counter
from hashlib import sha256
from itertools import accumulate

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuadre.llm import alignment

PATHS = alignment.default_tokenizers()


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    # bytes of every A token from the library's own alphabet: a token of valid UTF-8 decodes to itself
    assert isinstance(a.decoder, ByteLevel)
    return a, b


def byte_table():
    """The byte-level alphabet as published: each printable byte stands for itself, others count up from 256."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    chars, n = list(keep), 0
    for b in range(256):
        if b not in keep:
            keep.append(b)
            chars.append(256 + n)
            n += 1
    return {chr(c): b for b, c in zip(keep, chars)}


TABLE = byte_table()


def plain(tokenizers, text):
    """(a ids, b ids, groups as text, links) of a whole text, or None."""
    if not text:
        return None
    a, b = tokenizers
    enc = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = enc.ids, b.encode(text)
    raw_a = [bytes(TABLE[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
    groups, at = [], (0, 0)
    for cut in sorted(set(ends_a) & set(ends_b)):
        to = (ends_a.index(cut) + 1, ends_b.index(cut) + 1)
        groups.append(",".join(map(str, ids_a[at[0] : to[0]])) + "|" + ",".join(map(str, ids_b[at[1] : to[1]])))
        at = to
    links = [(x, y) for x, e, n in zip(ids_a, ends_a, map(len, raw_a)) for y, f, m in zip(ids_b, ends_b, map(len, raw_b)) if max(e - n, f - m) < min(e, f)]
    return ids_a, ids_b, groups, links


def expected_rows(tokenizers, rows):
    found = [(i, plain(tokenizers, t)) for i, t in rows]
    counts = Counter(link for _, f in found if f for link in f[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == alignment.OUT_COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_align(request, spark, tokenizers, name):
    df = request.getfixturevalue(name)
    if name == "documents":  # texts whose links are found by comparing all pairs of tokens
        df = df.filter("length(text) < 3000")
    if name == "odd_documents":
        df = df.filter("text IS NULL OR length(text) < 3000").union(spark.createDataFrame(
            [(50, "a ▁ b"), (51, "<s> <|endoftext|> <0x0A> <unk>"), (52, "tail \n "), (53, "  two  spaces   here "), (54, "🙂 é\x00 ﬁ"), (55, " ")],
            "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in df.dtypes[2:])))
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = rows_of(alignment.align(df))
    assert got == expected_rows(tokenizers, rows)
    if name == "odd_documents":
        assert next(r for r in got if r[0] == 50)[1:] == (0, 0, 0, 0, 0, 0, "") and next(r for r in got if r[0] == 51)[1] > 0


def test_blocks_and_long_texts(spark, monkeypatch, tokenizers):
    """Documents over several blocks, and a text without a cut for its whole length."""
    docs = [(i, f"some {'longer ' * (i % 7)}words{i} again") for i in range(60)] + [(99, "x1é" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = rows_of(alignment.align(df))
    assert whole == expected_rows(tokenizers, docs)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 100)
    assert rows_of(alignment.align(df)) == whole


@settings(max_examples=300, deadline=None)
@given(st.text("ab é1.\n\t ▁ ᠎'\x1c", max_size=30) | st.text(max_size=20))
def test_chunks_are_whole_texts(tokenizers, text):
    got = next(alignment.aligner(PATHS).align([text]))
    want = plain(tokenizers, text)
    if want is None:
        assert got is None
    else:
        a, b, n, groups, raw = got
        pairs = [(p // alignment.PAIR, p % alignment.PAIR) for p in memoryview(raw).cast("q")]
        assert (a, b, n, groups) == (len(want[0]), len(want[1]), len(want[2]), ";".join(want[2])) and sorted(pairs) == sorted(want[3])


ENDS = st.lists(st.integers(1, 40), min_size=1, max_size=25, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS)
def test_divide_and_conquer(a, b):
    last = max(a[-1], b[-1]) + 1
    a, b = [*a, last], [*b, last]
    cuts = sorted(set(a) & set(b))
    got = alignment.groups(a, b)
    assert [(a[y - 1], b[z - 1]) for _, y, _, z in got] == [(c, c) for c in cuts]
    assert got[0][0] == got[0][2] == 0 and all(x[1] == y[0] and x[3] == y[2] for x, y in zip(got, got[1:]))


def test_kept_chunks_do_not_change_results(monkeypatch):
    texts = ["a b c", "b c d", "", "word " + "y" * 200, "c ▁ d", "a b c"]
    whole = list(alignment.Aligner(*PATHS).align(texts))
    monkeypatch.setattr(alignment, "CACHE", 2)
    small = alignment.Aligner(*PATHS)
    assert [next(small.align([t])) for t in texts] == whole and list(small.align(texts)) == whole and all(len(c) <= alignment.KEPT_CHARS for c in {*small.kept, *small.older})


def test_a_kept_first_chunk_with_white_space_cuts_no_other_text():
    texts = ["\tab c", "x \tab y", "x  ab y", "\u180eab c", "x \u180eab y", "ab\n", "x ab\n y"]
    together = alignment.Aligner(*PATHS)
    for text in texts:
        assert list(together.align([text])) == list(alignment.Aligner(*PATHS).align([text]))
