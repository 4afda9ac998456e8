"""Language spans against all paths, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuadre.llm import languages
from tests.llm.conftest import SF

SCORES = st.integers(1, 3).flatmap(lambda k: st.lists(st.lists(st.integers(-6, 0).map(float), min_size=k, max_size=k), min_size=1, max_size=7))


def total(path, rows, penalty):
    return sum(r[k] for k, r in zip(path, rows)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=300, deadline=None)
@given(SCORES, st.sampled_from([0.5, 2.0, 7.0]), st.data())
def test_viterbi_and_the_shortcut(rows, penalty, data):
    every = list(range(len(rows[0])))
    of = [sorted(data.draw(st.sets(st.sampled_from(every), min_size=1))) for _ in rows]
    best = max(total(p, rows, penalty) for p in itertools.product(*of))
    got = languages.viterbi([(c, [[r[k] for k in c]]) for c, r in zip(of, rows)], penalty)
    if all(c == of[0] for c in of):
        assert languages.viterbi([(of[0], [[r[k] for k in of[0]] for r in rows])], penalty) == got
    assert len(got) == len(rows) and all(k in c for k, c in zip(got, of)) and total(got, rows, penalty) == best
    masked = np.array([[x if k in c else languages.NEVER for k, x in enumerate(r)] for r, c in zip(rows, of)])
    only = languages.steady(masked, penalty)
    if only is not None:
        assert total([only] * len(rows), masked.tolist(), penalty) == best


def test_scripts_and_grams():
    names = [languages._NAMES[k] for k in languages.scripts_of(["abc", "ñu", "дом", "λόγος", "東京", "かな", "한국", "שלום", "ﬁx", "Ⴀ"])]
    assert names == ["latin", "latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew", "latin", "georgian"]
    assert [s for s, _ in languages.SCRIPTS] == sorted({s for s, _ in languages.SCRIPTS})
    one, _ = languages.grams(["haus"])
    many, begins = languages.grams(["ein", "haus", "a"])
    assert begins.tolist() == [0, 4, 9] and (many[4:9] == one).all()
    # an n-gram that does not fit into its word and the spaces around it counts for nothing
    assert (many[9:] == languages.BUCKETS).tolist() == [[False, False, False, True], [False, False, True, True]]


WORDS = {"de": "der die und ist nicht haus wald", "en": "the and is not house wood", "ru": "дом и лес не это вода", "el": "σπίτι και δεν είναι νερό"}


def made(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, lang, 20), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(900, None, "de"), (901, "x", None)]
    return languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixed_texts(spark, model):
    """Scripts narrow the candidates, penalties hold runs together, spans are exact."""
    assert model.languages == ["de", "el", "en", "ru"]
    script = languages._NAMES.index
    assert model.candidates[script("cyrillic")] == [3] and model.candidates[script("latin")] == [0, 2] and model.candidates[script("han")] == [0, 1, 2, 3]
    parts = ["the house is not the wood and the house", "дом и лес", "der wald ist nicht die haus und der wald", "νερό"]
    text = "1. " + " - ".join(parts) + "!"
    labeller = languages.Labeller(model, 2.0)
    spans = labeller.spans(text)
    assert [(lang, text[a:b]) for lang, a, b, _ in spans] == list(zip(["en", "ru", "de", "el"], parts))
    assert [n for *_, n in spans] == [sum(map(len, p.split())) for p in parts]
    assert labeller.language(text)[0] == "de" and labeller.language("")[:2] == labeller.language("12 + 3 ²!")[:2] == ("und", 0.0)
    assert labeller.spans("  дом, дом. ") == [("ru", 2, 10, 6)]


def test_the_kept_scores_do_not_change_results(model, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(made(rng, lang, 4) for lang in rng.choices(list(WORDS), k=3)) for _ in range(40)]
    whole = [languages.Labeller(model).language(t) for t in texts]
    monkeypatch.setattr(languages, "CACHE", 5)
    small = languages.Labeller(model)
    assert [small.language(t) for t in texts] == whole


def plain_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = languages.identify(docs, languages.train(docs)).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == plain_held(r["doc_id"]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held) > 100
    # held-out labels, source and id play no part
    other = docs.withColumn("lang", F.when(languages.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    assert sorted(map(str, languages.identify(other, languages.train(other)).collect())) == sorted(map(str, rows))


def test_samples_of_each_language(spark):
    rows = [(i, f"{'foo bar' if i % 9 else 'baz qux'} {i}", "a" if i % 9 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(docs, sample=50)
    assert model.languages == ["a", "b"] and languages.Labeller(model).language("baz qux")[0] == "b"


def test_odd_documents(spark, odd_documents, no_documents, documents):
    model = languages.train(documents)
    got = languages.identify(odd_documents, model).collect()
    texts = [r["text"] or "" for r in odd_documents.collect()]
    assert len(got) == len(texts)
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(c.isalpha() for c in t) for t in texts)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["spans"]) for r in got)
    assert languages.identify(no_documents, model).collect() == []
    empty = languages.train(no_documents)
    assert empty.languages == [] and {(r["lang_pred"], r["score"]) for r in languages.identify(documents, empty).collect()} == {("und", 0.0)}
    assert languages.train(odd_documents).languages == []
