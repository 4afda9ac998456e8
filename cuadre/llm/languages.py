"""Language of texts and of spans in mixed-language texts (operator 12).

The code-point range of a word's first letter names its script; only languages that write a share of
their letters in that script are candidates. Each word is scored for each candidate by character n-grams,
and Viterbi over the words with a penalty for every switch labels spans; a text's language is the one
whose spans hold most letters. The model are counts of hashed n-grams, summed by Spark over the
training documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cuadre.llm.common import whole_text

#: Documents with a remainder of HELD of their hash modulo FOLDS are kept from training.
FOLDS, HELD = 4, 2
#: Labelled documents of each language that are learned from, about: chosen by a share of the hash range.
SAMPLE = 20_000
#: Hashed n-grams of these lengths, words carrying a space on both sides.
ORDERS, BUCKETS, PRIOR = (1, 2, 3, 4), 1 << 16, 2000.0
#: What a switch of language costs, in the unit of a word's score (natural logarithms, mean over the orders).
SWITCH = 8.0
#: A language is a candidate in a script that holds this share of its letters.
LEAST_SHARE = 0.01
#: Score of a word in a language that is no candidate.
NEVER = -1e6
#: Words whose scores a worker keeps.
CACHE = 200_000
UNKNOWN = "und"

#: First code point of a range and its script; ranges of no script of their own are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _words():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as a place in the list of scripts."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-case words: an array (position, order) and each word's first position.

    Where an n-gram does not fit into its word, the bucket is ``BUCKETS``.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    ends = np.repeat(begins[1:], lengths + 1)  # the space after the word of each position
    n = int(begins[-1])
    at = np.arange(n)
    out = np.full((n, len(ORDERS)), BUCKETS, np.int64)
    rolling = np.zeros(n, np.uint64)
    for k in range(1, max(ORDERS) + 1):
        fits = at + k - 1 <= ends
        rolling = (rolling ^ codes[np.minimum(at + k - 1, n)]) * _MIX[0]
        rolling ^= rolling >> np.uint64(29)
        if k in ORDERS:
            hashed = (rolling + np.uint64(k)) * _MIX[1]
            out[:, ORDERS.index(k)] = np.where(fits, (hashed >> np.uint64(48)).astype(np.int64) % BUCKETS, BUCKETS)
    return out, begins[:-1]


@dataclass(frozen=True)
class Model:
    """``logs``: log probability of (bucket, language), a row of zeros last; ``candidates``: languages of each script."""

    languages: list[str]
    logs: np.ndarray
    candidates: list[list[int]]

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of lower-case words: an array (word, language), ``NEVER`` where a language is no candidate; and their scripts."""
        places, begins = grams(words)
        totals = np.zeros((len(words), len(self.languages)))
        for k in range(len(ORDERS)):
            totals += np.add.reduceat(self.logs[places[:, k]], begins, axis=0, dtype=np.float64)
        scripts = scripts_of(words)
        allowed = np.zeros((len(_NAMES), len(self.languages)), bool)
        for script, of in enumerate(self.candidates):
            allowed[script, of] = True
        return np.where(allowed[scripts], totals / len(ORDERS), NEVER), scripts


def steady(scores: np.ndarray, penalty: float) -> int | None:
    """The language that is best for all words (word, language), if no switching path can be better; else None.

    Against the language of the largest sum no other gains more than a penalty over any run of words, nor more than
    half of one over the first or the last words. Runs in other languages, each of them gaining at most that, cost as
    many penalties as there are runs if the language itself has a part in the path, and one less if it has none; then
    the first and the last run gain at most one penalty together.
    """
    top = int(scores.sum(axis=0).argmax())
    gains = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, top : top + 1], axis=0, out=gains[1:])
    if gains.max() > penalty / 2 or (gains[-1] - gains.min(axis=0)).max() > penalty / 2:
        return None
    return top if (gains - np.minimum.accumulate(gains, axis=0)).max() <= penalty else None


def viterbi(runs: list[tuple[list[int], list[list[float]]]], penalty: float) -> list[int]:
    """The best language for each word: the sum of its words' scores less ``penalty`` for each switch is largest.

    ``runs``: words of equal candidates, with each word's scores of them. Ties stay in the language, then go to the
    first candidate.
    """
    at: list[int] = []
    best: list[float] = []
    back: list[tuple[int, list[bool] | None]] = []  # of a word: the leader before it, and who switched from it
    for candidates, rows in runs:
        place = {k: i for i, k in enumerate(at)}
        before, best = best, [best[place[k]] if k in place else float("-inf") for k in candidates] if at else [0.0] * len(candidates)
        leader = (at[before.index(max(before))], max(before)) if at else None
        at = candidates
        for row in rows:
            if leader is None:
                top = max(best)
                leader = (candidates[best.index(top)], top)
            switched = leader[1] - penalty
            if min(best) < switched:
                back.append((leader[0], [x < switched for x in best]))
                best = [(x if x >= switched else switched) + s for x, s in zip(best, row, strict=True)]
            else:
                back.append((leader[0], None))
                best = [x + s for x, s in zip(best, row, strict=True)]
            leader = None
    if not back:
        return []
    label = at[best.index(max(best))]
    out = []
    n = len(back)
    for candidates, rows in reversed(runs):
        place = {k: i for i, k in enumerate(candidates)}
        for _ in rows:
            n -= 1
            out.append(label)
            before, moved = back[n]
            if moved is not None and moved[place[label]]:
                label = before
    return out[::-1]


class Labeller:
    """Spans of texts by a model, with the scores of frequent words kept."""

    def __init__(self, model: Model, penalty: float = SWITCH):
        self.model, self.penalty, self.find = model, penalty, _words()
        self.known: dict[str, int]
        self._room(0)

    def _room(self, rows: int) -> None:
        """Empty tables of scores and scripts for at least ``rows`` words."""
        self.known, rows = {}, max(rows, CACHE)
        self.scores, self.scripts = np.empty((rows, len(self.model.languages))), np.empty(rows, np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Places of words in the kept scores."""
        new = set(words).difference(self.known)
        if new and len(self.known) + len(new) > len(self.scores):
            new = set(words)
            self._room(len(new))
        listed, done = list(new), len(self.known)
        self.known.update(zip(listed, range(done, done + len(listed)), strict=True))
        for i in range(0, len(listed), CACHE):
            some = listed[i : i + CACHE]
            self.scores[done + i : done + i + len(some)], self.scripts[done + i : done + i + len(some)] = self.model.scores(some)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(language, start, end, letters) of runs of words of one language; code points, end exclusive."""
        words = self.find.findall(text)
        if not words or not self.model.languages:
            return []
        rows = self._rows([w.lower() for w in words])
        only = steady(self.scores[rows], self.penalty)
        if only is not None:
            end = self.find.search(text, text.rindex(words[-1])).end()
            return [(self.model.languages[only], self.find.search(text).start(), end, sum(map(len, words)))]
        scripts, scores = self.scripts[rows], self.scores[rows]
        bounds = [0, *(np.flatnonzero(np.diff(scripts)) + 1).tolist(), len(words)]
        runs = [(of, scores[a:b, of].tolist()) for a, b in zip(bounds, bounds[1:], strict=False) for of in [self.model.candidates[scripts[a]]]]
        labels = viterbi(runs, self.penalty)
        out: list[tuple[str, int, int, int]] = []
        for k, m in zip(labels, self.find.finditer(text), strict=True):
            name, (a, b) = self.model.languages[k], m.span()
            if out and out[-1][0] == name:
                out[-1] = (name, out[-1][1], b, out[-1][3] + b - a)
            else:
                out.append((name, a, b, b - a))
        return out

    def language(self, text: str) -> tuple[str, float, list[dict]]:
        """The language with most letters (ties: the first by name), its share of them, and the spans."""
        spans = self.spans(text)
        letters: dict[str, int] = defaultdict(int)
        for name, _, _, n in spans:
            letters[name] += n
        if not letters:
            return UNKNOWN, 0.0, []
        top = min(letters, key=lambda name: (-letters[name], name))
        return top, letters[top] / sum(letters.values()), [{"lang": name, "start": a, "end": b} for name, a, b, _ in spans]


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without id is."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled texts -> lang, bucket, n of the whole task; letters of script s are bucket ``BUCKETS + 1 + s``."""
    find = _words()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS + 1 + len(_NAMES), np.int64)
            for text in texts:
                found = [w.lower() for w in find.findall(text)]
                for i in range(0, len(found), CACHE):
                    words = found[i : i + CACHE]
                    sums[lang] += np.bincount(grams(words)[0].ravel(), minlength=len(sums[lang]))
                    letters = np.fromiter(map(len, words), np.int64, len(words))
                    sums[lang][BUCKETS + 1 :] += np.bincount(scripts_of(words), letters, len(_NAMES)).astype(np.int64)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled ``docs`` (doc_id, text, lang); held-out rows, null labels and null texts are left out.

    At most about ``sample`` documents of each language are learned from. The driver holds ``BUCKETS`` numbers
    for each language, whatever the size of the corpus. No labelled rows give a model of no languages.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # what is drawn depends on the row alone: lang, its number of rows, and a hash
    rows = known.select(F.col("lang").cast("string").alias("lang"), whole_text().alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1)) * (1 << 30)).alias("limit"))
    drawn = rows.join(F.broadcast(share), "lang").filter("draw < limit").select("lang", "text")
    sums = drawn.mapInPandas(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return model_of(sums)


def model_of(sums: pd.DataFrame) -> Model:
    """The model of summed counts (lang, bucket, n)."""
    languages = sorted(set(sums["lang"]))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((BUCKETS + 1 + len(_NAMES), len(languages)))
    counts[sums["bucket"].to_numpy(np.int64), sums["lang"].map(place).to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    ngrams, letters = counts[:BUCKETS], counts[BUCKETS + 1 :]
    # smoothed towards the languages together, each of them weighing the same
    pooled = (ngrams / np.maximum(ngrams.sum(axis=0), 1)).sum(axis=1) + 1e-3 / BUCKETS
    pooled /= pooled.sum()
    logs = np.log((ngrams + PRIOR * pooled[:, None]) / (ngrams.sum(axis=0) + PRIOR))
    logs = np.concatenate([logs, np.zeros((1, len(languages)))]).astype(np.float32)
    shares = letters / np.maximum(letters.sum(axis=0), 1)
    everyone = list(range(len(languages)))
    return Model(languages, logs, [[k for k in everyone if row[k] >= LEAST_SHARE] or everyone for row in shares])


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, spans (lang, start, end in code points).

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. ``score`` is the share of the text's letters in spans
    of ``lang_pred``; texts that are null or have no letter are ``UNKNOWN`` with score 0 and no spans, as are all texts if the
    model knows no language. Texts are read whole, repeated rows stay, an empty table gives no rows.
    """
    @F.pandas_udf("lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model, penalty)
        for texts in batches:
            yield pd.DataFrame([labeller.language(t) for t in texts], columns=["lang_pred", "score", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), label(whole_text()).alias("found"))
    return found.select("doc_id", "held_out", "found.*")
