"""Quality classifier by attention-based multiple-instance learning (operator 3).

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by a small network
over its character classes and word statistics; gated attention weighs the passages, and a logistic
unit scores the weighted mean. Encoder, attention and unit are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuadre.llm.common import fresh, whole_text

PASSAGE = 64
#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE = 20_000
FOLDS, ACCEPT = 5, 0.3
#: Widths of the encoder and the attention, and the training schedule.
HIDDEN, ATTENTION, STEPS, BATCH, RATE, DECAY = 24, 12, 800, 256, 0.01, 1e-4


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line break, other control, non-ASCII, and
    each mark of ASCII punctuation by itself."""
    table = np.full(256, 5, np.int64)
    table[128:] = 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\n\r\x0b\x0c" else table[b]
    table[marks] = 7 + np.arange(len(marks))
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + 5
_SPACE = np.isin(CLASSES, (3, 4))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text (1 if empty)."""
    raw = [(t or "").encode() for t in texts]
    # a document begins with a line break of its own, so words never run across documents
    data = np.frombuffer(b"\n".join([b"", *raw, b"\0\0\0\0"]), np.uint8)[:-5]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    space = _SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    first = np.searchsorted(starts, begins)
    n_words = np.diff(first)
    counts = np.maximum(1, -(-n_words // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    total = int(offsets[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    # passages by word, and by byte: a passage reaches up to the first word of the next
    doc = np.repeat(np.arange(len(raw)), n_words)
    passage = offsets[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    bounds = np.empty(total + 1, np.int64)
    bounds[offsets[:-1]] = begins[:-1]
    inner = np.flatnonzero(np.diff(passage, prepend=-1))
    later = inner[(np.arange(len(starts)) - first[doc])[inner] > 0] if len(starts) else inner
    bounds[passage[later]] = starts[later]
    bounds[total] = len(data)
    of_byte = np.repeat(np.arange(total), np.diff(bounds))
    hist = np.bincount(of_byte * N_CLASSES + CLASSES[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = hist / np.maximum(1, hist.sum(axis=1, keepdims=True))
    if len(starts):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        ends = np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(data))[: len(starts)]
        length = ends - starts
        code = np.zeros(len(starts), np.int64)
        for k in range(4):
            code |= np.where(length > k, padded[starts + k], 0).astype(np.int64) << (8 * k)
        key = np.sort((passage << 40) | (np.minimum(length, 255) << 32) | code)
        n = np.bincount(passage, minlength=total)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount(key[new] >> 40, minlength=total)
        mean = np.bincount(passage, length, total) / np.maximum(n, 1)
        square = np.bincount(passage, length.astype(float) ** 2, total) / np.maximum(n, 1)
        out[:, N_CLASSES] = distinct / np.maximum(n, 1)
        out[:, N_CLASSES + 1] = np.log1p(mean)
        out[:, N_CLASSES + 2] = np.log1p(np.sqrt(np.maximum(square - mean**2, 0)))
        out[:, N_CLASSES + 3] = np.bincount(passage, length > 24, total) / np.maximum(n, 1)
        out[:, N_CLASSES + 4] = np.log1p(n)
    return out, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    rate: float | None = None

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(counts), self.rate)
        return _forward(self.weights, (x - self.mean) / self.scale, counts)[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> tuple:
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    h = np.tanh(x @ w["encode"] + w["encode0"])
    value, gate = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    logit = (value * gate) @ w["attend"]
    e = np.exp(logit - np.maximum.reduceat(logit, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return starts, doc, h, value, gate, a, z, _sigmoid(z @ w["out"] + w["out0"])


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    starts, doc, h, value, gate, a, z, p = _forward(w, x, counts)
    d = (p - y) / len(y)
    dz = d[:, None] * w["out"]
    da = (h * dz[doc]).sum(axis=1)
    mean = np.add.reduceat(a * da, starts)
    dlogit = a * (da - mean[doc])
    dmix = dlogit[:, None] * w["attend"]
    dvalue, dgate = dmix * gate * (1 - value**2), dmix * value * gate * (1 - gate)
    dh = a[:, None] * dz[doc] + dvalue @ w["value"].T + dgate @ w["gate"].T
    dpre = dh * (1 - h**2)
    return {
        "encode": x.T @ dpre, "encode0": dpre.sum(axis=0), "value": h.T @ dvalue, "gate": h.T @ dgate,
        "attend": (value * gate).T @ dlogit, "out": z.T @ d, "out0": np.array(d.sum()),
    }


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Fit encoder, attention and unit on bags of passage features with labels 0 and 1.

    Without bags the score is one half, with one label only it is the label's smoothed rate.
    """
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float((y.sum() + 1) / (len(y) + 2)))
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    rng = np.random.default_rng(seed)
    w = {
        "encode": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "encode0": np.zeros(HIDDEN),
        "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "attend": rng.normal(0, 0.1, ATTENTION), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out0": np.zeros(()),
    }
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        chosen = rng.choice(len(y), min(BATCH, len(y)), replace=False)
        batch = [bags[i] for i in chosen]
        g = _gradients(w, (np.concatenate(batch) - mean) / scale, np.array([len(b) for b in batch]), y[chosen])
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k in w:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            w[k] = w[k] * (1 - rate * DECAY) - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(column: str = "doc_id") -> Column:
    """Whether the document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    The hash is compared with the share that leaves about nine tenths of ``sample``, so no task and
    not the driver sees more labels than that.

    ``docs``: doc_id, text; ``labels``: doc_id, quality (0 or 1; null is no label, of several the
    largest counts). Passage features of the sample go to the driver, texts do not.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    n = known.agg(F.count_distinct("doc_id").alias("n")).first()["n"]
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    few = known if n <= sample else known.filter(place < 0.9 * sample / n)
    chosen = few.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, counts = features(frame["text"].tolist())
            bags = np.split(x, np.cumsum(counts)[:-1])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "bag": [b.tobytes() for b in bags]})

    got = rows.mapInPandas(passages, "doc_id long, y double, bag binary").toPandas().sort_values(["doc_id", "bag"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for b in got["bag"]]
    return fit(bags, got["y"].to_numpy(float))


def scorer(model: Model):
    """A column function: text -> score between 0 and 1."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out, block, size = [], [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > 4_000_000:
                out.append(model.score(*features(block)))
                block, size = [], 0
        if block:
            out.append(model.score(*features(block)))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Only ``text`` (null: empty) goes into the score; other columns are ignored, repeated rows stay, a
    null doc_id is held out. An empty table gives no rows; without labels every score is one half.
    """
    score = scorer(train(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(whole_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    column = fresh(docs, "score")
    score = scorer(train(docs, labels, sample))
    return docs.withColumn(column, score(whole_text())).filter(F.col(column) >= ACCEPT).select(*docs.columns)
