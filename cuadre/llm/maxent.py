"""Language-model scoring with a hashed maximum-entropy model (operator 8).

P(word | context) = P(class | context) * P(word | class, context). The class is a softmax over hashed
features of the two words before: each alone (the second one as a skip) and both together. Inside a
class the frequent words are a softmax with the class of the word before; all other words form one
class, in which a word has its smoothed share of the training tokens, so that the model is a
distribution over all known words and one unknown one.

Tasks make gradient steps on their documents from common parameters, Spark adds up what they changed,
and the mean is the next round's start. Texts are scored in batches of arrays. Counts of all words
stay in Spark; tasks hold the most frequent ones, the rest meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cuadre.llm.common import pylists, whole_text, written

#: Words that tasks know, and those of them that have a class of the model's own softmax.
HEAD, MODEL = 65_536, 4096
#: Classes, the last one for all words outside the model.
CLASSES = 16
REST = CLASSES - 1
#: Hash spaces of the features: word before, both words before, skip to the second word before.
SPACES = (1 << 14, 1 << 15, 1 << 14)
ROWS = sum(SPACES)
ROUNDS, BATCH, RATE, PRIOR, POWER = 1, 1 << 15, 1.0, 20.0, 0.9
#: Feature rows in one message of a task.
BLOCK = 1024
#: Counted words that a task holds before it passes them on.
HELD = 400_000
SMOOTH = 0.1
#: The end of a text as a token; no word holds white space.
END = b"\n"
FOLDS = 10

RARE, START = HEAD, HEAD + 1


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 10; null is."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def tokenize(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _blocks(rows: list[tuple], chars: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows whose last item is a text, in blocks of about as many characters."""
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[-1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def passed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        seen.clear()
        return out

    for held, texts in pylists(batches, "held_out", "text"):
        for out, text in zip(held, texts, strict=True):
            if not out:
                seen.update(tokenize(text))
                if len(seen) >= HELD:
                    yield passed()
    if seen:
        yield passed()


@dataclass
class Vocabulary:
    """The most frequent words by rank, their counts and classes; N, V and the rest's mass."""

    ids: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    total: int
    distinct: int

    @property
    def norm(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    @property
    def rest_norm(self) -> float:
        """Mass of all words outside the model and of the unknown one."""
        inside = min(len(self.ids), MODEL)
        return self.total - float(self.counts[:inside].sum()) + SMOOTH * (self.distinct - inside + 1)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From (token, c): the most frequent words, at most ``head``, go to the tasks, the end of a text always.

    Words are taken by whole steps of their count (16 for each doubling), so the driver gets a small
    histogram and then the words themselves, however many partitions the counts have.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    step = F.floor(F.log2("c") * 16).cast("int")
    least, left = 0, min(head, HEAD) - 1
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= row["n"]
        if left < 0:
            least = row["step"] + 1
            break
    end = F.col("token") == F.lit(END)
    top = sorted(counts.filter((step >= least) | end).collect(), key=lambda r: (bytes(r["token"]) != END, -r["c"], bytes(r["token"])))
    held = np.array([r["c"] for r in top], np.float64)
    classes = np.full(HEAD + 2, REST, np.int8)
    inside = np.sqrt(held[:MODEL])
    if len(inside):
        classes[: len(inside)] = np.minimum(np.cumsum(inside) / inside.sum() * REST, REST - 1).astype(np.int8)
    return Vocabulary({bytes(r["token"]): i for i, r in enumerate(top)}, held, classes, int(total["n"] or 0), int(total["v"]))


@dataclass
class Model:
    """Class parameters by feature row, and log10 P(word | its class, class before) by class before."""

    bias: np.ndarray
    weights: np.ndarray
    inside: np.ndarray


def _hash(values: np.ndarray, space: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(space)))).astype(np.int32)


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all tokens of the documents: ids, ids before, feature rows."""
    pad = np.full(2, START, np.int32)
    line = np.concatenate([x for d in docs for x in (pad, d)])
    lengths = np.array([len(d) for d in docs])
    at = np.arange(lengths.sum()) + np.repeat(2 * np.arange(1, len(docs) + 1), lengths)
    one, two = line[at - 1], line[at - 2]
    both = one.astype(np.uint64) * np.uint64(HEAD + 2) + two.astype(np.uint64) + np.uint64(1)
    rows = [_hash(one, SPACES[0]), SPACES[0] + _hash(both, SPACES[1]), SPACES[0] + SPACES[1] + _hash(two, SPACES[2])]
    return line[at], one, rows


def class_probabilities(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = bias + sum(weights[r] for r in rows)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(axis=1, keepdims=True)


class Trainer:
    """Gradient steps of one task, from common parameters."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray, classes: np.ndarray):
        self.bias, self.weights, self.classes = bias, weights.copy(), classes
        self.seen = np.zeros(ROWS, np.float32)
        self.pairs = np.zeros((CLASSES, MODEL), np.float32)
        self.tokens = 0

    def learn(self, docs: list[np.ndarray]) -> None:
        target, one, rows = contexts(docs)
        self.tokens += len(target)
        known = target < MODEL
        before = self.classes[one]
        self.pairs += np.bincount(before[known].astype(np.int64) * MODEL + target[known], minlength=CLASSES * MODEL).reshape(CLASSES, MODEL)
        wanted = self.classes[target]
        for a in range(0, len(target), BATCH):
            part = [r[a : a + BATCH] for r in rows]
            g = class_probabilities(self.bias, self.weights, part)
            g[np.arange(len(g)), wanted[a : a + BATCH]] -= 1
            for r in part:
                used, place, n = np.unique(r, return_inverse=True, return_counts=True)
                slope = np.stack([np.bincount(place, g[:, k], len(used)) for k in range(CLASSES)], axis=1)
                self.seen[used] += n
                self.weights[used] -= (RATE / len(part) * slope / (PRIOR + self.seen[used, None]) ** POWER).astype(np.float32)


def _within(pairs: np.ndarray, classes: np.ndarray, steps: int = 60) -> np.ndarray:
    """log10 P(word | class, class before), by gradient steps on counts by (class before, word)."""
    n_words = pairs.shape[1]
    order = classes[:n_words].astype(np.int64)
    starts = np.flatnonzero(np.diff(order, prepend=-1))
    total = pairs.sum(axis=0) + SMOOTH
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n_words)))
    base = np.log(total / np.add.reduceat(total, starts)[group])
    extra = np.zeros_like(pairs)

    def log_p() -> np.ndarray:
        z = base + extra
        z -= np.maximum.reduceat(z, starts, axis=1)[:, group]
        return z - np.log(np.add.reduceat(np.exp(z), starts, axis=1))[:, group]

    mass = np.add.reduceat(pairs, starts, axis=1)[:, group]
    for _ in range(steps):
        expected = mass * np.exp(log_p())
        extra += (pairs - expected) / (np.maximum(pairs, expected) + PRIOR)
    return log_p() / math.log(10)


def _encode(texts: list[str], ids: dict[bytes, int]) -> list[np.ndarray]:
    get = ids.get
    return [np.array([get(w, RARE) for w in tokenize(t)], np.int32) for t in texts]


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of gradient steps over all training documents (held_out, text) and the mean of the tasks' changes."""
    spark = docs.sparkSession
    mass = np.bincount(words.classes[: len(words.counts)], words.counts, CLASSES)
    mass[REST] += words.total - words.counts.sum()
    bias = np.log((mass + SMOOTH) / (mass + SMOOTH).sum()).astype(np.float32)
    weights, pairs = np.zeros((ROWS, CLASSES), np.float32), np.zeros((CLASSES, MODEL))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((words.ids, words.classes, bias, weights))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, classes, start_bias, start = shared.value
            trainer = Trainer(start_bias, start, classes)
            for held, texts in pylists(batches, "held_out", "text"):
                for block in _blocks([(t or "",) for out, t in zip(held, texts, strict=True) if not out]):
                    trainer.learn(_encode([t for (t,) in block], ids))
            if trainer.tokens:
                part = TaskContext.get().partitionId()
                # a row's change counts with the tokens that made it
                change = (trainer.weights - start) * trainer.seen[:, None]
                for b in range(0, ROWS, BLOCK):
                    if trainer.seen[b : b + BLOCK].any():
                        values = np.concatenate([change[b : b + BLOCK], trainer.seen[b : b + BLOCK, None]], axis=1)
                        yield _message(part, b // BLOCK, values)
                for c in range(CLASSES):
                    yield _message(part, ROWS // BLOCK + c, trainer.pairs[c])

        sent = written(docs.select("held_out", "text").mapInArrow(learn, "part int, block int, values binary"), "gradients")
        tasks = sent.agg(F.count_distinct("part").alias("n")).first()["n"]
        halves = sent.withColumn("some", F.pmod("part", F.lit(max(1, math.isqrt(tasks)))))
        some = halves.groupBy("block", "some").applyInPandas(_add, "block int, values binary")
        pairs = np.zeros((CLASSES, MODEL))
        for row in some.groupBy("block").applyInPandas(_add, "block int, values binary").collect():
            values = np.frombuffer(row["values"], np.float32)
            if row["block"] >= ROWS // BLOCK:
                pairs[row["block"] - ROWS // BLOCK] = values
            else:
                values = values.reshape(-1, CLASSES + 1)
                weights[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += values[:, :CLASSES] / np.maximum(values[:, CLASSES:], 1)
        shared.unpersist()
    inside = _within(pairs[:, : max(1, min(MODEL, len(words.ids)))], words.classes)
    return Model(bias, weights, inside)


def _message(part: int, block: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], names=["part", "block", "values"]
    )


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in rows["values"])
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "values": [total.astype(np.float32).tobytes()]})


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, n_rest long, tokens array<binary>, times array<long>"


def _score(shared):
    """Sums over the words that tasks know; the other words with their numbers."""
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
        ("model", pa.float64()), ("n_rest", pa.int64()), ("tokens", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        get = words.ids.get
        row = TaskContext.get().partitionId() << 40
        logs = np.zeros(HEAD + 2)
        logs[: len(words.counts)] = np.log10(words.counts + SMOOTH)
        for doc_ids, held, texts in pylists(batches, "doc_id", "held_out", "text"):
            for block in _blocks([(i, h, t or "") for i, h, t in zip(doc_ids, held, texts, strict=True)]):
                docs, rest = [], []
                for _, _, text in block:
                    tokens = tokenize(text)
                    found = [get(w, RARE) for w in tokens]
                    docs.append(np.array(found, np.int32))
                    rest.append(Counter(w for w, i in zip(tokens, found, strict=True) if i == RARE))
                target, one, rows = contexts(docs)
                classes = words.classes[target]
                lengths = np.array([len(d) for d in docs])
                doc = np.repeat(np.arange(len(docs)), lengths)
                log_class = np.empty(len(target))
                for a in range(0, len(target), BATCH):
                    p = class_probabilities(model.bias, model.weights, [r[a : a + BATCH] for r in rows])
                    log_class[a : a + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), classes[a : a + BATCH]], 1e-30))
                inside = target < model.inside.shape[1]
                inside &= target < len(words.ids)
                log_word = logs[target].copy()
                log_word[inside] = model.inside[words.classes[one[inside]], target[inside]]
                total = lambda x: np.bincount(doc, x, len(docs))
                known = target < HEAD
                n = len(docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), pa.array([i for i, _, _ in block], pa.int64()), pa.array([h for _, h, _ in block]), pa.array(lengths, pa.int64()),
                    pa.array(total(known).astype(np.int64)), pa.array(total(logs[target])), pa.array(total(log_class + log_word)), pa.array(total(~inside).astype(np.int64)),
                    pa.array([list(c.keys()) for c in rest], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64())),
                ], schema=schema)
                row += n

    return run


def score(docs: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has ``doc_id`` and ``text`` (null: empty, one end token); other columns are ignored,
    repeated rows stay and are learned from each. The model learns from the documents that are not
    held out; a null doc_id is held out. ``base_score`` is the smoothed unigram log10 probability,
    ``score`` the model's. Without training documents every token is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    seen = rows.select("held_out", "text").mapInArrow(_count, "token binary, n long")
    counts = written(seen.groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    words = vocabulary(counts, head)
    model = train(rows, words, rounds)
    shared = spark.sparkContext.broadcast((words, model))
    scored = written(rows.mapInArrow(_score(shared), SCORED), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = pairs.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"), F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("rest_log")
    )
    rest_known, rest_log = F.coalesce("rest_known", F.lit(0)), F.coalesce("rest_log", F.lit(0.0))
    return scored.drop("tokens", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + rest_known).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest_log - F.col("n_tokens") * math.log10(words.norm)).alias("base_score"),
        (F.col("model") + rest_log - F.col("n_rest") * math.log10(max(words.rest_norm, SMOOTH))).alias("score"),
    )
