"""Name similarity: the composite score, its parts, and lossless upper bounds.

The score of two normalized names is
``.2*ratio + .2*partial_ratio + .3*token_sort + .3*token_set``; every part is a
whole number 0..100, rounded half to even. All parts rest on the longest common
subsequence (LCS), which Spark has no function for.

Two layers:

* *Bounds* are plain Spark expressions over precomputed bit signatures. They sit
  inside join conditions, compile to a few machine operations per pair and
  never underestimate the score.
* *Scores* run in an Arrow batch function, on the pairs that pass the bound. It
  advances the bit-parallel LCS recurrence for the whole batch at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuadre.functions.text import normalize_name

# Executors need not have this package installed to run the batch functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --------------------------------------------------------------------------
# Signatures and bounds (Spark expressions)
# --------------------------------------------------------------------------

# How many occurrences of each character get a bit, per signature word. What
# does not fit is counted in ``extra``, so the bound stays valid.
_CAPACITY = [
    {"a": 7, "e": 7, "i": 6, "o": 7, "u": 4, " ": 8, "r": 6, "s": 6, "n": 6, "t": 6},
    {"l": 5, "c": 5, "d": 5, "m": 4, "p": 4, "b": 4, "g": 4, "h": 4, "f": 4, "v": 3, "k": 3,
     "y": 3, "z": 3, "w": 3, "j": 3, "x": 3, "q": 2},
    {"0": 9, "1": 6, "2": 6, "3": 6, "4": 6, "5": 6, "6": 6, "7": 6, "8": 6, "9": 6},
]

SIGNATURE = ["len", "ulen", "digits", "s0", "s1", "s2", "extra", "words"]


def _occurrences(norm: Column, char: str) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(char), F.lit("")))


def _unary_word(norm: Column, capacity: dict[str, int]) -> Column:
    """One bit per (character, occurrence); bits common to two words count shared characters."""
    word, at = F.lit(0).cast("bigint"), 0
    for char, cap in capacity.items():
        seen = F.least(_occurrences(norm, char), F.lit(cap))
        # shiftleft needs a literal count, so the run of ones is looked up.
        runs = F.array(*[F.lit(((1 << k) - 1) << at).cast("bigint") for k in range(cap + 1)])
        word, at = word.bitwiseOR(F.get(runs, seen)), at + cap
    assert at <= 63
    return word


def with_signature(df: DataFrame) -> DataFrame:
    """Adds the columns that bound the score of a normalized name ``norm`` against any other.

    They are never null, so join code over them carries no null checks.
    """
    counted = sum((F.bit_count(s) for s in ("s0", "s1", "s2")), F.lit(0))
    bits = {name: F.coalesce(col, F.lit(0)) for name, col in _signature(F.col("norm")).items()}
    return df.withColumns(bits).withColumn("extra", F.col("len") - counted)


def _signature(norm: Column) -> dict[str, Column]:
    words = [_unary_word(norm, cap) for cap in _CAPACITY]
    tokens = F.array_distinct(F.split(norm, " "))
    bit = [F.lit(1 << i).cast("bigint") for i in range(62)]
    token_bits = F.transform(tokens, lambda t: F.get(F.array(*bit), F.pmod(F.xxhash64(t), F.lit(62)).cast("int")))
    return {
        "len": F.length(norm),
        "ulen": F.length(F.array_join(tokens, " ")),
        "digits": F.length(F.regexp_replace(norm, "[^0-9]", "")),
        "s0": words[0], "s1": words[1], "s2": words[2],
        "words": F.aggregate(token_bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b)),
    }


def score_bound(left: str, right: str) -> Column:
    """Upper bound of the score of two signature rows (aliases ``left``/``right``).

    Shared characters bound every LCS; a word signature tells when no token is
    shared, or when neither token set contains the other.
    """
    a = lambda name: F.col(f"{left}.{name}")
    b = lambda name: F.col(f"{right}.{name}")
    common = sum((F.bit_count(a(s).bitwiseAND(b(s))) for s in ("s0", "s1", "s2")), F.least(a("extra"), b("extra")))
    shorter = F.least(a("len"), b("len"))
    ratio = 200.0 * common / (a("len") + b("len"))
    partial = 200.0 * common / (shorter + common)
    ushort = F.least(a("ulen"), b("ulen"))
    apart = 200.0 * F.least(common, ushort) / (a("ulen") + b("ulen"))
    shared = F.greatest(F.least(common, ushort - 2), F.lit(0))
    overlap = F.greatest(apart, 200.0 * shared / (shared + ushort))
    both = a("words").bitwiseAND(b("words"))
    token_set = (
        F.when(both == 0, apart)
        .when((both != a("words")) & (both != b("words")), overlap)
        .otherwise(100.0)
    )
    return 0.5 * ratio + 0.2 * partial + 0.3 * token_set + 0.5


def cell_bound(query: str, cell: str) -> Column:
    """Upper bound of the score of a name against any name of a cell.

    A cell gives ranges of length, digits and letters.
    """
    q = lambda name: F.col(f"{query}.{name}")
    c = lambda name: F.col(f"{cell}.{name}")
    common = F.least(q("digits"), c("max_digits")) + F.least(q("len") - q("digits"), c("max_letters"))
    best_len = F.least(F.greatest(common, c("min_len")), c("max_len"))
    return 100.0 * F.least(common, best_len) / (q("len") + best_len) + 50.5


# --------------------------------------------------------------------------
# Scores (Arrow batches)
# --------------------------------------------------------------------------

_PARTS = ["ratio", "partial_ratio", "token_sort", "token_set", "score"]
_SYMBOLS = 38  # padding, blank, a-z, 0-9


class _Names:
    """Distinct strings of a batch as code rows, lengths and LCS match masks."""

    def __init__(self, names: list[str]):
        raw = np.array([n.encode() for n in names], dtype="S")
        width = max(raw.dtype.itemsize, 1)
        text = raw.view(np.uint8).reshape(len(names), width)
        code = np.zeros(256, np.uint8)
        code[32] = 1
        code[97:123] = np.arange(2, 28)
        code[48:58] = np.arange(28, 38)
        self.codes = code[text]
        self.length = (self.codes > 0).sum(axis=1).astype(np.int64)
        self.words = (width + 63) // 64
        masks = np.zeros((len(names), self.words, _SYMBOLS), np.uint64)
        rows = np.arange(len(names))
        for p in range(width):
            masks[rows, p // 64, self.codes[:, p]] |= np.uint64(1 << (p % 64))
        masks[:, :, 0] = 0
        self.masks = masks.reshape(-1)


def _advance(state: list[np.ndarray], match: list[np.ndarray]) -> list[np.ndarray]:
    """One step of the bit-parallel LCS recurrence, multi-word with carry."""
    if len(state) == 1:
        hit = state[0] & match[0]
        return [(state[0] + hit) | (state[0] - hit)]
    out, carry = [], None
    for v, m in zip(state, match):
        hit = v & m
        total = v + hit
        over = total < v
        if carry is not None:
            total = total + carry
            over = over | (total < carry)
        carry = over.astype(np.uint64)
        out.append(total | (v - hit))
    return out


def _zeros(state: list[np.ndarray]) -> np.ndarray:
    """LCS length: the cleared bits."""
    return sum((np.bitwise_count(~v).astype(np.int64) for v in state), np.int64(0))


def _ones(n: int, words: int) -> list[np.ndarray]:
    return [np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(words)]


def _lcs(a: _Names, ia, b: _Names, ib, keep_a=None, keep_b=None) -> np.ndarray:
    """LCS length per pair; ``keep_*`` restrict either side to some positions."""
    state = _ones(len(ia), a.words)
    base = [(ia * a.words + w) * _SYMBOLS for w in range(a.words)]
    codes = b.codes[ib]
    for j in range(int(b.length[ib].max(initial=0))):
        code = codes[:, j]
        if keep_b is not None:
            code = code * ((keep_b[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.uint8)
        match = [a.masks[at + code] for at in base]
        if keep_a is not None:
            match = [m & k for m, k in zip(match, keep_a)]
        state = _advance(state, match)
    return _zeros(state)


def _percent(part, whole) -> np.ndarray:
    """``100 * part / whole`` as an exact whole number, half to even."""
    whole = np.maximum(whole, 1)
    q, r = np.divmod(100 * part, whole)
    return q + ((2 * r > whole) | ((2 * r == whole) & (q % 2 == 1)))


def _partial(short: _Names, i_s, long: _Names, i_l) -> np.ndarray:
    """Best ratio of the shorter string against the windows of the longer one.

    Windows are all substrings of the shorter one's length, and the shorter
    prefixes and suffixes. A run from position 0 yields every prefix on its way.
    """
    order = np.argsort(-short.length[i_s], kind="stable")
    i_s, i_l = i_s[order], i_l[order]
    m, n = short.length[i_s], long.length[i_l]
    codes = long.codes[i_l]
    width = codes.shape[1]
    base = [(i_s * short.words + w) * _SYMBOLS for w in range(short.words)]
    active = np.searchsorted(-m, -np.arange(int(m.max(initial=0))), side="left")
    best = np.zeros(len(m), np.int64)
    for start in range(int(n.max(initial=0))):
        state = _ones(len(m), short.words)
        for j, live in enumerate(active):
            if start + j >= width:
                break
            code = codes[:live, start + j]
            stepped = _advance([v[:live] for v in state], [short.masks[at[:live] + code] for at in base])
            for v, s in zip(state, stepped):
                v[:live] = s
            if start == 0:
                got = _zeros(stepped)
                best[:live] = np.maximum(best[:live], _percent(2 * got, m[:live] + np.minimum(j + 1, n[:live])))
        window = np.clip(n - start, 0, m)
        best = np.maximum(best, np.where(window > 0, _percent(2 * _zeros(state), m + window), 0))
    out = np.empty_like(best)
    out[order] = best
    return out


def _partial_ratio(a: _Names, ia, b: _Names, ib) -> np.ndarray:
    m, n = a.length[ia], b.length[ib]
    out = np.zeros(len(ia), np.int64)
    forward, backward = np.flatnonzero(m <= n), np.flatnonzero(m >= n)  # equal lengths: both ways
    if len(forward):
        out[forward] = _partial(a, ia[forward], b, ib[forward])
    if len(backward):
        out[backward] = np.maximum(out[backward], _partial(b, ib[backward], a, ia[backward]))
    return out


class _Tokens:
    """Distinct sorted tokens of each name, with the bits each occupies.

    The text has a leading blank, so a token and the blank before it form one
    span and any subset of spans, less its first blank, is the joined subset.
    """

    def __init__(self, names: list[str], vocabulary: dict[str, int], missing: int):
        lists = [sorted(set(n.split())) for n in names]
        self.count = np.array([len(t) for t in lists], np.int64)
        self.text = _Names(["".join(" " + t for t in toks) for toks in lists])
        depth, words = int(self.count.max(initial=0)), self.text.words
        self.ids = np.full((len(names), depth), missing, np.int64)
        self.sizes = np.zeros((len(names), depth), np.int64)
        self.spans = np.zeros((words, len(names), depth), np.uint64)
        for row, toks in enumerate(lists):
            at = 0
            for k, tok in enumerate(toks):
                self.ids[row, k] = vocabulary.setdefault(tok, len(vocabulary))
                self.sizes[row, k] = len(tok)
                span = ((1 << (len(tok) + 1)) - 1) << at
                at += len(tok) + 1
                for w in range(words):
                    self.spans[w, row, k] = (span >> (64 * w)) & 0xFFFFFFFFFFFFFFFF

    def rest(self, rows, shared) -> tuple[list[np.ndarray], np.ndarray]:
        """Position masks and joined length of the tokens that are not shared."""
        keep = [
            np.bitwise_or.reduce(np.where(shared, np.uint64(0), self.spans[w, rows]), axis=1)
            for w in range(self.text.words)
        ]
        cleared = np.zeros(len(rows), bool)
        for w, k in enumerate(keep):  # drop the first blank
            first = ~cleared & (k != 0)
            keep[w] = np.where(first, k & (k - np.uint64(1)), k)
            cleared |= first
        return keep, _zeros([~k for k in keep])


def _token_set(a: _Tokens, ia, b: _Tokens, ib) -> np.ndarray:
    ids_a, ids_b = a.ids[ia], b.ids[ib]
    in_b = np.zeros(ids_a.shape, bool)
    in_a = np.zeros(ids_b.shape, bool)
    for k in range(ids_b.shape[1]):
        same = ids_a == ids_b[:, k : k + 1]
        in_b |= same
        in_a[:, k] = same.any(axis=1)
    shared = in_b.sum(axis=1)
    joined = (a.sizes[ia] * in_b).sum(axis=1) + np.maximum(shared - 1, 0)
    keep_a, len_a = a.rest(ia, in_b)
    keep_b, len_b = b.rest(ib, in_a)
    lcs = _lcs(a.text, ia, b.text, ib, keep_a, keep_b)
    glue = joined + (shared > 0)
    whole_a, whole_b = glue + len_a, glue + len_b
    score = _percent(whole_a + whole_b - len_a - len_b + 2 * lcs, whole_a + whole_b)
    some = shared > 0
    score = np.where(some, np.maximum(score, _percent(2 * joined, joined + whole_a)), score)
    score = np.where(some, np.maximum(score, _percent(2 * joined, joined + whole_b)), score)
    score = np.where(some & ((len_a == 0) | (len_b == 0)), 100, score)
    return np.where((a.count[ia] == 0) | (b.count[ib] == 0), 0, score)


def _sorted_tokens(name: str) -> str:
    return " ".join(sorted(name.split()))


_SLICE = 16384  # pairs that stay in cache
_GATHER = 262144  # pairs that share the preparation of their names


def _sliced(fn, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    parts = [fn(ia[i : i + _SLICE], ib[i : i + _SLICE]) for i in range(0, len(ia), _SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _score_pairs(left: pd.Series, right: pd.Series, need: np.ndarray | None) -> dict[str, np.ndarray]:
    """Parts and score of each pair; with ``need``, pairs that cannot reach it keep score -1.

    The parts come in order of cost, and a pair drops out as soon as full marks
    for the remaining parts would not do.
    """
    ia, names_a = pd.factorize(left)
    ib, names_b = pd.factorize(right)
    names_a, names_b = list(names_a), list(names_b)
    a, b = _Names(names_a), _Names(names_b)
    m, n = a.length[ia], b.length[ib]
    both = m + n
    lcs = _sliced(lambda i, j: _lcs(a, i, b, j), ia, ib)
    ratio = np.where(both == 0, 100, _percent(2 * lcs, both))
    # a window of the longer name shares no more with the shorter one than the whole does
    most = np.ceil(200 * lcs / np.maximum(np.minimum(m, n) + lcs, 1))
    base = 2 * ratio
    go = np.arange(len(ia))

    def able(room: int) -> np.ndarray:
        return go if need is None else go[base[go] + 2 * most[go] + room >= 10 * need[go]]

    go = able(600)
    token_sort = np.zeros(len(ia), np.int64)
    if len(go):
        (ua, ja), (ub, jb) = (np.unique(i[go], return_inverse=True) for i in (ia, ib))
        sa = _Names([_sorted_tokens(names_a[i]) for i in ua])
        sb = _Names([_sorted_tokens(names_b[i]) for i in ub])
        token_sort[go] = _percent(2 * _sliced(lambda i, j: _lcs(sa, i, sb, j), ja, jb), both[go])
    token_sort = np.where(both == 0, 100, token_sort)
    base = base + 3 * token_sort
    go = able(300)
    token_set = np.zeros(len(ia), np.int64)
    if len(go):
        (ua, ja), (ub, jb) = (np.unique(i[go], return_inverse=True) for i in (ia, ib))
        vocabulary: dict[str, int] = {}
        ta = _Tokens([names_a[i] for i in ua], vocabulary, -1)
        tb = _Tokens([names_b[i] for i in ub], vocabulary, -2)
        token_set[go] = _sliced(lambda i, j: _token_set(ta, i, tb, j), ja, jb)
    base = base + 3 * token_set
    go = able(0)
    partial = np.zeros(len(ia), np.int64)
    if len(go):
        partial[go] = _sliced(lambda i, j: _partial_ratio(a, i, b, j), ia[go], ib[go])
    partial = np.where(both == 0, 100, partial)
    score = np.full(len(ia), -1.0)
    score[go] = (base[go] + 2 * partial[go]) / 10.0
    return {"ratio": ratio, "partial_ratio": partial, "token_sort": token_sort, "token_set": token_set, "score": score}


def _by_width(left: pd.Series, right: pd.Series, need: np.ndarray | None) -> dict[str, np.ndarray]:
    """Score a batch, long names apart so that short ones stay in one machine word."""
    out = {k: np.full(len(left), -1.0) for k in _PARTS}
    known = (left.notna() & right.notna()).to_numpy()
    longest = np.maximum(left.str.len().fillna(0), right.str.len().fillna(0)).to_numpy()
    for part in (known & (longest <= 63), known & (longest > 63)):
        at = np.flatnonzero(part)
        if len(at):
            got = _score_pairs(left.iloc[at], right.iloc[at], None if need is None else need[at])
            for k in _PARTS:
                out[k][at] = got[k]
    return out


@F.pandas_udf(T.StructType([T.StructField(part, T.DoubleType()) for part in _PARTS]))
def _parts_udf(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    got = pd.DataFrame(_by_width(left, right, None))
    return got.where(got["score"] >= 0)


@F.pandas_udf(T.DoubleType())
def _score_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Scores, or null below ``need``; several Arrow batches share one preparation."""

    def run(held: list[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        left, right, need = (pd.concat(c, ignore_index=True) for c in zip(*held))
        got = pd.Series(_by_width(left, right, need.to_numpy())["score"])
        got = got.where(got >= need)
        at = 0
        for part, *_ in held:
            yield got.iloc[at : at + len(part)]
            at += len(part)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch[0])
        if rows >= _GATHER:
            yield from run(held)
            held, rows = [], 0
    if held:
        yield from run(held)


def similarity_parts(left: Column, right: Column) -> Column:
    """Struct ``(ratio, partial_ratio, token_sort, token_set, score)`` of two raw names."""
    return _parts_udf(normalize_name(left), normalize_name(right))


def score_at_least(left_norm: Column, right_norm: Column, need: Column) -> Column:
    """Score of two normalized names, or null when it is below ``need``."""
    return _score_udf(left_norm, right_norm, need.cast("double"))
