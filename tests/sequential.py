"""Plain sequential versions of the fuzzy operators, for comparison."""

import re
from fractions import Fraction


def norm(name):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", name.lower())).strip()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100 if not a and not b else round(Fraction(200 * lcs(a, b), len(a) + len(b)))


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a

    def one(s, t):
        m = len(s)
        windows = {t[i : i + m] for i in range(len(t) - m + 1)}
        windows |= {t[:k] for k in range(1, m)} | {t[-k:] for k in range(1, m)}
        return max(ratio(s, w) for w in windows)

    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0
    both, x, y = (" ".join(sorted(t)) for t in (ta & tb, ta - tb, tb - ta))
    if both and (not x or not y):
        return 100
    i, glue = len(both), len(both) + (1 if both else 0)
    la, lb = glue + len(x), glue + len(y)
    best = round(100 * (1 - Fraction(len(x) + len(y) - 2 * lcs(x, y), la + lb)))
    if both:
        best = max(best, round(Fraction(200 * i, i + la)), round(Fraction(200 * i, i + lb)))
    return best


def parts(a, b):
    r, p, s, t = ratio(a, b), partial(a, b), token_sort(a, b), token_set(a, b)
    return r, p, s, t, (2 * r + 2 * p + 3 * s + 3 * t) / 10


def score(a, b):
    return parts(norm(a), norm(b))[4]


def first_fit(rows, threshold):
    """rows: (id, name); returns id -> leader id."""
    leaders, out = [], {}
    for id_, name in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = next((i for i, n in leaders if norm(n) and norm(name) and score(n, name) >= threshold), None)
        if hit is None:
            leaders.append((id_, name))
        out[id_] = id_ if hit is None else hit
    return out
