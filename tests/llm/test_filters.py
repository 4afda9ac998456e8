"""URL filter, secret scan, quality classifier and decontamination against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuadre.llm import quality, secret_scan, templates, urls
from tests.llm.conftest import SF, texts_of

RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def strength(rows):
    """rows: (good, bad, parent)."""
    rows = [(g, g + b, m) for g, b, m in rows if g + b]
    scale = sum((n - 1) * m * (1 - m) for _, n, m in rows)
    share = sum(n * (g / n - m) ** 2 - m * (1 - m) for g, n, m in rows) / scale if scale else 0.5
    return 1 / min(max(share, 0.001), 0.999) - 1


def plain_judge(pages):
    rule = {}
    for i, (_, url) in enumerate(pages):
        host, path = parse(url)
        fits = [(len(h + p), h + p, ok) for h, p, ok in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule[i] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    hosts = {h: [0, 0] for h, *_ in rule.values()}
    for h, _, _, ok in rule.values():
        if ok is not None:
            hosts[h][0 if ok else 1] += 1

    def suffix(h):
        m = re.search(r"\.((?:ac|co|com|edu|gov|ne|net|or|org)\.[a-z]{2})\Z", h)
        return m[1] if m else h.rsplit(".", 1)[-1]

    def domain(h):
        s = suffix(h)
        return h[: -len(s) - 1].rsplit(".", 1)[-1] + "." + s if len(h) > len(s) + 1 else h

    def gather(keys):
        out = {}
        for h, (g, b) in hosts.items():
            x = out.setdefault(keys(h), [0, 0])
            x[0], x[1] = x[0] + g, x[1] + b
        return out

    good, bad = (sum(x[k] for x in hosts.values()) for k in (0, 1))
    overall = (good + 1) / (good + bad + 2)
    shrink = lambda x, k, m: (x[0] + k * m) / (x[0] + x[1] + k)
    s = gather(suffix)
    k = strength([(*x, overall) for x in s.values()])
    s = {n: shrink(x, k, overall) for n, x in s.items()}
    d = gather(domain)
    parent = {domain(h): s[suffix(h)] for h in hosts}
    k = strength([(*x, parent[n]) for n, x in d.items()])
    d = {n: shrink(x, k, parent[n]) for n, x in d.items()}
    k = strength([(*x, d[domain(h)]) for h, x in hosts.items()])
    out = []
    for i, (page, _) in enumerate(pages):
        host, path, text, ok = rule[i]
        if ok is None:
            a, b = hosts[host][0] + k * d[domain(host)], hosts[host][1] + k * (1 - d[domain(host)])
            mean = a / (a + b)
            ok = mean + urls.DEVIATIONS * math.sqrt(mean * (1 - mean) / (a + b + 1)) >= 0.5
        out.append((page, host, path, text, "allow" if ok else "block"))
    return sorted(out, key=str)


def judged(df):
    return sorted((tuple(r) for r in urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_urls(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert judged(df) == plain_judge([(r["page_id"], r["url"]) for r in df.collect()])


def test_odd_urls(spark):
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "a://B.ORG"), (5, "a://x.org/p?q#f"), (6, "a://h.com?x=/fr/"), (7, "a://h.com/de/1"), (7, "a://h.com/de/1"), (None, "a://h.com/x"),
             (8, "a://org"), (9, "a://org/"), (10, "x://y://z/"), (11, "a://example.org/es/"), (12, "a://w.co.uk/1\n2"), (13, "a://" + "h." * 3000 + "com/" + "p" * 5000)]
    pages += [(100 + i, f"a://bad.com/{'de/' if i < 40 else 'en/'}{i}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "good", "n", "rule", "prior", "_salt", "html")})
    got = judged(df)
    assert got == plain_judge(pages)
    assert {v for p, _, _, _, v in got if p and p >= 140} == {"block"}, "a host of blocked pages only is not trusted"
    assert judged(df.limit(0)) == []


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def span_text(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


SECRET = "zK9" + hashlib.sha256(b"secret").hexdigest().upper()[:20] + "qX7/vB+9tR2"
TEXTS = [
    f"see {SECRET} here", "password: token: abcdef123", "API_KEY = 'abc' passwd=abcdef", 'é𝒳 "token" : "a.b-c=d/e"', "AKIA" + "A1" * 8, "xAKIAAKIA" + "Z" * 12, "AKIA" + "Z" * 15,
    "f" * 24, "f" * 23 + "F", "token=" + "0123456789abcdef" * 3, "secret=secret=secret=abcdef", "thisIsAnOrdinaryIdentifierWithManyWords and another_ordinary_identifier_name",
    "a " * 20_000 + "password=hunter22" + " b" * 20_000, ("token=abcdefgh " + "0" * 30 + "\n") * 50,
]


def test_secret_scan(spark, documents, odd_documents, no_documents):
    made = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for df in (documents, odd_documents, made, no_documents):
        got = Counter(tuple(r)[:5] for r in secret_scan.scan(df).collect())
        expected = Counter()
        for i, text in texts_of(df):
            spans = plain_spans(text)
            kinds = Counter(k for _, k, _ in spans)
            expected[i, kinds[0], kinds[1], kinds[2], hashlib.sha256(span_text(spans).encode()).hexdigest()] += 1
        assert got == expected


def test_models_add_spans_and_redact(spark):
    model = secret_scan.model_for(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    made = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long").withColumn("base_spans", F.lit(1))
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(made, model).collect()}
    assert spans[0] == f"random:4:{4 + len(SECRET)}" and "random" not in spans[11]
    clean = {r["doc_id"]: r for r in secret_scan.redact(made, model=model).collect()}
    assert clean[0]["text"] == "see [SECRET] here" and clean[0]["n_chars"] == len("see [SECRET] here")
    assert clean[11]["text"] == TEXTS[11] and clean[12]["text"] == "a " * 20_000 + "[SECRET]" + " b" * 20_000
    for i, text in enumerate(TEXTS):
        out, at = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert clean[i]["text"] == out + text[at:]
    assert clean[0].asDict().keys() == {"doc_id", "text", "n_chars", "base_spans"}


def test_ordinary_texts_have_no_random_spans(documents):
    assert not any("random" in r["spans"] for r in secret_scan.scan(documents).collect())


def test_quality(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    for label in (0, 1):
        mine = [r for r in held if r["quality"] == label]
        assert sum(r["predicted"] == label for r in mine) >= 0.97 * len(mine)
    model = quality.train(docs, labels)
    texts = [t for _, t in texts_of(odd_documents)]
    odd = quality.classify(odd_documents, labels.withColumn("score", F.lit("x"))).collect()
    assert len(odd) == len(texts) and all(0 <= r["score"] <= 1 for r in odd) and all(r["held_out"] for r in odd if r["doc_id"] is None)
    assert quality.classify(no_documents, labels).collect() == []
    assert {r["score"] for r in quality.classify(odd_documents, labels.limit(0)).collect()} == {0.5}
    together, counts = quality.features(texts)
    for text, x in zip(texts, np.split(together, np.cumsum(counts)[:-1])):
        assert np.allclose(x, quality.features([text])[0])
    assert np.allclose(model.score(together, counts), [model.score(*quality.features([t]))[0] for t in texts])


def test_attention_gradients():
    rng = np.random.default_rng(2)
    counts, y = np.array([1, 3, 2]), np.array([0.0, 1, 1])
    x = rng.normal(size=(6, 5))
    w = {"encode": rng.normal(size=(5, 4)), "encode0": rng.normal(size=4), "value": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "attend": rng.normal(size=3), "out": rng.normal(size=4), "out0": np.array(0.3)}

    def loss(w):
        p = quality._forward(w, x, counts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradients(w, x, counts, y)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[k][at]) < 1e-6


def test_templates(spark, documents, odd_documents, no_documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    held = {}
    for r in bench.collect():
        w = words(r["text"])
        for k in range(len(w) - 7):
            held.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    expected = set()
    for i, t in texts_of(documents):
        w = words(t)
        expected |= {(i, item) for k in range(len(w) - 7) for item in held.get(tuple(w[k : k + 8]), ())}
    got = templates.contaminated(documents, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected) > 0
    assert templates.contaminated(no_documents, bench).collect() == [] and templates.contaminated(documents, bench.limit(0)).collect() == []
    assert {r["item_id"] for r in templates.contaminated(odd_documents, bench).collect()} == set()


ITEM = "A farmer named Alice sold 12 apples to Bob for 3.50 dollars, then Alice bought 12 pears and gave 7 km of rope to Bob."


@pytest.mark.parametrize("limit", [templates.BROADCAST_WINDOWS, 0])
def test_reparameterised(spark, monkeypatch, limit):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", limit)
    other = ITEM.replace("Alice", "Carol").replace("12", "45").replace("3.50", "9").replace("7", "8")
    torn = ITEM.replace("12 apples", "13 apples").replace("named Alice", "named Dora")
    docs = [(1, f"Intro text. {ITEM} The end."), (2, f"Intro text. {other} The end."), (3, torn), (4, "nothing of it here at all, only words"), (5, None), (None, ITEM), (6, "short item with five"), (7, "Take short item with five words!")]
    bench = [(10, ITEM), (11, "Short item with five words"), (12, "too short"), (13, None), (14, "1 2 3 4 5 6 7 8 9"), (10, ITEM)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("x"), "hash": F.lit(1), "words": F.lit(1)})
    got = {(r["doc_id"], r["item_id"]): (r["n_changed"], r["n_slots"]) for r in templates.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got[1, 10][0] == 0 and got[None, 10][0] == 0
    changed, slots = got[2, 10]
    assert changed == 3 and slots >= changed, "3.50 lies in windows of too many placeholders only"
    # two values for 12 and for Alice: only the windows that hold one of each count
    assert got[7, 11] == (0, 0)
    texts = {i: t for i, t in docs if t}
    expected = {(i, item) for i, t in docs for item, b in bench if plain_matches(t or "", b or "")}
    assert set(got) == expected and {(1, 10), (2, 10), (3, 10), (None, 10), (7, 11)} <= expected and texts[3] == torn
    windows = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in templates.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert all(n == max(plain_matches(dict(docs)[i], dict(bench)[item]).values()) for (i, item), n in windows.items())


def plain_words(text):
    """(template, value) of the words of simple English texts."""
    marked = re.sub(r"(?<=[a-z0-9,])( )(?=[A-Z][a-z])", r"\1@", text)
    out = []
    for w in re.findall(r"@?[A-Za-z0-9]+(?:[.,][0-9]+)*", marked):
        value = w.lstrip("@").lower().replace(",", ".")
        kind = "#" if value[0].isdigit() else "@" if w[0] == "@" else "%" if out and out[-1][0] == "#" and value in templates.UNITS else value
        out.append((kind, value))
    return out


def plain_matches(text, item):
    """Windows of the item found in the text, counted by their offset."""
    doc, want = plain_words(text), plain_words(item)
    width = min(len(want), templates.WINDOW)
    found = Counter()
    if width < templates.SHORTEST:
        return found
    for at in range(len(want) - width + 1):
        w = want[at : at + width]
        slots = [x for x in w if x[0] in "#@%"]
        for place in range(len(doc) - width + 1):
            d = doc[place : place + width]
            same = [x[1] for x in d] == [x[1] for x in w]
            names = {(x, y[1]) for x, y in zip(w, d) if x[0] in "#@%"}
            alike = slots and 2 * len(slots) < width and [x[0] for x in d] == [x[0] for x in w] and len({x for x, _ in names}) == len(names)
            found[place - at] += same or bool(alike)
    return +found


def test_urls_against_sql(spark):
    import duckdb

    from cuadre.llm.queries import CHECKS, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    cursor = con.execute(CHECKS["op2_host_reputation"])
    df = QUERIES["op2_host_reputation"](spark, "/root/testdata/sf0.01")
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(cursor.fetchall(), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
