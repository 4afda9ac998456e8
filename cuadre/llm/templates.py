"""Benchmark decontamination by canonical templates (operator 10), in DataFrame functions only.

Words lose case and punctuation; all windows of ``WINDOW`` plain words of the benchmark are looked for.
Besides, numbers, units after numbers and names become typed placeholders.
Windows of ``WINDOW`` template words of the benchmark and of the documents meet in a hash join; a
match counts only if, within the window, every benchmark value of a placeholder stands for one value
of the document; windows are counted along alignments. So a question is also found with other numbers and names in it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from cuadre.llm.common import whole_text, written

#: Template words in a window; a shorter item is one window of its whole length, from SHORTEST on.
WINDOW, SHORTEST = 8, 5
#: Benchmark windows up to this number are broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Bits of the map of benchmark hashes that document hashes are tested against before they become rows.
MAP_BITS = 1 << 21

#: Marks of names, numbers and units: private-use characters before the value (fixed values).
NAME, NUMBER, UNIT = "", "", ""
POINT = "·"
#: Fixed values.
UNITS = (
    "km", "cm", "mm", "m", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years",
    "mph", "kmh", "miles", "meters", "feet", "inches", "percent", "dollars", "euros", "cents", "usd", "eur",
)


def tokens(text: Column) -> Column:
    """Lower-case words; names, numbers and units carry their mark before the value.

    A name is a capitalised word after a word or comma, white space and quotes, not at the start of a sentence.
    """
    marked = text
    for mark in (NAME, NUMBER, UNIT):
        marked = F.replace(marked, F.lit(mark), F.lit(" "))
    marked = F.regexp_replace(marked, r"(?<=[\p{Ll}\p{N},])(\s[\s\"'(\p{Pi}]*)(?=\p{Lu}\p{Ll})", f"$1{NAME}")
    marked = F.regexp_replace(marked, r"(\p{N})[.,](?=\p{N})", f"$1{POINT}")
    marked = F.regexp_replace(marked, rf"\p{{N}}[\p{{N}}{POINT}]*", f"{NUMBER}$0")
    marked = F.regexp_replace(marked, rf"({NUMBER}[^\s]*?)\s*((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    return F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}{POINT}]+"), "")


def is_slot(word: Column) -> Column:
    return (word >= NAME) & (word < chr(ord(UNIT) + 1))


def template(words: Column) -> Column:
    """The words with placeholders instead of marked values."""
    return F.transform(words, lambda w: F.when(is_slot(w), F.left(w, F.lit(1))).otherwise(w))


def value(word: Column) -> Column:
    """The word without its mark."""
    return F.when(is_slot(word), F.substring(word, 2, 1 << 30)).otherwise(word)


def with_windows(df: DataFrame, canonical: str, width: int, out: str) -> DataFrame:
    """Adds the hashes of all windows of ``width`` words, in order.

    Hashes of windows are made from hashes of shorter ones, a column for each doubling. They are
    exploded as outer: else the optimizer derives a filter that computes them again.
    """
    df = df.withColumn(out, F.transform(canonical, lambda w: F.xxhash64(w)))
    size = 1
    while size < width:
        step = min(size, width - size)
        n = F.greatest(F.size(out) - step, F.lit(0))
        df = df.withColumn(out, F.zip_with(F.slice(out, 1, n), F.slice(out, 1 + step, n), lambda a, b: F.xxhash64(a, b)))
        size += step
    return df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """width, hash, item_id, at, item_words: each window by its plain words, and by its template too if it
    has placeholders, but more words than those."""
    items = benchmark.select("item_id", tokens(whole_text()).alias("words")).distinct()
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WINDOW))).filter(F.col("width") >= SHORTEST)
    items = items.withColumn("canonical", template(F.col("words"))).withColumn("plain", F.transform("words", value))
    out = None
    for width in range(SHORTEST, WINDOW + 1):
        for shape in ("plain", "canonical"):
            cut = with_windows(items.filter(F.col("width") == width), shape, width, "hashes")
            cut = cut.select("item_id", "width", "words", F.posexplode_outer("hashes").alias("at", "hash"))
            cut = cut.select("width", "hash", "item_id", "at", F.slice("words", F.col("at") + 1, width).alias("item_words"))
            if shape == "canonical":
                slots = F.size(F.filter("item_words", is_slot))
                cut = cut.filter((slots > 0) & (2 * slots < F.col("width")))
            out = cut if out is None else out.union(cut)
    return out.filter("hash IS NOT NULL")


def hash_map(wanted: DataFrame) -> list[int]:
    """``MAP_BITS`` bits, 64 to a word, one set for each ``hash`` of ``wanted``; the driver gets no more than these words."""
    bit = F.col("hash").bitwiseAND(F.lit(MAP_BITS - 1))
    words = wanted.select(F.shiftrightunsigned(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    bits = [0] * (MAP_BITS // 64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[row["word"]] = row["bits"]
    return bits


def possible(hashes: Column, bits: list[int]) -> Column:
    """(place, hash) of the hashes whose bit is set. No hash of the map is lost; the join decides about the others."""
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def place_of(h: Column, i: Column) -> Column:
        bit = h.bitwiseAND(F.lit(MAP_BITS - 1))
        return F.when(F.getbit(F.get(table, F.shiftrightunsigned(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1, i)

    places = F.array_compact(F.transform(hashes, place_of))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.get(hashes, i).alias("hash")))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document and benchmark item found in it: ``key``, item_id, n_windows, n_slots, n_changed.

    ``docs`` has ``key`` and ``text``, ``benchmark`` has ``item_id`` and ``text`` (null: empty); other
    columns are ignored. Rows with equal keys count as one document, a null key is a key. ``n_windows``:
    matching windows of the best alignment; ``n_slots``: placeholders in it with different benchmark
    values; ``n_changed``: how many of them have another value in the document, at one place at least (0: verbatim but for
    case and punctuation). Items of fewer than ``SHORTEST`` words are not looked for. An empty table
    on either side gives no rows.
    """
    wanted = written(benchmark_windows(benchmark), "benchmark-windows")
    widths = {r["width"]: r["n"] for r in wanted.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(widths.values()) <= BROADCAST_WINDOWS
    bits = hash_map(wanted)
    words = docs.select(F.col(key).alias("key"), tokens(whole_text()).alias("words"))
    marked = F.exists("words", is_slot)
    shaped = words.withColumn("plain", F.when(marked, F.transform("words", value)).otherwise(F.col("words")))
    shaped = shaped.withColumn("canonical", F.when(marked, template(F.col("words"))).otherwise(F.array().cast("array<string>")))
    matches = None
    for width in sorted(widths) or [WINDOW]:
        both = with_windows(with_windows(shaped, "plain", width, "hashes"), "canonical", width, "templates")
        # a template's hash is looked up where it is not the plain words' one
        others = F.zip_with("templates", "hashes", lambda t, h: F.when(t != h, t))
        n = F.size("hashes")
        looked = F.when(F.size("templates") > 0, F.concat("hashes", others)).otherwise(F.col("hashes"))
        both = both.select("key", "words", n.alias("n"), looked.alias("looked"))
        placed = both.select("key", "words", "n", F.explode_outer(possible(F.col("looked"), bits)).alias("p")).select("key", "words", "n", "p.*")
        placed = placed.withColumn("place", F.when(F.col("place") < F.col("n"), F.col("place")).otherwise(F.col("place") - F.col("n"))).drop("n")
        if not small:  # the words of a window travel instead of the document's
            placed = placed.withColumn("words", F.slice("words", F.col("place") + 1, width)).withColumn("from", F.lit(1))
        else:
            placed = placed.withColumn("from", F.col("place") + 1)
        items = wanted.filter(F.col("width") == width).drop("width")
        met = placed.join(F.broadcast(items) if small else items, "hash")
        mine = F.slice("words", F.col("from"), width)
        pairs = F.zip_with(mine, "item_words", lambda d, i: F.struct(i.alias("item"), d.alias("doc")))
        found = met.select("key", "item_id", (F.col("place") - F.col("at")).alias("offset"), "at", pairs.alias("pairs"))
        matches = found if matches is None else matches.union(found)
    # Whether the words agree is looked at after the aggregation: a lambda function in the join would
    # keep the join out of the generated code, and every exploded row would copy the document's words.
    met = matches.groupBy("key", "item_id", "offset").agg(F.collect_set(F.struct("at", "pairs")).alias("met"))
    # equal hashes are checked: all words agree but for the marks, or else unmarked words agree and marked ones have the same mark
    agrees = lambda p: F.when(is_slot(p["item"]), F.left(p["item"], F.lit(1)) == F.left(p["doc"], F.lit(1))).otherwise(p["item"] == p["doc"])
    same = lambda p: value(p["item"]) == value(p["doc"])
    # in a window, every benchmark value of a placeholder must stand for one value of the document; a slip
    # elsewhere in the alignment does not undo a window
    slot = lambda p: F.struct(p["item"].alias("item"), value(p["doc"]).alias("doc"))
    slots_of = lambda pairs: F.array_distinct(F.transform(F.filter(pairs, lambda p: is_slot(p["item"])), slot))
    one_value = lambda pairs: F.size(slots_of(pairs)) == F.size(F.array_distinct(slots_of(pairs)["item"]))
    counts = lambda m: F.forall(m["pairs"], same) | (F.forall(m["pairs"], agrees) & one_value(m["pairs"]))
    real = met.select("key", "item_id", F.filter("met", counts).alias("met")).filter(F.size("met") > 0)
    slots = F.array_distinct(F.flatten(F.transform("met", lambda m: slots_of(m["pairs"]))))
    aligned = real.select("key", "item_id", F.size(F.array_distinct("met.at")).alias("n_windows"), slots.alias("slots"))
    values = F.size(F.array_distinct("slots.item"))
    changed = F.size(F.array_distinct(F.filter("slots", lambda p: value(p["item"]) != p["doc"])["item"]))
    best = aligned.select("key", "item_id", "n_windows", values.alias("n_slots"), changed.alias("n_changed"))
    rank = F.struct(F.col("n_windows"), (-F.col("n_changed")).alias("unchanged"), F.col("n_slots"))
    top = best.groupBy("key", "item_id").agg(F.max(rank).alias("b"))
    return top.select(F.col("key").alias(key), "item_id", F.col("b.n_windows").alias("n_windows"), F.col("b.n_slots").alias("n_slots"), (-F.col("b.unchanged")).alias("n_changed"))
