"""Approximate nearest neighbours by shifted space-filling curves (operator 7).

Vectors are projected by several random rotations, shifted, and put in order along a Hilbert curve
each time; Spark sorts every order by ranges. A query looks at the window around its own place on
every curve; the windows are merged and ranked by exact distance. The width of the window is the one
with which a bounded sample of queries finds its true neighbours.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cuadre.llm.common import salted_lookup, written

CURVES, AXES, LEVELS = 4, 7, 8
#: Queries by which the width is set, the share of their neighbours it must reach, least width.
SAMPLE, RECALL, LEAST = 200, 0.96, 256
#: Vectors in a block of a curve, and queries that one task compares with a block.
BLOCK, QUERIES = 2048, 2048


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows) with ``levels`` bits an axis.

    Axes are transformed bit by bit, exchanging and inverting lower bits, and Gray-decoded.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (levels - 1)
    while bit > 1:
        turn ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def rotations(dimensions: int, curves: int = CURVES, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """An orthonormal projection and a shift for each curve."""
    rng = np.random.default_rng(seed)
    axes = min(AXES, dimensions)
    return [(np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0][:, :axes], rng.random(axes)) for _ in range(curves)]


def curve_keys(x: np.ndarray, mean: np.ndarray, scale: float, curves: list) -> list[np.ndarray]:
    out = []
    for turn, shift in curves:
        even = 1 / (1 + np.exp(-1.7 * np.clip((x - mean) @ turn / scale, -15, 15)))
        out.append(hilbert(np.minimum((even + shift) / 2 * (1 << LEVELS), (1 << LEVELS) - 1).astype(np.int64)))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(queries: np.ndarray, x: np.ndarray, reps: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the places of the ``k`` nearest allowed rows, ties to the smaller rep, and their distances."""
    norms = (x**2).sum(axis=1)
    for a in range(0, len(queries), 512):
        part = queries[a : a + 512]
        near = (part**2).sum(axis=1)[:, None] + norms - 2 * part @ x.T
        if allowed is not None:
            near[~allowed[a : a + 512]] = np.inf
        # the product is a little off: whatever is as near as the k-th, give or take, is measured again
        edge = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        for i in range(len(part)):
            limit = edge[i] + 1e-9 * (norms.max() + (part[i] ** 2).sum())
            at = np.flatnonzero((near[i] <= limit) & np.isfinite(near[i]))
            exact = np.sqrt(((x[at] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((reps[at], exact))[:k]
            yield a + i, at[order], exact[order]


def usable(embeddings: DataFrame) -> DataFrame:
    """One vector for each vec_id (the smallest, should there be several), without null, zero and non-finite ones.

    Vectors whose length is not the most frequent one take no part either, nor do null ids.
    """
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL").filter(good).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    sizes = [(r["n"], r["size"]) for r in rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return rows.filter(F.size("embedding") == (max(sizes)[1] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(embeddings: DataFrame, is_query=None, k: int = 10) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score.

    ``embeddings`` has ``vec_id`` and ``embedding``; other columns are ignored. Queries are the rows
    for which ``is_query`` holds (default: vec_id divisible by 100); a query's own row is no candidate.
    ``score`` is the Euclidean distance in double precision, ties go to the smaller vec_id. Equal
    vectors are one place on the curves, with the ids that can be among the ``k``. Which vectors take
    part: ``usable``. Fewer candidates give fewer rows, an empty table none.
    """
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    rows = written(usable(embeddings), "vectors")
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("n", first).filter(F.col("n") <= k + 1)
    classes = written(few.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    total, dimensions = classes.count(), classes.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sums = classes.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("s")).collect()
    mean = np.array([r["m"] for r in sorted(sums)])
    scale = float(np.sqrt(max(np.mean([r["s"] - r["m"] ** 2 for r in sums]), 1e-12)))
    curves = rotations(dimensions)

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                for c, key in enumerate(curve_keys(_matrix(frame["embedding"]), mean, scale, curves)):
                    yield pd.DataFrame({"curve": np.int32(c), "key": key, "rep": frame["rep"], "embedding": frame["embedding"]})

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for frame in frames:
            inside = np.empty(len(frame), np.int64)
            curve = frame["curve"].to_numpy()
            for c in np.unique(curve).tolist():
                at = np.flatnonzero(curve == c)
                inside[at] = seen[c] + np.arange(len(at))
                seen[c] += len(at)
            yield frame.drop(columns="key").assign(part=np.int32(part), inside=inside)

    keyed = written(classes.select("rep", "embedding").mapInPandas(keys, "curve int, key long, rep long, embedding array<double>"), "curve-keys")
    ordered = keyed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    placed = written(ordered.mapInPandas(places, "curve int, rep long, embedding array<double>, part int, inside long"), "curve-places")
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = written(placed.join(counts.select("curve", "part", before.alias("before")), ["curve", "part"]).select("curve", (F.col("before") + F.col("inside")).alias("place"), "rep", "embedding"), "curve-index")

    asked = written(rows.filter(is_query).select(F.col("vec_id").alias("query"), "embedding").join(classes.select("embedding", "rep"), "embedding"), "queries")
    n_queries = asked.count()
    width = window_width(index, classes, asked, k)
    chunks = max(1, -(-n_queries * min(1, (2 * width + BLOCK) / total) // QUERIES))
    chunk = F.pmod(F.hash("query"), F.lit(int(chunks)))
    at = salted_lookup(asked.select("query", "rep", F.col("embedding").alias("q")), index.groupBy("rep").agg(F.collect_list(F.struct("curve", "place")).alias("at")), "rep", F.hash("query"))
    windows = at.select("query", "q", F.explode("at").alias("a")).select("query", "q", "a.curve", (F.col("a.place") - width).alias("low"), (F.col("a.place") + width).alias("high"))
    last = F.lit((total - 1) // BLOCK).cast("long")
    first_block, last_block = F.greatest(F.floor(F.col("low") / BLOCK), F.lit(0)), F.least(F.floor(F.col("high") / BLOCK), last)
    windows = windows.withColumn("block", F.explode(F.sequence(first_block, last_block))).withColumn("chunk", chunk)
    blocks = index.withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(int(chunks) - 1))))

    def rank(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(block):
            x, reps, place = _matrix(block["embedding"]), block["rep"].to_numpy(), block["place"].to_numpy()
            allowed = (place >= mine["low"].to_numpy()[:, None]) & (place <= mine["high"].to_numpy()[:, None])
            query = mine["query"].to_numpy()
            for i, found, distance in nearest(_matrix(mine["q"]), x, reps, k + 1, allowed):
                out.append(pd.DataFrame({"query": query[i], "rep": reps[found], "distance": distance}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "rep": [], "distance": []}).astype({"query": "int64", "rep": "int64"})

    found = windows.groupBy("curve", "block", "chunk").cogroup(blocks.groupBy("curve", "block", "chunk")).applyInPandas(rank, "query long, rep long, distance double")
    merged = found.groupBy("query", "rep").agg(F.min("distance").alias("distance"))
    near = F.row_number().over(Window.partitionBy("query").orderBy("distance", "rep"))
    best = merged.withColumn("n", near).filter(F.col("n") <= k + 1)
    ids = salted_lookup(best, classes.select("rep", "ids"), "rep", F.hash("query")).select("query", "distance", F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    result = ids.filter("vec_id <> query").withColumn("rank", order).filter(F.col("rank") <= k)
    return result.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))


def window_width(index: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> int:
    """Half width of the windows with which ``SAMPLE`` queries reach ``RECALL`` of their true neighbours.

    The sample is compared with every vector, in blocks; the driver sees its neighbours' places only.
    """
    sample = asked.orderBy(F.hash("query"), "query").limit(SAMPLE).toPandas().drop_duplicates("rep")
    if not len(sample):
        return LEAST
    q, own = _matrix(sample["embedding"]), sample["rep"].to_numpy()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                reps = frame["rep"].to_numpy()
                for i, found, distance in nearest(q, _matrix(frame["embedding"]), reps, k + 1):
                    yield pd.DataFrame({"own": own[i], "rep": reps[found], "distance": distance})

    near = F.row_number().over(Window.partitionBy("own").orderBy("distance", "rep"))
    true = classes.select("rep", "embedding").mapInPandas(compare, "own long, rep long, distance double").withColumn("n", near).filter(F.col("n") <= k + 1).toPandas()
    true = true[true["own"] != true["rep"]]
    if not len(true):
        return LEAST
    wanted = sorted({*true["own"].tolist(), *true["rep"].tolist()})
    places = index.filter(F.col("rep").isin(wanted)).select("curve", "rep", "place").toPandas().pivot(index="rep", columns="curve", values="place")
    apart = np.abs(places.loc[true["rep"]].to_numpy() - places.loc[true["own"]].to_numpy()).min(axis=1)
    return max(LEAST, int(np.quantile(apart, RECALL, method="higher")) + 1)
