"""The bit map before the explode loses no wanted hash, whatever its sign."""

from pyspark.sql import functions as F

from cuadre.llm import templates


def test_hash_map(spark):
    bits = templates.MAP_BITS
    wanted = [0, 1, -1, 63, 64, bits - 1, -(1 << 63), (1 << 63) - 1, 5 + bits, -987654321987]
    table = templates.hash_map(spark.createDataFrame([(h,) for h in wanted + wanted[:3]], "hash long"))
    rows = [(1, wanted + [None, 2, 3, 1234567]), (2, []), (3, None), (4, [None]), (5, [7 + bits * 3, 5])]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id int, h array<long>").select("id", templates.possible(F.col("h"), table).alias("p")).collect()}
    kept = {h % bits for h in wanted}
    for i, hashes in rows:
        want = None if hashes is None else [(at, h) for at, h in enumerate(hashes) if h is not None and h % bits in kept]
        assert (None if got[i] is None else [tuple(p) for p in got[i]]) == want
    assert templates.hash_map(spark.createDataFrame([], "hash long")) == [0] * (bits // 64)
