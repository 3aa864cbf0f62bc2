import random
from collections import Counter

from pyspark.sql import functions as F

from tidelane.llm import shards as S


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = Counter(S.hypergeometric(rng, 12, 18, 10) for _ in range(40000))
    from math import comb

    for k in range(11):
        p = comb(12, k) * comb(18, 10 - k) / comb(30, 10)
        assert abs(drawn[k] / 40000 - p) < 5 * (p / 40000) ** 0.5 + 1e-4
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3
    big = [S.hypergeometric(rng, 10**9, 39 * 10**9, 10**6) for _ in range(200)]
    assert abs(sum(big) / 200 - 25000) < 60


def test_matrix_sums():
    m = S.matrix([7, 0, 100, 1, 33], 8, 3)
    assert [sum(r) for r in m] == [7, 0, 100, 1, 33]
    columns = [sum(c) for c in zip(*m)]
    assert sum(columns) == 141 and max(columns) - min(columns) == 1 and min(map(min, m)) >= 0


def test_shuffle_is_exact_and_uniform(spark):
    df = spark.range(0, 3000, 1, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("row"), F.lit(1).alias("slot"))
    out = S.shuffle_rows(df, shards=7).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    # the order within shards and the shard are unrelated to the input's order
    for value in ("slot", "shard"):
        xs, ys = [r.doc_id for r in out], [getattr(r, value) for r in out]
        mx, my = sum(xs) / 3000, sum(ys) / 3000
        cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
        norm = (sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)) ** 0.5
        assert abs(cov / norm) < 0.08


def test_empty_repeated_and_null_rows(spark):
    kind = "doc_id long, text string"
    assert S.shuffle_rows(spark.createDataFrame([], kind)).count() == 0
    out = S.shuffle_rows(spark.createDataFrame([(None, None)] * 90, kind)).collect()
    assert len(out) == 90 and max(Counter(r.shard for r in out).values()) == 3
