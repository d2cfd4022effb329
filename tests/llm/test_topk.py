import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread"), [(0, 1.0), (1, 0.05), (2, 40.0)])
def test_equals_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(topk, "ANNULUS_ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES_PER_PASS", 5)
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + spread * draw.gauss(0, 1))) for c in draw.choice(centres)]) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # equal vectors: ties
    rows += [(2000, None), (2050, []), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] + [0.0] * 7), (2200, [float("inf")] + [0.0] * 7), (2250, [1.0, 2.0]), (None, rows[0][1]), (2301, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"vector": F.lit("x"), "pivot": F.lit(3), "rank": F.lit(0)})
    assert sorted(tuple(r) for r in topk.top_products(df).collect()) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, -2e6, 1.0]), (1, [3e6, 1.0, 2.0]), (2, [-3e6, 1.0, 2.0]), (3, [2.5e6, 1e6, 0.0])]
    assert sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_products(df).collect()) == brute(rows)
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df.where("vec_id = 0")).count() == 0
    assert topk.top_products(df.union(df)).where("query_id = 0").where("vec_id = 0").count() == 0
