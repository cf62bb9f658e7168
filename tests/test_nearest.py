"""Nearest vectors against all pairs, with many copies, zeros, tiny parts, and blocks left out."""

import numpy as np
import pytest

from fenestra.operators import nearest


def brute(queries, items, k):
    unit = lambda v: np.array(v) / (np.sqrt(np.dot(v, v)) or 1)
    out = []
    for q, v in queries:
        best = sorted((-round(float(unit(v) @ unit(w)), nearest.DECIMALS), i) for i, w in items if i != q)[:k]
        out += [(q, i, round(-s, 6), n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, k, most, part", [(1, 3, 256, 4096), (2, 7, 8, 20), (3, 1, 1, 5), (4, 500, 9, 4096)])
def test_all_rows_are_met(spark, seed, k, most, part):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 4
    items = [(i, (centres[rng.integers(6)] + rng.normal(size=8) * 0.3).round(3).tolist()) for i in range(300)]
    items += [(1000 + i, items[5][1]) for i in range(30)] + [(2000, [0.0] * 8), (2001, [-x for x in items[5][1]])]
    queries = [x for x in items if x[0] % 20 == 0]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, v array<double>").repartition(3)
    top, _ = nearest.dense_top(make(queries, "q"), make(items, "i"), "q", "i", "v", k, most, part)
    assert sorted((r.q, r.i, round(r.score, 6), r.rank) for r in top.collect()) == brute(queries, items, k)


def test_blocks_are_left_out(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 5
    items = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist()) for i in range(1200)]
    df = spark.createDataFrame(items, "i long, v array<double>")
    _, met = nearest.dense_top(df.where("i % 20 = 0").withColumnRenamed("i", "q"), df, "q", "i", "v", 3)
    share = np.mean([r.met / r.every for r in met.collect()])
    assert share < 0.35  # a twelfth of the rows is in the query's own cluster


def test_nothing(spark):
    none = spark.createDataFrame([], "i long, v array<double>")
    top, met = nearest.dense_top(none.withColumnRenamed("i", "q"), none, "q", "i", "v", 3)
    assert top.collect() == met.collect() == []
