"""Forests against a plain tree, and on planted data."""

import numpy as np
import pytest

from seriesforge.operators import forest, metrics


def table_of(spark, x, y):
    schema = "id long, v array<double>, " + ", ".join(f"t{k} double" for k in range(y.shape[1]))
    return spark.createDataFrame([(i, list(map(float, a)), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))], schema)


def plain_tree(x, y, cuts, depth, least):
    """The same tree by recursion over rows: {node: (feature, bin)}, {leaf: mean}."""
    inner, leaves = {}, {}

    def grow(node, rows, left):
        best = (1e-9, None, None)
        total = (y[rows].sum(axis=0) ** 2).sum() / len(rows)
        for f, c in enumerate(cuts):
            b = np.searchsorted(c, x[rows, f], side="left")
            for j in range(31):
                lo, hi = rows[b <= j], rows[b > j]
                if len(lo) >= least and len(hi) >= least:
                    gain = (y[lo].sum(axis=0) ** 2).sum() / len(lo) + (y[hi].sum(axis=0) ** 2).sum() / len(hi) - total
                    if round(gain, 9) > round(best[0], 9):
                        best = (gain, f, j)
        if not left or best[1] is None:
            leaves[node] = y[rows].mean(axis=0)
            return
        _, f, j = best
        inner[node] = f, j
        b = np.searchsorted(cuts[f], x[rows, f], side="left")
        grow(2 * node, rows[b <= j], left - 1)
        grow(2 * node + 1, rows[b > j], left - 1)

    grow(1, np.arange(len(x)), depth)
    return inner, leaves


@pytest.mark.parametrize("most", [64 << 20, 1])
def test_one_tree_equals_a_plain_tree(spark, monkeypatch, most):
    monkeypatch.setattr(forest, "MOST_BYTES", most)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (150, 4)).astype(float), rng.normal(0, 1, (150, 3))
    y[:, 0] += 3 * (x[:, 1] > 5)
    df = table_of(spark, x, y).repartition(4)
    f = forest.grown(df, "v", ["t0", "t1", "t2"], trees=1, depth=4, least=5.0, bag=False)
    inner, leaves = plain_tree(x, y, f.cuts, 4, 5)
    assert {int(n): (int(f.feature[0, n]), int(f.bin[0, n])) for n in np.flatnonzero(f.feature[0] >= 0)} == inner
    got = f.predicted(x)
    at = f.nodes(0, f.binned(x), 4)
    assert np.allclose(got, np.array([leaves[int(n)] for n in at]))


def test_planted_data_is_learned_for_all_outputs(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (900, 6))
    y = np.stack([3 * x[:, 0] + (x[:, 1] > 0), np.where(x[:, 2] > 0.2, 2.0, -1.0), rng.normal(0, 1, 900)], axis=1)
    df = table_of(spark, x, y)
    out = metrics.forest_predictions(df.where("id < 700"), df.where("id >= 700"), "v", ["t0", "t1", "t2"], trees=20).toPandas()
    r2 = [1 - ((out[f"t{k}"] - out[f"t{k}_predicted"]) ** 2).sum() / ((out[f"t{k}"] - out[f"t{k}"].mean()) ** 2).sum() for k in range(3)]
    assert r2[0] > 0.8 and r2[1] > 0.9 and r2[2] < 0.2


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, None, 2.0), (2, [1.0, None], 3.0), (3, [2.0, 1.0], None), (4, [5.0, 5.0], 9.0), (4, [5.0, 5.0], 9.0)], "id long, v array<double>, t0 double")
    f = forest.grown(df, "v", ["t0"], trees=2, depth=2, bag=False)
    out = {r.id: r.t0_predicted for r in forest.predictions(df, "v", ["t0"], f).collect()}
    assert out == {0: 1.0, 1: None, 2: None, 3: pytest.approx(out[3]), 4: 9.0}
    empty = forest.grown(df.limit(0), "v", ["t0"], trees=2)
    assert [r.t0_predicted for r in forest.predictions(df, "v", ["t0"], empty).collect()] == [None] * 6


def test_bootstrap_weights_average_one():
    h = np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64)
    a, b = forest.weights(h, 0, 42), forest.weights(h, 1, 42)
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.05 and abs(np.corrcoef(a, b)[0, 1]) < 0.02
