"""Every query outside the language-model subpackage against its SQL, on the smallest tables."""

import pytest

from seriesforge.plans import registry
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], DATA)


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "point", "x", "y"]
    assert df.count() > 0


def test_principal_components_equal_a_decomposition(spark):
    """Up to their signs, the components of the centred vectors."""
    import numpy as np

    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x = np.array([vectors[i] for i in sorted(vectors)], float)
    x -= x.mean(axis=0)
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:2].T
    rows = {r.vec_id: (r.pc1, r.pc2) for r in registry.queries()["pca_2d"](spark, DATA).collect()}
    got = np.array([rows[i] for i in sorted(vectors)])
    for k in (0, 1):
        sign = np.sign((got[:, k] * want[:, k]).sum())
        assert np.allclose(got[:, k] * sign, want[:, k], atol=1e-5)


def test_forest_queries_predict_every_row_within_the_range_of_the_targets(spark):
    rows = registry.queries()["forest_multi_output"](spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert len(rows) == e.where("vec_id % 5 = 0").count() and not rows.isna().any().any()
    for i in range(4):
        assert rows[f"t{i}_predicted"].between(-10, 10).all() and rows[f"t{i}_predicted"].std() > 0
    one = registry.queries()["forest_regressor"](spark, DATA).toPandas()
    assert one.label_predicted.between(0, e.agg({"label": "max"}).first()[0]).all()


def test_forest_has_the_trees_of_the_reference(spark, monkeypatch):
    from seriesforge.operators import metrics

    seen, grown = [], metrics.grown
    monkeypatch.setattr(metrics, "grown", lambda *a, **b: seen.append(out := grown(*a, **b)) or out)
    registry.queries()["forest_regressor"](spark, DATA)
    assert [len(f.feature) for f in seen] == [100]
