"""Neighbours from the raters of asked items alone, held against the whole graph of users."""

import pytest
from pyspark.sql import functions as F

from affinis.operators import neighbors, raters, similarity
from affinis.plans.queries import QUERIES

RATED = "user_id long, item_id long, rating double"


def test_raters_are_those_of_the_whole_graph(spark, monkeypatch):
    """also with hot items and users, null ratings, repeated rows, unknown users and items, and many small buckets."""
    rows = [(u, i, float((u * i + u) % 5 + 1)) for u in range(40) for i in range(30) if i == 1 or u == 1 or (u * 31 + i * 17) % 5 == 0]
    train = spark.createDataFrame(rows + [(3, 2, None), (4, 1, 2.0), (None, 3, 1.0), (5, None, 1.0), (77, 2, 3.0)], RATED)
    asked = spark.createDataFrame([(u, i) for u in range(0, 40, 3) for i in range(0, 30, 4)] + [(99, 1), (3, 999), (None, 1), (6, 1), (6, 1)], "user_id long, item_id long")

    def told(found):
        return sorted((r.user_id, r.item_id, r.nbr_id, r.sim, round(r.residual, 9)) for r in found.collect())

    want = told(neighbors.user_knn_neighbors(asked, train, similarity.user_similarity(train, 2, 10.0), 1000))
    assert len(want) > 50
    for bucket, at_once in ((1 << 17, 1 << 21), (20, 30)):
        monkeypatch.setattr(raters, "BUCKET", bucket)
        monkeypatch.setattr(raters, "AT_ONCE", at_once)
        assert told(raters.user_knn_neighbors(asked, train, 1000, 2, 10.0)) == want
    few = raters.user_knn_neighbors(asked, train, 3, 2, 10.0).groupBy("user_id", "item_id").count()
    assert few.agg(F.max("count")).first()[0] == 3
    assert raters.user_knn_neighbors(asked, train.limit(0), 3, 2, 10.0).count() == 0


@pytest.mark.parametrize("name", ["user_knn_predict", "user_knn_neighbors", "validate_finite", "rating_metrics_user_knn", "neighbor_counts"])
def test_no_query_of_predictions_makes_the_graph_of_users(spark, name):
    """Pairs of all users are not made."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "kind#" in plan and "nbr_id" in plan and "sent#" in plan
    assert plan.count("FlatMapGroupsInArrow") == 1
