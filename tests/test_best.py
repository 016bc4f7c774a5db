"""The best items of the catalogue, without a row for each user and item."""

import pytest

from affinis.operators import best
from affinis.operators import candidates as C
from affinis.operators import factors as M
from affinis.plans.workspace import Workspace

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_best_by_factors_are_those_of_all_scores(spark, at_once):
    """Ties, sides without factors, nulls among them, NaN, and items that users know."""
    vectors = [[0.1 * (k % 5), 0.3, -0.7 * (k % 3)] for k in range(60)]
    vectors[7], vectors[8], vectors[9], vectors[10] = None, [1.0, None, 2.0], [9.0], [float("nan"), 1.0, 1.0]
    items = spark.createDataFrame([(k, v, None if k == 11 else 0.25 * (k % 4)) for k, v in enumerate(vectors)], "item_id long, factors array<double>, bias double").repartition(3)
    users = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 0.5), (2, None, 0.1), (3, [-5.0, 1e-10, 2.0], None)], "user_id long, factors array<double>, bias double")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    known = spark.createDataFrame([(1, k) for k in range(20, 60)] + [(3, 0), (9, 5)], "user_id long, item_id long")
    mu = spark.createDataFrame([(3.3333333333333335,)], "mu double")
    order = C.Window.partitionBy("user_id").orderBy(C.F.desc("prediction"), "item_id")

    def first(rows):
        return sorted(repr(tuple(r)) for r in rows.withColumn("nth", C.F.row_number().over(order)).where("nth <= 6").select("user_id", "nth", "item_id", "prediction").collect())

    want = first(M.mf_scores(C.unobserved(asked, items, known), users, items, mu))
    found = best.best_by_factors(asked, users, items, known, mu, 6, at_once)
    assert first(found) == want and len(want) == 24
    assert found.count() <= 3 * 24  # of a task's items only the best leave it


def test_top_n_makes_no_pairs(spark):
    """No plan joins users with the catalogue, and its rows are those of the general way."""
    w = Workspace(spark, DATA)
    users = w.ranking_users("test")
    got = w.top_n(users, "mf", 10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "LeftAnti" not in plan
    few, best.USERS = best.USERS, 0
    try:
        want = w.top_n(users, "mf", 10)
    finally:
        best.USERS = few
    assert "LeftAnti" in want._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_ratings_are_dealt_by_user_once(spark):
    """The sums of lines and the history of users share one exchange, and lines meet their items before."""
    w = Workspace(spark, DATA)
    executed = w.raw.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(o_custkey") == 1 and "Exchange hashpartitioning(user_id" not in executed


def test_ranking_users_who_know_much(spark):
    """User 1 knows all of the catalogue, user 2 as many items, most of which are not in it, user 3 few."""
    train = spark.createDataFrame([(k,) for k in range(10)], "item_id long")
    known = spark.createDataFrame([(1, k) for k in range(10)] + [(2, k) for k in range(7, 17)] + [(3, 1)], "user_id long, item_id long")
    held = spark.createDataFrame([(1, 1, 5.0), (2, 8, 5.0), (3, 1, 5.0)], "user_id long, item_id long, rating double")
    got = C.ranking_users(held, train, known, 3.5, 10, 6, 1).collect()
    assert sorted(map(tuple, got)) == [(2, 8), (3, 1)]
