"""Hand-computed cases of each operator."""

import math
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from affinis.functions.columns import clip, discount, dot, logistic, safe_div, shown
from affinis.operators import blocks, candidates, content, ensemble, factors, metrics, neighbors, prepare, similarity, trainers, validate
from affinis.schema import Params
from affinis.sources import ratings as source
from affinis.sources.artifacts import Artifacts, load_results, merge_results, nested_metric

M = [(1, 1, 5.0), (1, 2, 3.0), (1, 3, 1.0), (2, 1, 4.0), (2, 2, 2.0), (2, 4, 3.0), (3, 2, 4.0), (3, 3, 4.0)]
RATED = "user_id long, item_id long, rating double"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(M, RATED)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, item_id long")


def test_means(spark, train):
    assert {r.user_id: r["mean"] for r in prepare.means(train, "user_id", train).collect()} == {1: 3.0, 2: 3.0, 3: 4.0}
    universe = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "item_id long")
    assert {r.item_id: (r["mean"], r.n) for r in prepare.means(train, "item_id", universe).collect()} == {1: (4.5, 2), 2: (3.0, 3), 3: (2.5, 2), 4: (3.0, 1), 9: (3.25, 0)}


def test_item_similarity(train):
    got = {(r.item_id, r.nbr_id): (r.sim, r.support) for r in similarity.item_similarity(train, 2, 10.0).collect()}
    assert set(got) == {(1, 2), (2, 1)}
    assert got[1, 2] == (pytest.approx(-1 / math.sqrt(5) * 2 / 12, abs=1e-9), 2)


def test_user_similarity(train):
    got = {(r.user_id, r.nbr_id): r.sim for r in similarity.user_similarity(train, 2, 10.0).collect()}
    assert got == {(1, 2): pytest.approx(0.1178511302, abs=1e-9), (2, 1): pytest.approx(0.1178511302, abs=1e-9)}
    one = similarity.user_similarity_to(train, train.where("user_id = 1"), 2, 10.0).collect()
    assert [(r.user_id, r.nbr_id, r.n_common) for r in one] == [(1, 2, 2)]


def test_user_neighbours(spark, train):
    asked = pairs(spark, (1, 4), (2, 3), (3, 1))
    sims = similarity.user_similarity(train, 2, 10.0)
    means = prepare.means(train, "user_id", train), prepare.means(train, "item_id", train)
    got = {(r.user_id, r.item_id): (r.prediction, r.n_neighbors) for r in neighbors.weighted(asked, neighbors.user_knn_neighbors(asked, train, sims, 40), *means).collect()}
    assert got == {(1, 4): (3.0, 1), (2, 3): (pytest.approx(1.0), 1), (3, 1): (4.5, 0)}


def test_item_neighbours(spark, train):
    asked = pairs(spark, (3, 1), (2, 3))
    graph = similarity.strongest(similarity.item_similarity(train, 2, 10.0), ["item_id"], "nbr_id", 40)
    means = prepare.means(train, "user_id", train), prepare.means(train, "item_id", train)
    got = {(r.user_id, r.item_id): r.prediction for r in neighbors.weighted(asked, neighbors.item_knn_neighbors(asked, train, graph), *means).collect()}
    assert got == {(3, 1): 4.0, (2, 3): 2.5}


def test_strongest_takes_smaller_neighbours_of_equal_ones(spark):
    edges = spark.createDataFrame([(1, n, 0.5 if n % 2 else -0.5) for n in range(50, 0, -1)] + [(1, 99, 0.9)], "item_id long, nbr_id long, sim double")
    got = sorted(r.nbr_id for r in similarity.strongest(edges, ["item_id"], "nbr_id", 41).collect())
    assert got == [*range(1, 41), 99]


def test_split_and_history(spark):
    rows = [(1, i, 3.0, 10 * i) for i in range(5)] + [(2, i, 3.0, 7) for i in range(5)] + [(3, i, 3.0, i) for i in range(4)]
    kept = prepare.filter_min_history(spark.createDataFrame(rows, RATED + ", ts long"), 5)
    got = {(r.user_id, r.item_id): r.split for r in prepare.chronological_split(kept).collect()}
    for user in (1, 2):  # equal times: the item decides
        assert [got[user, i] for i in range(5)] == ["train"] * 3 + ["validation", "test"]
    assert not any(u == 3 for u, _ in got)


def test_dense_ids(spark):
    ids = [5, 5, -3, 10_000_000_000, 7, 6, *range(100, 900)]
    got = {r.k: r.dense_id for r in prepare.dense_ids(spark.createDataFrame([(i,) for i in ids], "k long"), "k").collect()}
    assert got == {k: n for n, k in enumerate(sorted(set(ids)))}


def test_profiles_of_length_zero(spark):
    train = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 5.0), (2, 2, 1.0)], RATED)
    features = content.normalize(spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (2, "c", 1.0), (3, "z", 0.0)], "item_id long, feature string, x double"), "item_id", "x")
    assert {(r.item_id, r.feature): r.x for r in features.collect()}[3, "z"] == 0.0
    profile = content.profiles(train, features)
    assert all(r.w == 0 for r in profile.where("user_id = 1").collect())
    got = content.likeness(pairs(spark, (1, 1), (2, 1), (2, 3), (9, 1)), profile, features).collect()
    assert {(r.user_id, r.item_id): r.cosine for r in got}[1, 1] == 0.0 and len(got) == 4


@pytest.mark.parametrize(("rows", "beta"), [([(5.0, 3.0, 1.0), (4.0, 3.0, 0.5)], 2.0), ([(1.0, 3.0, 1.0)], 0.0), ([(5.0, 3.0, 0.0)], 0.0)])
def test_scale(spark, rows, beta):
    assert content.scale(spark.createDataFrame(rows, "rating double, mean double, cosine double")).first().beta == pytest.approx(beta)


def test_rating_metrics(spark):
    r = metrics.rating_metrics(spark.createDataFrame([(5.0, 5.5), (3.0, 2.0)], "rating double, prediction double"), 0.5, 5.0).first()
    assert (r.rmse, r.mae, r.bias, r.bounded_mae, r.n_out_of_range, r.out_of_range_pct, r.n_total) == (pytest.approx(math.sqrt(0.625), abs=1e-6), 0.75, -0.25, 0.5, 1, 50.0, 2)


def test_positive_rank_and_ties(spark):
    rows = [(1, 0, False, 2.0), (1, 1, False, 1.0), (1, 2, False, 3.0), (1, 3, True, 2.0), (2, 0, True, 2.0), (2, 1, False, 2.0)]
    got = {r.user_id: r["rank"] for r in metrics.positive_rank(spark.createDataFrame(rows, "user_id long, pos int, is_positive boolean, score double")).collect()}
    assert got == {1: 3, 2: 1}


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 10), (4, 11)], "user_id long, rank int")
    r = metrics.ranking_metrics(ranks, 10, 1000).first()
    assert (r.hit_rate, r.mrr, r.n_evaluated, r.k) == (0.75, 0.4, 4, 10)
    assert r.ndcg == pytest.approx((1 + 1 / math.log2(3) + 1 / math.log2(11)) / 4, abs=1e-6)
    assert r.mrr <= r.ndcg <= r.hit_rate
    assert metrics.ranking_metrics(ranks, 10, 5).first().hit_rate == 0.5


def test_zscore(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 3.0), (2, 7.0), (2, 7.0)]
    got = sorted(r.z for r in ensemble.zscore(spark.createDataFrame(rows, "user_id long, s double"), "s", "z").collect())
    assert got == [pytest.approx(-1.2247449, abs=1e-6), 0.0, 0.0, 0.0, pytest.approx(1.2247449, abs=1e-6)]


def test_weights_of_equal_errors(spark):
    sweep = spark.createDataFrame([(0.3, 1.0), (0.7, 1.0), (0.5, 2.0)], "lam double, rmse double")
    assert ensemble.best_rating_lambda(sweep).first().lam == 0.7
    assert ensemble.best_alpha(sweep.withColumnRenamed("lam", "alpha")).first().alpha == 0.3
    assert ensemble.best_ranking_lambda(sweep.withColumnRenamed("rmse", "ndcg")).first().lam == 0.5


def test_confident_blend(spark):
    rows = spark.createDataFrame([(4.0, 2.0, 0), (4.0, 2.0, 3)], "content double, knn double, n_neighbors int")
    assert [r.prediction for r in ensemble.confident(rows, F.lit(0.25)).collect()] == [4.0, 2.5]


@pytest.mark.parametrize(("rows", "slope", "intercept"), [([(1.0, 2.0), (2.0, 4.0)], 2.0, 0.0), ([(1.0, 4.0), (2.0, 2.0)], 0.0, 3.0), ([(1.0, 4.0), (1.0, 2.0)], 0.0, 3.0)])
def test_affine(spark, rows, slope, intercept):
    r = ensemble.affine(spark.createDataFrame(rows, "score double, rating double")).first()
    assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))


def test_unseen_sides_of_factors(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0], 0.5)], "user_id long, factors array<double>, bias double")
    items = spark.createDataFrame([(1, [3.0, 1.0], -0.25)], "item_id long, factors array<double>, bias double")
    mu = spark.createDataFrame([(3.0,)], "mu double")
    got = {(r.user_id, r.item_id): r.prediction for r in factors.mf_scores(pairs(spark, (1, 1), (1, 9), (9, 1), (9, 9)), users, items, mu).collect()}
    assert got == {(1, 1): 8.25, (1, 9): 3.5, (9, 1): 2.75, (9, 9): 3.0}


def test_users_without_room_are_passed_over(spark):
    train = spark.createDataFrame([(1, i, 4.0) for i in range(6)] + [(2, 0, 4.0), (2, 1, 4.0)], RATED)
    held = spark.createDataFrame([(1, 5, 5.0), (2, 5, 5.0), (2, 77, 5.0), (2, 4, 3.0)], RATED)
    known = candidates.known_items(train.unionByName(held))
    got = candidates.build(held, train, known, 3.5, 10, 3, 1).collect()
    assert {r.user_id for r in got} == {2} and sorted(r.pos for r in got) == [0, 1, 2]
    assert [r.item_id for r in got if r.is_positive] == [5] and {r.item_id for r in got if not r.is_positive} <= {2, 3}
    with pytest.raises(ValueError):
        candidates.build(held, train, known, 3.5, 0, 3, 1)


def test_violations(spark):
    nan = float("nan")
    bad = spark.createDataFrame([(1, 1, 5.5, 1), (-1, 2, 3.0, 1), (2, 3, nan, 1), (2, 4, None, None)], RATED + ", ts long")
    got = {r.check: r.violations for r in validate.ratings(bad, 0.5, 5.0).collect()}
    assert got == {"rating_not_finite": 2, "rating_out_of_range": 3, "user_id_negative": 1, "item_id_negative": 0, "ts_missing": 1, "no_ratings": 0}
    with pytest.raises(ValueError, match="rating_not_finite: 2"):
        validate.require(validate.ratings(bad, 0.5, 5.0))
    assert validate.ratings(bad.where("1 = 0"), 0.5, 5.0).where("check = 'no_ratings'").first().violations == 1
    items = spark.createDataFrame([(1, "x", "a|b"), (2, "y", "a|zz")], "item_id long, title string, genres string")
    assert [(r.feature, r.n) for r in content.unknown_names(items, spark.createDataFrame([("a",), ("b",)], "feature string")).collect()] == [("zz", 1)]
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.5), (2, 0, 7.0)], "item_id long, tag_id int, relevance double")
    assert {r.item_id: (r.n, r.n_tags, r.n_bad) for r in content.completeness(scores).collect()} == {1: (2, 2, 0), 2: (2, 1, 1)}
    assert validate.same_metadata({"a": 1.0, "b": 2, "c": 1}, {"a": 1.0 + 1e-14, "b": 3}) == ["b", "c"]


def test_trainers_learn(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    taste, kind = rng.integers(0, 2, 40), rng.integers(0, 2, 30)
    rows = pd.DataFrame([(u, i, 5.0 if taste[u] == kind[i] else 1.0) for u in range(40) for i in range(30) if rng.random() < 0.5], columns=["user_id", "item_id", "rating"])
    p = Params(factors=8, mf_rate=0.02, bpr_rate=0.05)
    _, losses = trainers.train_mf(rows, 0.02, p, 15)
    assert losses[-1] < 0.7 * losses[0]
    _, right = trainers.train_bpr(rows, 0.0025, p, 15)
    assert right[-1] > 0.75
    again, same = trainers.train_mf(rows, 0.02, p, 15)
    assert same == losses
    grid = trainers.mf_grid(spark.createDataFrame(rows), p, 2)
    assert {r.reg for r in grid.select("reg").distinct().collect()} == set(p.mf_grid)
    errors = {r.reg: r.rmse for r in trainers.mf_errors(grid, spark.createDataFrame(rows)).collect()}
    for reg in p.mf_grid:
        assert errors[reg] == pytest.approx(trainers.train_mf(rows.sort_values(["user_id", "item_id"], kind="stable").reset_index(drop=True), reg, p, 2)[1][-1], abs=1e-6)
    tied = spark.createDataFrame([(0.02, 1.0, 0.5), (0.05, 1.0, 0.5)], "reg double, rmse double, ndcg double")
    assert trainers.best_mf(tied).first().reg == 0.02 and trainers.best_bpr(tied).first().reg == 0.05
    assert trainers.side(grid.where(f"reg = {p.mf_grid[0]}"), "users", "user_id").count() == 40


def test_expressions(spark):
    row = spark.range(1).select(
        safe_div(F.lit(1.0), F.lit(0.0)).alias("a"), clip(F.lit(9.0), 0.5, 5.0).alias("b"), logistic(F.lit(-1000.0)).alias("c"), dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"),
        shown(F.lit(0.1234565)).alias("e"), discount(F.lit(11), 10).alias("f"),
    ).first()
    assert (row.a, row.b, row.d, row.e, row.f) == (0.0, 5.0, 11.0, 0.123457, 0.0) and row.c < 1e-200


def test_readers(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,100\n1,3,4.0,90\n")
    (tmp_path / "items.csv").write_text('movieId,title,genres\n2,"A, B",x|y\n')
    assert [tuple(r) for r in source.read_ratings(spark, str(tmp_path / "ratings.csv")).collect()] == [(1, 2, 3.5, 100), (1, 3, 4.0, 90)]
    assert source.read_items(spark, str(tmp_path / "items.csv")).first().title == "A, B"
    with pytest.raises(ValueError, match="header"):
        source.read_tags(spark, str(tmp_path / "items.csv"))
    rows = spark.createDataFrame([(k, 9 - k) for k in range(10)], "src_pos long, x long")
    assert [r.src_pos for r in source.window_of_rows(rows, 2, 3).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        source.window_of_rows(rows, -1, 3)


def test_artifacts(spark, tmp_path):
    store = Artifacts(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "user_id long, split string")
    assert store.read("interactions") is None and store.read_meta("meta") is None
    store.write("interactions", rows, "split")
    assert store.read("interactions").where("split = 'test'").first().user_id == 2
    store.write_stage("predictions", "mf", rows)
    assert store.read_stage("predictions", "mf").count() == 2 and store.read_stage("predictions", "bpr") is None
    store.write_meta("meta", {"a": 1.5})
    assert store.read_meta("meta") == {"a": 1.5}
    model = spark.createDataFrame([("users", 1, 0.0, [1.0], True)], "side string, id long, bias double, factors array<double>, seen boolean")
    store.write_factors("mf", model, 1, 2)
    assert store.read_factors("mf", 1, 2).count() == 1 and store.read_factors("mf", 9, 2) is None
    parts = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0)], "part int, stage string, rmse double")
    assert {r.stage: r.rmse for r in merge_results(parts).collect()} == {"a": 2.0, "b": 3.0}


def test_blocks_learn(spark):
    """Users of two tastes; blocks of 300 triples, so that items are shared by several, against the trainer of one task."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = [(u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(60) for i in range(30) if rng.random() < 0.5]
    odd = [(100, i, 4.0) for i in range(30)] + [(101, 0, 1.0), (102, None, 5.0), (None, 3, 5.0), (103, 4, None)]
    p = Params(factors=8, bpr_rate=0.05, bpr_grid=(0.0025, 0.01))
    train = spark.createDataFrame(rows + odd + rows[:10], RATED)
    model = blocks.bpr_blocks(train, p, 8, rows=300).collect()
    assert {r.reg for r in model} == set(p.bpr_grid)
    model = [r for r in model if r.reg == p.bpr_grid[0]]
    users, items = ({r.id: np.array(r.factors) for r in model if r.side == s and r.seen} for s in ("users", "items"))
    assert set(users) == set(range(60)) and set(items) == set(range(30))
    unseen = [r for r in model if r.side == "users" and not r.seen]
    assert {r.id for r in unseen} == {100, 101} and not any(any(r.factors) for r in unseen)
    rated = {x[:2] for x in rows}

    def right(users, items):
        """The share of a user's unrated items of the right taste that are before one of the wrong taste."""
        free = {u: ([users[u] @ items[i] for i in range(30) if (u, i) not in rated and i % 2 == u % 2], [users[u] @ items[i] for i in range(30) if (u, i) not in rated and i % 2 != u % 2]) for u in range(60)}
        return np.mean([a > b for good, bad in free.values() for a in good for b in bad])

    one = trainers.train_bpr(pd.DataFrame(rows, columns=["user_id", "item_id", "rating"]), 0.0025, p, 8)[0]
    alone = right(*(dict(zip(*one[s][::2])) for s in ("users", "items")))
    assert right(users, items) > max(0.8, alone - 0.1)


def test_blocks_of_nothing(spark):
    model = blocks.bpr_blocks(spark.createDataFrame([], RATED), Params(factors=4), 2)
    assert {r.side for r in model.collect()} == {"mu"}


def test_a_block_does_the_published_update():
    """One triple: p += rate (g (qi - qj) - reg p), and so on, from the factors before; the same again for the same seed."""
    import numpy as np
    import pandas as pd

    x, y, z = np.array([1.0, 2.0]), np.array([0.5, 0.0]), np.array([0.0, -1.0])
    triples = pd.DataFrame({"user_id": [7], "item_id": [1], "negative": [9], "d": [1]})
    known = pd.DataFrame({"side": ["users", "items", "items"], "id": [7, 9, 1], "factors": [list(x), list(z), list(y)]})
    got = {(r.side, r.id): r.step for r in blocks.learn(triples, known, 0.1, 0.01, [1]).itertuples()}
    g = 1 / (1 + math.exp(x @ (y - z)))
    assert got["users", 7] == pytest.approx(0.1 * (g * (y - z) - 0.01 * x))
    assert got["items", 1] == pytest.approx(0.1 * (g * x - 0.01 * y))
    assert got["items", 9] == pytest.approx(0.1 * (-g * x - 0.01 * z))


def test_every_positive_has_a_negative(spark):
    """User 1 knows all but one of 30 items, user 2 all but three, user 3 all."""
    rows = [(1, k, 4.0) for k in range(29)] + [(2, k, 4.0) for k in range(27)] + [(3, k, 4.0) for k in range(30)]
    train = spark.createDataFrame(rows, RATED)
    got = candidates.bpr_negatives(train, train, 42).collect()
    assert sorted((r.user_id, r.item_id) for r in got) == [x[:2] for x in rows if x[0] < 3]
    assert {r.negative for r in got if r.user_id == 1} == {29} and {r.negative for r in got if r.user_id == 2} == {27, 28, 29}


@pytest.mark.parametrize("name", ["mf_grid", "bpr_grid", "mf_select", "bpr_select"])
def test_registered_trainers_run_all_epochs(monkeypatch, name):
    from affinis.plans import queries

    class Asked(Exception):
        pass

    def asked(train, p, epochs=None):
        raise Asked(epochs or p.epochs)

    for trainer in ("mf_grid", "bpr_grid", "mf_monitor", "bpr_monitor"):
        monkeypatch.setattr(trainers, trainer, asked)
    monkeypatch.setattr(queries, "Workspace", lambda spark, sf_dir, **options: MagicMock(p=Params()))
    with pytest.raises(Asked, match="20"):
        queries.QUERIES[name](None, "")


def test_results_of_files(spark, tmp_path):
    import json

    def result(name, rmse):
        return {"rating": {"name": name, "rmse": rmse, "ok": True}, "ranking": {"ndcg": 0.5, "bad": float("nan")}}

    assert load_results(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps(result("one", 1.0)))
    (tmp_path / "b.json").write_text(json.dumps({"two": result("two", 2.0), "note": 3}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text("[1]")
    found = load_results(spark, str(tmp_path))
    assert {r.name: r.value for r in nested_metric(found, "rating", "rmse").collect()} == {"one": 1.0, "two": 2.0}
    assert nested_metric(found, "rating", "ok").count() == nested_metric(found, "ranking", "bad").count() == nested_metric(found, "none", "x").count() == 0
    assert [r.name for r in nested_metric(load_results(spark, str(tmp_path / "a.json")), "ranking", "ndcg").collect()] == ["one"]
    (tmp_path / "e.json").write_text(json.dumps({"one": result("one", 3.0)}))
    with pytest.raises(ValueError, match="one"):
        load_results(spark, str(tmp_path))
    (tmp_path / "results.json").write_text(json.dumps({"last": result("last", 4.0)}))
    assert {r.name for r in load_results(spark, str(tmp_path)).collect()} == {"last"}


def test_damaged_folders_are_no_absent_ones(spark, tmp_path):
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        Artifacts(spark, str(tmp_path)).read("table").count()


def test_non_finite_predictions_are_counted(spark):
    rows = spark.createDataFrame([(5.0, 5.0), (3.0, float("nan")), (3.0, None)], "rating double, prediction double")
    assert metrics.rating_metrics(rows, 0.5, 5.0).first().n_non_finite == 2


def test_windowed_means(spark):
    from affinis.streaming.means import windowed_means

    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 4.0), ("2024-01-01 01:10:00", 1, 9.0)], "ts string, user_id long, value double")
    got = windowed_means(rows.withColumn("ts", F.to_timestamp("ts"))).orderBy("start").collect()
    assert [(r.n, r["mean"]) for r in got] == [(2, 3.0), (1, 9.0)]


def test_tradeoffs_need_two_stages(spark):
    from affinis.plans import reports
    from unittest.mock import patch

    rows = spark.createDataFrame([("a", 0, 1.0, 0.5, 10), ("b", 1, 2.0, 0.25, 10)], "stage string, ord int, rmse double, ndcg double, k int")
    for n, left in ((2, 2), (1, 0)):
        some = rows.limit(n)
        with patch.object(reports, "rating", lambda w, s, x=some: x), patch.object(reports, "ranking", lambda w, s, x=some: x):
            assert reports.tradeoff(None, ()).count() == left
    assert reports.common_cutoff(rows).first().k == 10 and reports.common_cutoff(rows.withColumn("k", F.col("ord"))).count() == 0


def test_hot_keys_are_met_in_blocks(spark, monkeypatch):
    """All users know item 1 and user 1 all items: the same sums, and no task with a square of them."""
    rows = [(u, i, float((u * i + u) % 5 + 1)) for u in range(1, 61) for i in range(1, 61) if i == 1 or u == 1 or (u * 31 + i * 17) % 7 == 0]
    train = spark.createDataFrame(rows, RATED)
    asked = train.select("user_id", "item_id").where("user_id % 3 = 0")

    def told():
        stats = [sorted((r.a, r.b, round(r.xy, 9), round(r.xx, 9), r.n) for r in similarity.pair_stats(train, x, y, 1).collect()) for x, y in (("item_id", "user_id"), ("user_id", "item_id"))]
        edges = similarity.user_similarity(train, 2, 10.0)
        some = sorted(map(tuple, similarity.user_similarity_to(train, asked, 2, 10.0).collect()))
        return *stats, some, sorted((r.user_id, r.item_id, r.nbr_id, r.sim) for r in neighbors.user_knn_neighbors(asked, train, edges, 5).collect())

    want = told()
    monkeypatch.setattr(similarity, "HOT_ROWS", 7)
    assert told() == want
    hot = similarity.blocks_of(train.select(F.col("user_id").alias("on")), "on")
    dealt = similarity.dealt(train.select(F.col("item_id").alias("a"), F.col("user_id").alias("on")), "on", hot, "i", "j", "a")
    assert max(r["count"] for r in dealt.groupBy("on", "i", "j").count().collect()) < 25


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_where_they_are_summed(spark, monkeypatch):
    """what is shuffled is a row for each rating, also of ids with very many; sums do not depend on the cuts."""
    rows = [(u, i, float((u * i + u) % 5 + 1)) for u in range(1, 41) for i in range(1, 41) if i == 1 or u == 1 or (u * 31 + i * 17) % 5 == 0]
    train = spark.createDataFrame(rows + [(None, 3, 1.0), (3, None, 1.0)], RATED)
    mean = {u: sum(r for v, _, r in rows if v == u) / sum(v == u for v, _, _ in rows) for u in range(1, 41)}
    want = {}
    for u in range(1, 41):
        # the row without an item counts in its user's mean
        known = sorted((i, r - (mean[u] if u != 3 else (mean[3] * (n := sum(v == 3 for v, _, _ in rows)) + 1) / (n + 1))) for v, i, r in rows if v == u)
        for k, (a, x) in enumerate(known):
            for b, y in known[k + 1 :]:
                w = want.setdefault((a, b), [0, 0, 0, 0])
                want[a, b] = [p + q for p, q in zip(w, (x * y, x * x, y * y, 1))]
    for parts, at_once in ((100_000, 1 << 21), (3, 50), (1, 1)):
        monkeypatch.setattr(similarity, "HOT_PAIRS", parts)
        monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", at_once)
        for least in (1, 2, 4):
            found = similarity.pair_stats(train, "item_id", "user_id", least)
            got = {(r.a, r.b): list(r)[2:] for r in found.collect()}
            assert set(got) == {k for k, v in want.items() if v[3] >= least} and all(got[k] == pytest.approx(want[k]) for k in got)
    assert "Aggregate [a#" not in _plan(found) and "RepartitionByExpression [a#" in _plan(found)


def test_pairs_are_made_once_for_both_orders(train):
    """each order of the pairs does not make them anew."""
    for edges in (similarity.item_similarity(train, 2, 10.0), similarity.user_similarity(train, 2, 10.0)):
        assert _plan(edges).count("MapInArrow") == 1


def test_ranges_of_ids_are_those_of_the_ids_alone(spark):
    """two readings of a plan merge their tasks in different orders, and must cut ids alike."""
    ids = spark.range(300_000).select((F.col("id") * F.col("id") * 7 - 1_000_000_000).alias("k"))
    one, other = (prepare.range_ends(x, "k", 256).first().ends for x in (ids.repartition(3), ids.orderBy(F.desc("k"))))
    assert one == other and 200 <= len(one) <= 256
    sizes = ids.groupBy(F.size(F.filter(F.array(*map(F.lit, one)), lambda x: x < F.col("k")))).count().agg(F.max("count")).first()[0]
    assert sizes < 5 * 300_000 / 256
    got = prepare.dense_ids(ids.repartition(7), "k").agg(F.count("*"), F.countDistinct("dense_id"), F.min("dense_id"), F.max("dense_id")).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999)


def test_triples_are_drawn_once(spark, train):
    """a first draw for each positive, others only where that is taken, and one reading of them for both scores."""
    drawn = candidates.bpr_negatives(train, train, 42)
    assert "explode(sequence(0" not in _plan(drawn) and "taken" in _plan(drawn)
    side = [train.select(k).distinct().select(k, F.array(F.col(k) * 1.0, F.lit(1.0)).alias("factors"), F.lit(0.0).alias("bias")) for k in ("user_id", "item_id")]
    found = factors.triples(spark.createDataFrame([(1, 1, 4), (1, 1, 4), (2, 4, 9)], "user_id long, item_id long, negative long"), *side)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 4, -3.0), (1, 1, 4, -3.0), (2, 4, 9, 9.0)]
    assert _plan(factors.triples(drawn, *side)).count("md5") == _plan(drawn).count("md5")
