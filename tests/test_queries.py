"""Every query against its SQL on the smallest tables, and properties that hold whatever the data."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from affinis.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).fetchdf()
    key = sorted(want.columns)
    assert sorted(got.columns) == key and len(got) == len(want)
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_partitions_change_nothing(spark):
    name, key = "user_knn_predict", "spark.sql.shuffle.partitions"
    before, was = sorted(map(tuple, QUERIES[name](spark, DATA).collect())), spark.conf.get(key)
    spark.catalog.clearCache()
    spark.conf.set(key, "13")
    try:
        assert sorted(map(tuple, QUERIES[name](spark, DATA).collect())) == before
    finally:
        spark.conf.set(key, was)


def test_bounds(spark):
    for r in QUERIES["item_similarity"](spark, DATA).collect():
        assert abs(r.sim) <= r.support / (r.support + 10) + 1e-9
    per = QUERIES["item_topk_neighbors"](spark, DATA).groupBy("item_id").count().agg({"count": "max"}).first()[0]
    assert per <= 40
    for r in QUERIES["report_ranking"](spark, DATA).collect():
        assert 0 <= r.mrr <= r.ndcg + 1e-6 <= r.hit_rate + 2e-6 <= 1.000002


def test_command_line(spark, tmp_path):
    """A run that trains, a second one that reuses, another configuration that is refused, and what all leave behind."""
    from affinis import cli
    from affinis.plans.workspace import Workspace
    from affinis.sources.artifacts import Artifacts

    out = str(tmp_path / "run")
    cli.main(["--data", DATA, "--out", out, "--stages", "global_mean", "user_knn", "mf", "hybrid"])
    store = Artifacts(spark, out)
    got = {r.stage: r for r in store.read("results_merged").collect()}
    assert sorted(got) == ["global_mean", "hybrid", "mf", "user_knn"] and all(r.n_non_finite == 0 for r in got.values())
    w = Workspace(spark, DATA, catalog=True)
    users, items = w.train.select("user_id").distinct().count(), w.train.select("item_id").distinct().count()
    factors = {r.id: r.factors for r in store.read_factors("mf", users, items).where("side = 'users'").collect()}
    stand_ins = {r.user_id: r.factors for r in w.mf_users.collect()}
    assert set(factors) == set(stand_ins) and all(list(factors[k]) != list(stand_ins[k]) for k in factors)
    counts = store.read_stage("counts", "user_knn")
    assert counts.columns == ["user_id", "item_id", "n_neighbors"] and counts.count() == store.read_stage("predictions", "user_knn").count()
    meta = store.read_meta("meta_hybrid")
    assert 0 <= meta["weights"]["alpha"] <= 1 and meta["seconds"]["predict"] > 0
    seconds = {(r.stage, r.kind): r.seconds for r in store.read("timings").collect()}
    assert seconds["mf", "train"] > 0 and seconds["global_mean", "train"] == 0
    loaded = store.load("interactions", "train_by_user", "train_by_item", "features_genre", "features_dense", "profiles_genre", "profiles_dense", "presence_user", "presence_item", "components_hybrid", "metadata")
    assert loaded["train_by_user"].count() == loaded["train_by_item"].count() == w.train.count() and loaded["metadata"].first().n_users == users
    assert store.load_candidates("test").count() == w.candidates("test").count()
    with pytest.raises(ValueError, match="split"):
        store.load_candidates("train")
    with pytest.raises(FileNotFoundError, match="nothing"):
        store.load("metadata", "nothing")
    before = store.read_meta("meta_mf")
    cli.main(["--data", DATA, "--out", out, "--stages", "mf"])
    assert store.read_meta("meta_mf") == before
    with pytest.raises(ValueError, match="candidates"):
        cli.main(["--data", DATA, "--out", out, "--stages", "global_mean", "--full-size"])
    cli.main(["--data", DATA, "--out", out, "--merge"])
    assert store.read("results_merged").count() == 4


def test_run_on_csv_files(spark, tmp_path):
    from affinis import cli
    from affinis.sources.artifacts import Artifacts

    data = tmp_path / "csv"
    data.mkdir()
    ratings = [(u, i, 1 + u % 5 / 2 + i % 5 / 2, 100 * (i * 37 % 131) + u) for u in range(1, 41) for i in range(1, 131) if (u * 7 + i * 11) % 4]
    (data / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{r},{t}\n" for u, i, r, t in ratings))
    (data / "movies.csv").write_text("movieId,title,genres\n" + "".join(f'{i},"Film, the {i}th",{"A|B" if i % 2 else "C"}\n' for i in range(1, 141)))
    (data / "genome-tags.csv").write_text("tagId,tag\n7,dark\n3,light\n")
    (data / "genome-scores.csv").write_text("movieId,tagId,relevance\n" + "".join(f"{i},{t},{(i * t) % 10 / 10}\n" for i in range(1, 131) for t in (3, 7)))
    cli.main(["--data", str(data), "--csv", "--out", str(tmp_path / "out"), "--stages", "global_mean", "genome_content", "mf"])
    store = Artifacts(spark, str(tmp_path / "out"))
    got = {r.stage: r.rmse for r in store.read("results_merged").collect()}
    assert len(got) == 3 and got["mf"] < 0.8 * got["global_mean"]  # users and items differ by their biases, which the factors' model learns
    vectors = {r.item_id: r.vector for r in store.read("features_dense").collect()}
    assert vectors[4] == [0.8, 0.2]  # in the order of the tags' file, 7 before 3
