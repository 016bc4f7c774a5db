"""The registered queries, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import dot, shown, steady
from affinis.operators import candidates as C
from affinis.operators import content, ensemble, factors, prepare, similarity, trainers, validate
from affinis.plans import oracle as O
from affinis.plans import reports
from affinis.plans import stages as S
from affinis.plans.workspace import Workspace
from affinis.schema import STAGES
from affinis.sources import ratings as source
from affinis.sources.artifacts import merge_results as merge
from affinis.streaming import means as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None, plan: Callable[[Workspace], DataFrame], changed: dict[str, str] | None = None, **options) -> None:
    """A query over a workspace of its own, and its SQL if it has one."""
    QUERIES[name] = lambda spark, sf_dir: plan(Workspace(spark, sf_dir, **options))
    if sql is not None:
        SQL[name] = O.build(sql, changed)



ROUND = O.sh

# sources and checks
register("scan_ratings", "SELECT user_id, item_id, rating, ts FROM t_raw", lambda w: w.raw)
register("scan_noise_ratings", "SELECT user_id, item_id, rating, ts FROM t_noise", lambda w: w.raw, noise=True)
register(
    "scan_offset_limit",
    "SELECT user_id, item_id, rating FROM t_raw ORDER BY user_id * 1000000 + item_id LIMIT 500 OFFSET 1000",
    lambda w: source.window_of_rows(w.raw.withColumn("src_pos", F.col("user_id") * 1000000 + F.col("item_id")), 1000, 500).select("user_id", "item_id", "rating"),
)
register(
    "validate_ratings",
    """SELECT unnest([struct_pack("check" := 'rating_not_finite', violations := a), struct_pack("check" := 'rating_out_of_range', violations := b), struct_pack("check" := 'user_id_negative', violations := c),
  struct_pack("check" := 'item_id_negative', violations := d), struct_pack("check" := 'ts_missing', violations := e), struct_pack("check" := 'no_ratings', violations := f)], recursive := true)
FROM (SELECT count(*) FILTER (WHERE rating IS NULL OR NOT isfinite(rating)) AS a, count(*) FILTER (WHERE rating IS NULL OR rating NOT BETWEEN 0.5 AND 5) AS b, count(*) FILTER (WHERE user_id < 0) AS c,
  count(*) FILTER (WHERE item_id < 0) AS d, count(*) FILTER (WHERE ts IS NULL) AS e, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS f FROM t_raw)""",
    lambda w: validate.ratings(w.raw, w.p.low, w.p.high),
)
register(
    "validate_finite",
    "SELECT 'prediction_not_finite' AS \"check\", count(*) FILTER (WHERE prediction IS NULL OR NOT isfinite(prediction)) AS violations FROM t_uknn JOIN t_test USING (user_id, item_id)",
    lambda w: validate.count_bad(w.predictions("user_knn"), {"prediction_not_finite": ~validate.finite(F.col("prediction"))}),
)
register("duplicate_pairs", "SELECT o_custkey AS user_id, l_partkey AS item_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) > 1", lambda w: validate.duplicate_pairs(source._bought(w.spark, w.sf_dir).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))))
register(
    "validate_candidates",
    """SELECT 'candidates_repeated' AS "check", count(*) FILTER (WHERE n <> d) AS violations FROM (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d FROM t_cand GROUP BY user_id)
UNION ALL SELECT 'not_one_positive', count(*) FILTER (WHERE p <> 1) FROM (SELECT user_id, count(*) FILTER (WHERE is_positive) AS p FROM t_cand GROUP BY user_id)
UNION ALL SELECT 'positions_with_gaps', count(*) FILTER (WHERE m + 1 <> n) FROM (SELECT user_id, max(pos) AS m, count(*) AS n FROM t_cand GROUP BY user_id)""",
    lambda w: validate.candidates(w.candidates("test")),
)


register(
    "data_quality",
    """SELECT unnest(['rating_not_finite', 'rating_out_of_range', 'user_id_negative', 'item_id_negative', 'ts_missing', 'no_ratings']) AS "check", 0::BIGINT AS violations
UNION ALL SELECT 'pair_repeated', count(*) FROM (SELECT 1 FROM t_split GROUP BY user_id, item_id HAVING count(*) > 1)
UNION ALL SELECT 'history_too_short', count(*) FROM (SELECT 1 FROM t_split GROUP BY user_id HAVING count(*) < 5)
UNION ALL SELECT 'features_missing', count(*) FROM (SELECT DISTINCT item_id FROM t_split WHERE item_id NOT IN (SELECT item_id FROM t_feat))
UNION ALL SELECT 'item_repeated', count(*) FROM (SELECT 1 FROM t_items GROUP BY item_id HAVING count(*) > 1)""",
    lambda w: w.quality(),
)

# features
register("genre_multihot", "SELECT item_id, feature, x FROM t_hot", lambda w: content.multi_hot(w.items))
register("unknown_genres", "SELECT feature, count(*) AS n FROM t_hot WHERE feature NOT IN (SELECT p_brand FROM part) GROUP BY feature", lambda w: content.unknown_names(w.items, source.table(w.spark, w.sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct()))
register(
    "dense_features",
    f"SELECT item_id, len(vector) AS dim, {ROUND('list_sum(vector)')} AS total, {ROUND('vector[1]')} AS head FROM t_vec",
    lambda w: content.dense_features(source.tag_scores(w.spark, w.sf_dir)).select("item_id", F.size("vector").cast("long").alias("dim"), shown(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"), shown(F.col("vector")[0]).alias("head")),
)
register("dense_completeness", "SELECT item_id, count(*) AS n, count(DISTINCT feature) AS n_tags, count(*) FILTER (WHERE NOT (x BETWEEN -1 AND 1)) AS n_bad FROM t_tag GROUP BY item_id", lambda w: content.completeness(source.tag_scores(w.spark, w.sf_dir)))
register("l2_normalize", f"SELECT item_id, feature, {ROUND('x')} AS x FROM t_feat", lambda w: w.genre_features.withColumn("x", shown(F.col("x"))))
register("align_features", "SELECT item_id, feature, x FROM t_hot WHERE item_id IN (SELECT item_id FROM t_split)", lambda w: content.align(content.multi_hot(w.items), w.splits))
register("missing_features", "SELECT DISTINCT item_id FROM t_split WHERE item_id NOT IN (SELECT item_id FROM t_vec)", lambda w: content.missing(w.vectors, w.splits))
register("vector_dot", f"SELECT a.item_id, {ROUND('list_dot_product(a.vector, b.vector)')} AS product FROM t_vec a JOIN t_vec b ON b.item_id = a.item_id + 1", lambda w: w.vectors.join(w.vectors.select((F.col("item_id") - 1).alias("item_id"), F.col("vector").alias("other")), "item_id").select("item_id", shown(dot(F.col("vector"), F.col("other"))).alias("product")))

# splits and means
register("filter_catalog", "SELECT user_id, item_id, rating FROM t_raw WHERE item_id IN (SELECT vec_id FROM embeddings)", lambda w: w.in_catalog.select("user_id", "item_id", "rating"), catalog=True)
register("filter_min_history", "SELECT user_id, item_id, rating FROM t_kept", lambda w: prepare.filter_min_history(w.in_catalog, w.p.min_history).select("user_id", "item_id", "rating"), O.CATALOG, catalog=True)
register("user_activity", "SELECT user_id, count(*) AS n FROM t_raw GROUP BY user_id", lambda w: prepare.user_activity(w.raw))
register("catalog_distinct", "SELECT DISTINCT item_id FROM t_split", lambda w: w.splits.select("item_id").distinct())
register("chronological_split", "SELECT user_id, item_id, rating, split FROM t_split", lambda w: w.splits.select("user_id", "item_id", "rating", "split"))
register("chronological_split_catalog", "SELECT user_id, item_id, rating, split FROM t_split", lambda w: w.splits.select("user_id", "item_id", "rating", "split"), O.CATALOG, catalog=True)
register("dense_remap", "SELECT user_id, item_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INT) AS user_dense, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS INT) AS item_dense FROM t_split", lambda w: prepare.dense_remap(w.splits).select("user_id", "item_id", "user_dense", "item_dense"))
register("user_block_bounds", "SELECT CAST(floor((upto - 1) * 8 / total) AS INT) AS block, min(user_id) AS first_user, max(user_id) AS last_user, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (ORDER BY user_id) AS upto, sum(n) OVER () AS total FROM (SELECT user_id, count(*) AS n FROM t_split GROUP BY user_id)) GROUP BY block", lambda w: prepare.block_bounds(w.splits, 8))
register("global_mean", f"SELECT {ROUND('mu')} AS mu FROM t_mu", lambda w: w.mu.select(shown(F.col("mu")).alias("mu")))
register("user_means", f"SELECT user_id, {ROUND('mean')} AS mean, n FROM t_um", lambda w: w.user_means.select("user_id", shown(F.col("mean")).alias("mean"), "n"))
register("item_means", f"SELECT item_id, {ROUND('mean')} AS mean, n FROM t_im", lambda w: w.item_means.select("item_id", shown(F.col("mean")).alias("mean"), "n"))
register("train_presence", "SELECT DISTINCT s.item_id, s.item_id IN (SELECT item_id FROM t_train) AS seen FROM t_split s", lambda w: prepare.presence(w.train, w.splits, "item_id"))
register("mean_centered", f"SELECT user_id, item_id, {ROUND('residual')} AS residual FROM t_cen", lambda w: prepare.centered(w.train).select("user_id", "item_id", shown(F.col("residual")).alias("residual")))
register("known_items", "SELECT user_id, item_id FROM t_known", lambda w: w.known)
register(
    "dataset_metadata",
    f"""SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, {ROUND("avg(rating) FILTER (WHERE split = 'train')")} AS global_mean, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test, count(*) AS n_rows, {O.P.min_history} AS min_history, {O.P.min_history - 2} AS min_train, 'item' AS tie_break, false AS "catalog",
  {O.P.relevance}::DOUBLE AS relevance, {O.P.item_neighbors} AS item_neighbors, {O.P.user_neighbors} AS user_neighbors, {O.P.min_common} AS min_common, {O.P.shrinkage}::DOUBLE AS shrinkage, {O.P.ranking_users} AS ranking_users,
  {O.P.candidates} AS n_candidates, {O.P.validation_seed} AS validation_seed, {O.P.test_seed} AS test_seed FROM t_split""",
    lambda w: w.metadata(),
)

# content
register("genre_profile", f"SELECT user_id, feature, {ROUND('w')} AS w FROM t_prof", lambda w: w.profiles("genre").withColumn("w", shown(F.col("w"))))
register("dense_profile", f"SELECT user_id, feature, {ROUND('w')} AS w FROM t_tagprof", lambda w: w.profiles("tag").withColumn("w", shown(F.col("w"))), O.CATALOG, catalog=True)
register("content_similarity", f"SELECT user_id, item_id, {ROUND('cosine')} AS cosine FROM t_cos JOIN t_test USING (user_id, item_id)", lambda w: w.cosines(w.split("test"), "genre").withColumn("cosine", shown(F.col("cosine"))))
register("content_beta_genre", f"SELECT {ROUND('beta')} AS beta FROM t_beta", lambda w: w.beta("genre").select(shown(F.col("beta")).alias("beta")))
register("content_beta_dense", f"SELECT {ROUND('beta')} AS beta FROM t_tbeta", lambda w: w.beta("tag").select(shown(F.col("beta")).alias("beta")), O.CATALOG, catalog=True)
register("content_predict_genre", f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction FROM t_content JOIN t_test USING (user_id, item_id)", lambda w: w.predictions("genre_content").select("user_id", "item_id", shown(F.col("prediction")).alias("prediction")))
register("content_predict_dense", f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction FROM t_tcontent JOIN t_test USING (user_id, item_id)", lambda w: w.predictions("genome_content").select("user_id", "item_id", shown(F.col("prediction")).alias("prediction")), O.CATALOG, catalog=True)

# similarity and neighbours


def _stats(df: DataFrame) -> DataFrame:
    return df.select("a", "b", *[shown(steady(F.col(c))).alias(c) for c in ("xy", "xx", "yy")], "n")


PAIR_SQL = "SELECT a, b, " + ", ".join(f"{ROUND(f'round({c}, 9)')} AS {c}" for c in ("xy", "xx", "yy")) + ", n FROM {} WHERE a < b"
register("item_pair_stats", PAIR_SQL.format("t_ipairs"), lambda w: _stats(similarity.pair_stats(w.train, "item_id", "user_id", w.p.min_common)))
register("user_pair_stats", PAIR_SQL.format("t_upairs"), lambda w: _stats(similarity.pair_stats(w.train, "user_id", "item_id", w.p.min_common)))
register("item_similarity", "SELECT item_id, nbr_id, sim, support FROM t_isim", lambda w: w.item_edges)
register("item_topk_neighbors", "SELECT item_id, nbr_id, sim, support FROM t_itop", lambda w: w.item_graph)
register("item_topk_neighbors_catalog", "SELECT item_id, nbr_id, sim, support FROM t_itop", lambda w: w.item_graph, O.CATALOG, catalog=True)
register("user_similarity", "SELECT user_id, nbr_id, sim, n_common FROM t_usim", lambda w: w.user_edges)
register("user_similarity_lookup", "SELECT user_id, nbr_id, sim, n_common FROM t_usim WHERE user_id IN (SELECT user_id FROM t_ru)", lambda w: similarity.user_similarity_to(w.train, w.ranking_users("test"), w.p.min_common, w.p.shrinkage))
register("user_knn_neighbors", "SELECT user_id, item_id, nbr_id, sim FROM t_unbr_all JOIN t_test USING (user_id, item_id) WHERE nth <= 3", lambda w: w.user_neighbors(w.split("test"), 3).select("user_id", "item_id", "nbr_id", "sim"))
PREDICTED = f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction, n_neighbors FROM {{}} JOIN t_test USING (user_id, item_id)"


def _predicted(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item_id", shown(F.col("prediction")).alias("prediction"), "n_neighbors")


register("user_knn_predict", PREDICTED.format("t_uknn"), lambda w: _predicted(w.user_knn(w.split("test"))))
register("item_knn_predict", PREDICTED.format("t_iknn"), lambda w: _predicted(w.item_knn(w.split("test"))))

register("neighbor_counts", "SELECT 'user_knn' AS stage, user_id, item_id, n_neighbors FROM t_uknn JOIN t_test USING (user_id, item_id) UNION ALL SELECT 'movie_knn', user_id, item_id, n_neighbors FROM t_iknn JOIN t_test USING (user_id, item_id)", lambda w: w.counted("user_knn").select(F.lit("user_knn").alias("stage"), "user_id", "item_id", "n_neighbors").unionByName(w.counted("movie_knn").select(F.lit("movie_knn").alias("stage"), "user_id", "item_id", "n_neighbors")))
register("tag_index", "SELECT item_id - 1 AS tag_id, title AS tag, CAST(row_number() OVER (ORDER BY item_id DESC) - 1 AS INT) AS place FROM t_items", lambda w: source.tag_index(w.items.orderBy(F.desc("item_id")).select((F.col("item_id") - 1).alias("tag_id"), F.col("title").alias("tag"))))

# candidates
register("relevant_heldout", "SELECT user_id, item_id, rating FROM t_rel", lambda w: C.relevant_heldout(w.split("test"), w.train, w.p.relevance).select("user_id", "item_id", "rating"))
register("ranking_users", "SELECT user_id, positive FROM t_ru", lambda w: w.ranking_users("test"))
register("unobserved_items", "SELECT user_id, item_id FROM t_free", lambda w: C.unobserved(w.ranking_users("test"), w.train, w.known))
register("ranking_negatives", "SELECT user_id, item_id FROM t_neg", lambda w: C.drawn_negatives(w.ranking_users("test"), w.train, w.known, w.p.candidates - 1, w.p.test_seed, w.written))
register("ranking_candidates", "SELECT user_id, pos, item_id, is_positive FROM t_cand", lambda w: w.candidates("test"))
register("ranking_candidates_validation", "SELECT user_id, pos, item_id, is_positive FROM t_candval", lambda w: w.candidates("validation"))
register("bpr_positives", "SELECT user_id, item_id FROM t_bpos", lambda w: w.train.where(F.col("rating") >= w.p.relevance).select("user_id", "item_id"))


def _negatives(w: Workspace) -> DataFrame:
    return C.bpr_negatives(w.train.where(F.col("rating") >= w.p.relevance), w.train, w.p.seed)


register("bpr_negatives", "SELECT user_id, item_id, negative FROM t_bneg", _negatives)

# factors
register("mf_predict", f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction FROM t_mf JOIN t_test USING (user_id, item_id)", lambda w: w.predictions("mf").select("user_id", "item_id", shown(F.col("prediction")).alias("prediction")))
register("bpr_score", f"SELECT user_id, item_id, {ROUND('score')} AS score FROM t_bpr JOIN t_test USING (user_id, item_id)", lambda w: w.bpr(w.split("test")).withColumn("score", shown(F.col("score"))))
register("affine_fit", f"SELECT {ROUND('slope')} AS slope, {ROUND('intercept')} AS intercept FROM t_affine", lambda w: w.affine.select(shown(F.col("slope")).alias("slope"), shown(F.col("intercept")).alias("intercept")))
register("bpr_predict", f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction FROM t_bprr JOIN t_test USING (user_id, item_id)", lambda w: w.predictions("bpr").select("user_id", "item_id", shown(F.col("prediction")).alias("prediction")))
register(
    "mf_sgd_step",
    f"""SELECT user_id, n, {ROUND('round(bias + 0.005::DOUBLE * (e - 0.02::DOUBLE * n * bias), 9)')} AS bias FROM (SELECT t.user_id, count(*) AS n, sum(round(rating - round(mu + u.bias + i.bias + list_dot_product(u.factors, i.factors), 9), 9)) AS e
FROM t_train t JOIN t_mfu u ON u.user_id = t.user_id JOIN t_mfi i ON i.item_id = t.item_id, t_mu GROUP BY t.user_id) JOIN t_mfu USING (user_id)""",
    lambda w: factors.mf_step(w.train, w.mf_users, w.mf_items, w.mu, w.p.mf_rate, w.p.mf_grid[0]).withColumn("bias", shown(F.col("bias"))),
)
register("bpr_gradient", f"SELECT user_id, item_id, negative, {ROUND('1 / (1 + exp(margin))')} AS gradient FROM t_tri", lambda w: factors.bpr_gradients(_negatives(w), w.bpr_users, w.bpr_items).withColumn("gradient", shown(F.col("gradient"))))
register(
    "pair_accuracy",
    f"SELECT {ROUND('avg(CASE WHEN margin > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS accuracy, count(*) AS n FROM (SELECT * FROM t_tri ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), user_id, item_id LIMIT 2000)",
    lambda w: factors.triples(_negatives(w), w.bpr_users, w.bpr_items).orderBy(C.shuffled(F.lit(w.p.seed), F.col("user_id"), F.col("item_id")), "user_id", "item_id").limit(w.p.monitored).agg(shown(F.avg((F.col("margin") > 0).cast("double"))).alias("accuracy"), F.count("*").alias("n")),
)

# ensembles
register("hybrid_alpha_sweep", f"SELECT alpha, {ROUND('rmse')} AS rmse FROM t_asweep", lambda w: w.alpha_sweep.withColumn("rmse", shown(F.col("rmse"))), O.CATALOG, catalog=True)
register("hybrid_alpha", f"SELECT alpha, {ROUND('rmse')} AS rmse FROM t_alpha", lambda w: w.alpha.withColumn("rmse", shown(F.col("rmse"))), O.CATALOG, catalog=True)
register("hybrid_predict", PREDICTED.format("t_hyb"), lambda w: _predicted(w.split("test").select("user_id", "item_id").join(w.hybrid(w.split("test"), w.held_components), ["user_id", "item_id"])), O.CATALOG, catalog=True)
register(
    "hybrid_rank_confident",
    f"SELECT user_id, pos, item_id, {ROUND('score')} AS score FROM t_s_hybrid_n",
    lambda w: w.candidates("test").join(w.hybrid(w.candidates("test")), ["user_id", "item_id"]).select("user_id", "pos", "item_id", shown(F.col("prediction")).alias("score")),
    O.CATALOG,
    catalog=True,
)
register("lambda_rating_sweep", f"SELECT lam, {ROUND('rmse')} AS rmse FROM t_rsweep", lambda w: w.rating_sweep.withColumn("rmse", shown(F.col("rmse"))))
register("lambda_rating", f"SELECT lam, {ROUND('rmse')} AS rmse FROM t_rlam", lambda w: w.rating_lambda.withColumn("rmse", shown(F.col("rmse"))))
register("lambda_ranking_sweep", "SELECT lam, hit_rate, ndcg, mrr FROM t_ksweep", lambda w: w.ranking_sweep)
register("lambda_ranking", "SELECT lam, ndcg FROM t_klam", lambda w: w.ranking_lambda.select("lam", "ndcg"))
register("lambda_sweep", f"SELECT lam, {ROUND('r.rmse')} AS rmse, ndcg FROM t_rsweep r JOIN t_ksweep USING (lam)", lambda w: w.rating_sweep.withColumn("rmse", shown(F.col("rmse"))).join(w.ranking_sweep.select("lam", "ndcg"), "lam"))
register("zscore_rows", f"SELECT user_id, pos, {ROUND('za')} AS za, {ROUND('zb')} AS zb FROM t_z", lambda w: ensemble.zscore(ensemble.zscore(w.two_scores("test"), "a", "za"), "b", "zb").select("user_id", "pos", shown(F.col("za")).alias("za"), shown(F.col("zb")).alias("zb")))
register("mf_bpr_predict", f"SELECT user_id, item_id, {ROUND('prediction')} AS prediction FROM t_mfbpr JOIN t_test USING (user_id, item_id)", lambda w: w.predictions("mf_bpr").select("user_id", "item_id", shown(F.col("prediction")).alias("prediction")))

# stages: rating metrics, candidate scores, ranks and ranking metrics
DENSE = ("genome_content", "hybrid")  # stages that need dense vectors, and so the items that have them
for _stage, _rows in O.PREDICTIONS.items():
    _view = (O.CATALOG, True) if _stage in DENSE else (None, False)
    register(f"rating_metrics_{_stage}", O.metrics(_rows), lambda w, s=_stage: w.rating_metrics(s), _view[0], catalog=_view[1])
    register(f"rank_scores_{_stage}", f"SELECT user_id, pos, item_id, is_positive, {ROUND('score')} AS score FROM t_s_{_stage}", lambda w, s=_stage: w.rank_scores(s).withColumn("score", shown(F.col("score"))), _view[0], catalog=_view[1])
    register(f"ranking_metrics_{_stage}", O.ranking(f"t_r_{_stage}"), lambda w, s=_stage: w.ranking_metrics(s), _view[0], catalog=_view[1])
register("positive_rank", "SELECT user_id, rank FROM t_r_movie_knn", lambda w: w.ranks("movie_knn"))
register(
    "topn_recommend",
    f"""SELECT user_id, nth, item_id, {ROUND('prediction')} AS score FROM (SELECT f.user_id, f.item_id, prediction, CAST(row_number() OVER (PARTITION BY f.user_id ORDER BY prediction DESC, f.item_id) AS INT) AS nth
FROM t_free f JOIN (SELECT f.user_id, f.item_id, round(mu + u.bias + i.bias + list_dot_product(u.factors, i.factors), 9) AS prediction FROM t_free f JOIN t_mfu u ON u.user_id = f.user_id JOIN t_mfi i ON i.item_id = f.item_id, t_mu) USING (user_id, item_id)) WHERE nth <= 10""",
    lambda w: w.top_n(w.ranking_users("test"), "mf", 10),
)

# trainers
register("mf_grid", None, lambda w: trainers.mf_monitor(w.train, w.p), catalog=True)
register("bpr_grid", None, lambda w: trainers.bpr_monitor(w.train, w.p), catalog=True)
register("mf_select", None, lambda w: trainers.best_mf(trainers.mf_errors(w.keep(trainers.mf_grid(w.train, w.p)), w.split("validation"))), catalog=True)
register("bpr_select", None, lambda w: trainers.best_bpr(trainers.bpr_quality(w.keep(trainers.bpr_grid(w.train, w.p)), w.candidates("validation"), w.p.cutoff, w.p.candidates)), catalog=True)
register("bpr_blocks", None, lambda w: trainers.bpr_quality(w.bpr_blocks(), w.candidates("validation"), w.p.cutoff, w.p.candidates), catalog=True)
register("mf_als", None, lambda w: trainers.mf_als(w.train, w.p, w.p.mf_grid[1]).select("side", "id", "bias", F.size("factors").alias("n_factors")), catalog=True)
register("factor_pca", None, lambda w: reports.factor_pca(w.mf_users))


def _trained(w: Workspace) -> Workspace:
    """The same workspace with trained factors instead of the stand-ins; splits and candidates are the same tables.

    Both models are trained at the same time, as each takes only as many tasks as it has regularisations, and candidates are drawn meanwhile.
    """
    w.splits, w.catalogue, w.known, w._candidates  # made before, once for all
    names = ("mf", "bpr")
    with ThreadPoolExecutor(len(names) + 1) as pool:
        trained, drawn = pool.map(w.train_model, names), pool.submit(lambda: [w.candidates(x) for x in ("validation", "test")])
        models = dict(zip(names, trained))
        drawn.result()
    t = Workspace(w.spark, w.sf_dir, w.p, w.catalog, models=models, report=w.report)
    t.splits, t._candidates = w.splits, w._candidates
    return t


def _trained_metrics(w: Workspace) -> DataFrame:
    t = _trained(w)
    return reports.rating(t, ("global_mean", "mf", "bpr", "mf_bpr")).select("stage", "rmse").join(reports.ranking(t, ("global_mean", "mf", "bpr", "mf_bpr")).select("stage", "ndcg"), "stage")


register("trained_factor_stages", None, _trained_metrics, catalog=True, report=True)

# stages of a caller: functions of pairs, counts of pairs, and functions of a user's items
CUSTOM_SCORE = "(1 + (user_id * 7 + item_id * 3) % 9 / 2.0::DOUBLE)"


def _custom(users, items):
    return 1 + (users * 7 + items * 3) % 9 / 2.0


OWN_STAGE = S.Stage("a caller's own", S.row_map(_custom), S.per_user(_custom))
_OWN = f"(SELECT t.*, {CUSTOM_SCORE} AS prediction FROM t_test t)"
_OWN_RANKS = O.ranks(f"(SELECT c.*, {CUSTOM_SCORE} AS score FROM t_cand c)")
register("custom_row_map", O.metrics(_OWN), lambda w: S.rating_metrics(w, OWN_STAGE))
register("custom_row_count", "SELECT user_id, item_id, CAST((user_id + item_id) % 7 AS INT) AS n FROM t_test", lambda w: S.row_count(lambda users, items: (users + items) % 7)(w, w.split("test")))
register("custom_ranking", O.ranking(f"({_OWN_RANKS})"), lambda w: S.ranking_metrics(w, OWN_STAGE))

# reports
RESULTS = tuple(STAGES)
_RATING = "\nUNION ALL ".join(f"SELECT '{s}' AS stage, {k} AS ord, * FROM ({O.metrics(O.PREDICTIONS[s])})" for k, s in enumerate(RESULTS))
_RANKING = "\nUNION ALL ".join(f"SELECT '{s}' AS stage, {k} AS ord, * FROM ({O.ranking(f't_r_{s}')})" for k, s in enumerate(RESULTS))


def report(name: str, sql: str, plan: Callable[[Workspace], DataFrame]) -> None:
    """A report of several stages, on the items that all of them know."""
    register(name, sql, plan, O.CATALOG, catalog=True, report=True)


report("report_rating", f"SELECT stage, ord, rmse, mae, bounded_rmse, bounded_mae FROM ({_RATING})", lambda w: reports.rating(w, RESULTS).select("stage", "ord", "rmse", "mae", "bounded_rmse", "bounded_mae"))
report("report_out_of_range", f"SELECT stage, ord, n_out_of_range, out_of_range_pct FROM ({_RATING})", lambda w: reports.rating(w, RESULTS).select("stage", "ord", "n_out_of_range", "out_of_range_pct"))
report("report_ranking", f"SELECT stage, ord, hit_rate, ndcg, mrr, k FROM ({_RANKING})", lambda w: reports.ranking(w, RESULTS).select("stage", "ord", "hit_rate", "ndcg", "mrr", "k"))
report("report_tradeoff", f"SELECT stage, rmse, ndcg FROM ({_RATING}) JOIN ({_RANKING}) USING (stage)", lambda w: reports.tradeoff(w, RESULTS))
# seconds that a run might have left; a report is of what its sidecars hold
TIMES = [("mf", "train", 41.5), ("bpr", "train", 63.25), ("hybrid", "train", 12.0), ("global_mean", "train", 0.0), ("mf", "predict", 0.5), ("user_knn", "predict", 30.0), ("user_knn", "rank", 4.0), ("bpr", "rank", 0.25), ("movie_knn", "rank", 0.0)]
_TIMES = "(VALUES " + ", ".join(f"('{s}', '{kind}', {x}::DOUBLE)" for s, kind, x in TIMES) + ") v(stage, kind, seconds)"


def _times(w: Workspace) -> DataFrame:
    return w.spark.createDataFrame(TIMES, "stage string, kind string, seconds double")


_NTH = "CAST(row_number() OVER (PARTITION BY kind ORDER BY seconds, stage) AS INT) AS nth"
register("report_training_time", f"SELECT stage, seconds, {_NTH} FROM {_TIMES} WHERE kind = 'train' AND seconds > 0", lambda w: reports.training_time(_times(w)))
register("report_prediction_time", f"SELECT kind, stage, seconds, {_NTH} FROM {_TIMES} WHERE kind <> 'train' AND seconds > 0", lambda w: reports.prediction_time(_times(w)))
register(
    "report_order",
    "SELECT * FROM (VALUES ('mf_bpr', 2), ('bpr', 1), ('a new one', 3), ('genre_content', 0), ('z', 4)) v(stage, ord)",
    lambda w: reports.in_display_order(w.spark.createDataFrame([(s,) for s in ("z", "mf_bpr", "bpr", "a new one", "genre_content")], "stage string")),
)
HYBRIDS = ("mf", "bpr", "mf_bpr")
_HIST = "\nUNION ALL ".join(f"SELECT '{s}' AS stage, rank FROM t_r_{s}" for s in HYBRIDS)
register(
    "report_rank_hist",
    f"SELECT stage, bin, count(*) AS users, any_value(median) AS median FROM (SELECT stage, CAST(floor((rank - 1) * 20.0 / {O.P.candidates}) AS INT) AS bin, quantile_cont(rank, 0.5) OVER (PARTITION BY stage) AS median FROM ({_HIST})) GROUP BY stage, bin",
    lambda w: reports.rank_hist(w, HYBRIDS),
    report=True,
)
register("report_rank_gap", "SELECT user_id, a.rank AS rank_mf, b.rank AS rank_bpr, c.rank AS rank_hybrid FROM t_r_mf a JOIN t_r_bpr b USING (user_id) JOIN t_r_mf_bpr c USING (user_id)", lambda w: reports.rank_gap(w))
_SCALES = "SELECT 'mf' AS stage, a AS score, user_id FROM t_two UNION ALL SELECT 'bpr', b, user_id FROM t_two"
register(
    "report_score_scales",
    f"SELECT stage, CAST(least(59, floor((score - lo) / ((hi - lo) / 60))) AS INT) AS bin, count(*) AS n, any_value({ROUND('m')}) AS pooled_mean FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS m FROM ({_SCALES}) WINDOW w AS (PARTITION BY stage)) GROUP BY stage, bin",
    lambda w: reports.score_scales(w),
)
register("report_score_means", f"SELECT 'mf' AS stage, user_id, {ROUND('avg(a)')} AS row_mean FROM t_two GROUP BY user_id UNION ALL SELECT 'bpr', user_id, {ROUND('avg(b)')} FROM t_two GROUP BY user_id", lambda w: reports.score_means(w))
register(
    "report_decomposition",
    f"SELECT user_id, pos, {ROUND('lam * za')} AS mf_part, {ROUND('(1 - lam) * zb')} AS bpr_part, {ROUND('score')} AS score FROM t_fused WHERE user_id IN (SELECT user_id FROM t_ru ORDER BY user_id LIMIT 5)",
    lambda w: reports.decomposition(w, 5),
)
register(
    "report_bpr_calibration",
    f"SELECT {ROUND('any_value(slope)')} AS slope, {ROUND('any_value(intercept)')} AS intercept, {ROUND('min(prediction)')} AS lowest, {ROUND('max(prediction)')} AS highest FROM t_bprr JOIN t_test USING (user_id, item_id), t_affine",
    lambda w: reports.calibration(w),
)
register(
    "report_calibration_line",
    f"SELECT CAST(p AS INT) AS point, {ROUND('x')} AS score, {ROUND('slope * x + intercept')} AS rating FROM (SELECT p, slope, intercept, lo + (hi - lo) * p / 199.0::DOUBLE AS x FROM range(200) r(p), t_affine, (SELECT min(score) AS lo, max(score) AS hi FROM t_bpr JOIN t_test USING (user_id, item_id)))",
    lambda w: reports.calibration_line(w),
)
register(
    "merge_results",
    f"SELECT 'global_mean' AS stage, rmse, mae FROM ({O.metrics(O.PREDICTIONS['movie_knn'])}) UNION ALL SELECT 'mf', rmse, mae FROM ({O.metrics(O.PREDICTIONS['mf'])})",
    lambda w: merge(
        w.rating_metrics("global_mean").select(F.lit(1).alias("part"), F.lit("global_mean").alias("stage"), "rmse", "mae")
        .unionByName(w.rating_metrics("mf").select(F.lit(1).alias("part"), F.lit("mf").alias("stage"), "rmse", "mae"))
        .unionByName(w.rating_metrics("movie_knn").select(F.lit(2).alias("part"), F.lit("global_mean").alias("stage"), "rmse", "mae"))
    ),
)
register("streaming_user_means", "SELECT user_id, count(*) AS n, " + ROUND("avg(value)") + " AS mean FROM events GROUP BY user_id", lambda w: streaming.replay(w.spark, w.sf_dir))
