"""The tables behind each chart of a run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import shown
from affinis.schema import STAGES

if TYPE_CHECKING:
    from affinis.plans.workspace import Workspace


#: The reports of a run by name: each takes a workspace, and those of several stages the stages.
REPORTS: dict[str, Callable[..., DataFrame]] = {}


def report(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    REPORTS[build.__name__] = build
    return build


def in_display_order(rows: DataFrame) -> DataFrame:
    """(stage, ..., ord): known stages in the order of STAGES, others after them by name."""
    places = F.create_map(*[x for k, s in enumerate(STAGES) for x in (F.lit(s), F.lit(k))])
    known = F.try_element_at(places, F.col("stage"))
    after = F.row_number().over(Window.orderBy(F.coalesce(known, F.lit(len(STAGES))), "stage")) - 1  # a row for each stage
    return rows.withColumn("ord", after)


def _each(stages: tuple[str, ...], one) -> DataFrame:
    return reduce(DataFrame.unionByName, [one(s).select(F.lit(s).alias("stage"), F.lit(k).alias("ord"), "*") for k, s in enumerate(stages)])


@report
def rating(w: Workspace, stages: tuple[str, ...]) -> DataFrame:
    return _each(stages, w.rating_metrics)


@report
def ranking(w: Workspace, stages: tuple[str, ...]) -> DataFrame:
    rows = _each(stages, w.ranking_metrics)
    return rows.drop("k").join(F.broadcast(common_cutoff(rows)))


@report
def tradeoff(w: Workspace, stages: tuple[str, ...]) -> DataFrame:
    """(stage, rmse, ndcg) of the stages that have both; no row where these are fewer than two."""
    both = rating(w, stages).select("stage", "rmse").join(ranking(w, stages).select("stage", "ndcg"), "stage").where("rmse IS NOT NULL AND ndcg IS NOT NULL")
    return both.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).where("n >= 2").drop("n")


def common_cutoff(report: DataFrame) -> DataFrame:
    """(k): the one cutoff of all stages; no row if they differ."""
    return report.agg(F.min("k").alias("k"), F.countDistinct("k").alias("n")).where("n = 1").select("k")


def by_seconds(times: DataFrame) -> DataFrame:
    """(stage, seconds, nth) of stages that took any time, fastest first."""
    nth = F.row_number().over(Window.orderBy("seconds", "stage"))  # a row for each stage
    return times.where("seconds > 0").select("stage", "seconds", nth.alias("nth"))


def training_time(timings: DataFrame) -> DataFrame:
    """``by_seconds`` of what the stages took to train, from (stage, kind, seconds)."""
    return by_seconds(timings.where("kind = 'train'"))


def prediction_time(timings: DataFrame) -> DataFrame:
    """(kind, stage, seconds, nth) of what the stages took to predict held-out ratings and to score candidates."""
    parts = [by_seconds(timings.where(F.col("kind") == kind)).select(F.lit(kind).alias("kind"), "*") for kind in ("predict", "rank")]
    return reduce(DataFrame.unionByName, parts)


@report
def rank_hist(w: Workspace, stages: tuple[str, ...], bins: int = 20) -> DataFrame:
    """(stage, bin, users, median) of the positive's rank."""
    ranks = _each(stages, lambda s: w.settle(w.ranks(s)))
    placed = ranks.withColumn("bin", F.floor((F.col("rank") - 1) * float(bins) / w.p.candidates).cast("int"))
    medians = ranks.groupBy("stage").agg(F.percentile("rank", 0.5).alias("median"))
    return placed.groupBy("stage", "bin").agg(F.count("*").alias("users")).join(F.broadcast(medians), "stage")


@report
def rank_gap(w: Workspace) -> DataFrame:
    """(user_id, rank_mf, rank_bpr, rank_hybrid)."""
    parts = [w.ranks(s).withColumnRenamed("rank", name) for s, name in (("mf", "rank_mf"), ("bpr", "rank_bpr"), ("mf_bpr", "rank_hybrid"))]
    return reduce(lambda a, b: a.join(b, "user_id"), parts)


@report
def score_scales(w: Workspace, bins: int = 60) -> DataFrame:
    """(stage, bin, n, pooled_mean) of raw scores, in bins between each model's least and largest score."""
    two = w.two_scores("test")
    rows = two.select(F.lit("mf").alias("stage"), F.col("a").alias("score")).unionByName(two.select(F.lit("bpr").alias("stage"), F.col("b").alias("score")))
    ends = rows.groupBy("stage").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), shown(F.avg("score")).alias("pooled_mean"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int")
    return rows.join(F.broadcast(ends), "stage").withColumn("bin", bin_).groupBy("stage", "bin").agg(F.count("*").alias("n"), F.first("pooled_mean").alias("pooled_mean"))


@report
def score_means(w: Workspace) -> DataFrame:
    """(stage, user_id, row_mean) of raw scores of each user's candidates."""
    two = w.two_scores("test").groupBy("user_id").agg(shown(F.avg("a")).alias("mf"), shown(F.avg("b")).alias("bpr"))
    return two.select("user_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("row_mean")) for s in ("mf", "bpr")])).alias("x")).select("x.stage", "user_id", "x.row_mean")


@report
def decomposition(w: Workspace, users: int) -> DataFrame:
    """(user_id, pos, mf_part, bpr_part, score) of the first users' fused scores."""
    first = w.ranking_users("test").select("user_id").orderBy("user_id").limit(users)
    rows = w.fused("test").join(F.broadcast(first), "user_id", "left_semi")
    return rows.select("user_id", "pos", shown(F.col("lam") * F.col("za")).alias("mf_part"), shown((F.lit(1.0) - F.col("lam")) * F.col("zb")).alias("bpr_part"), shown(F.col("score")).alias("score"))


@report
def calibration_line(w: Workspace, points: int = 200) -> DataFrame:
    """(point, score, rating): the map from scores to ratings between the test split's least and largest score."""
    ends = w.bpr(w.split("test")).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).crossJoin(F.broadcast(w.affine))
    at = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = at.withColumn("score", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1)))
    return at.select("point", shown(F.col("score")).alias("score"), shown(F.col("slope") * F.col("score") + F.col("intercept")).alias("rating"))


@report
def calibration(w: Workspace) -> DataFrame:
    """(slope, intercept, lowest, highest) of the map from scores to ratings on the test split."""
    ends = w.bpr_ratings(w.split("test")).agg(shown(F.min("prediction")).alias("lowest"), shown(F.max("prediction")).alias("highest"))
    line = w.affine.select(shown(F.col("slope")).alias("slope"), shown(F.col("intercept")).alias("intercept"))
    return line.crossJoin(F.broadcast(ends))


def factor_pca(users: DataFrame, rows: int = 5000) -> DataFrame:
    """(user_id, pc1, pc2, share1, share2) of the first users' factors: principal components and their shares of the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = users.orderBy("user_id").limit(rows).select("user_id", array_to_vector("factors").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="pc").fit(first)
    share = model.explainedVariance.toArray()
    out = model.transform(first).select("user_id", vector_to_array("pc").alias("pc"))
    return out.select("user_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"), F.lit(float(share[0])).alias("share1"), F.lit(float(share[1])).alias("share2"))
