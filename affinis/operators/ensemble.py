"""Blends of two models, with weights picked on validation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import safe_div, steady
from affinis.operators.metrics import positive_rank, ranking_metrics


def grid(rows: DataFrame, steps: int, name: str) -> DataFrame:
    """Each row with each weight 0, 1 / steps, ..., 1."""
    weights = F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)]))
    return rows.withColumn(name, weights)


def blend(weight, a, b):
    return weight * a + (F.lit(1.0) - weight) * b


def confident(rows: DataFrame, weight) -> DataFrame:
    """Adds prediction: the blend of content and neighbours, or content alone where there are none."""
    mixed = F.when(F.col("n_neighbors") > 0, blend(weight, F.col("content"), F.col("knn"))).otherwise(F.col("content"))
    return rows.withColumn("prediction", mixed)


def alpha_sweep(rows: DataFrame, steps: int) -> DataFrame:
    """(alpha, rmse) of the confident blend on (rating, content, knn, n_neighbors)."""
    error = F.col("prediction") - F.col("rating")
    return confident(grid(rows, steps, "alpha"), F.col("alpha")).groupBy("alpha").agg(steady(F.sqrt(F.avg(error * error))).alias("rmse"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    """The least error; the smaller weight of equal ones."""
    return sweep.orderBy("rmse", "alpha").limit(1)


def rating_sweep(rows: DataFrame, steps: int) -> DataFrame:
    """(lam, rmse) of the blend on (rating, a, b)."""
    error = blend(F.col("lam"), F.col("a"), F.col("b")) - F.col("rating")
    return grid(rows, steps, "lam").groupBy("lam").agg(steady(F.sqrt(F.avg(error * error))).alias("rmse"))


def best_rating_lambda(sweep: DataFrame) -> DataFrame:
    """The least error; the larger weight of equal ones."""
    return sweep.orderBy("rmse", F.desc("lam")).limit(1)


def zscore(scored: DataFrame, value: str, out: str) -> DataFrame:
    """Adds each user's standardised scores, by the population deviation; constant rows become zeros."""
    own = Window.partitionBy("user_id")
    std = F.stddev_pop(value).over(own)
    return scored.withColumn(out, steady(F.when(std < 1e-12, F.lit(0.0)).otherwise(safe_div(F.col(value) - F.avg(value).over(own), std))))


def fused(scored: DataFrame, weight) -> DataFrame:
    """Adds score: the blend of the standardised scores of a and b."""
    both = zscore(zscore(scored, "a", "za"), "b", "zb")
    return both.withColumn("score", steady(blend(weight, F.col("za"), F.col("zb"))))


def ranking_sweep(scored: DataFrame, steps: int, cutoff: int, candidates: int) -> DataFrame:
    """(lam, hit_rate, ndcg, mrr) of the fused scores on (user_id, pos, is_positive, a, b)."""
    both = zscore(zscore(scored, "a", "za"), "b", "zb")
    rows = grid(both, steps, "lam").withColumn("score", steady(blend(F.col("lam"), F.col("za"), F.col("zb"))))
    return ranking_metrics(positive_rank(rows, "lam"), cutoff, candidates, "lam").select("lam", "hit_rate", "ndcg", "mrr")


def best_ranking_lambda(sweep: DataFrame) -> DataFrame:
    """The best NDCG; the larger weight of equal ones."""
    return sweep.orderBy(F.desc("ndcg"), F.desc("lam")).limit(1)


def affine(rows: DataFrame) -> DataFrame:
    """(slope, intercept) of rating on score by least squares, the slope not below 0."""
    x, y, n = F.col("score"), F.col("rating"), F.count("*")
    sums = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), n.alias("n"))
    slope = F.when(F.col("xx") * F.col("n") > 2.220446049250313e-16, F.greatest(F.lit(0.0), F.col("xy") / F.col("xx"))).otherwise(F.lit(0.0))
    return sums.select(steady(slope).alias("slope"), "mx", "my").select("slope", steady(F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
