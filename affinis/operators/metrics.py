"""Rating errors and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import clip, discount, finite, shown


def rating_metrics(rows: DataFrame, low: float, high: float, *by: str) -> DataFrame:
    """One row (for each ``by``) of errors of prediction against rating, raw and with predictions clipped to the scale."""
    error = F.col("prediction") - F.col("rating")
    bounded = clip(F.col("prediction"), low, high) - F.col("rating")
    outside = ((F.col("prediction") < low) | (F.col("prediction") > high)).cast("double")
    sums = rows.groupBy(*by).agg(
        shown(F.sqrt(F.avg(error * error))).alias("rmse"),
        shown(F.avg(F.abs(error))).alias("mae"),
        shown(F.avg(error)).alias("bias"),
        shown(F.sqrt(F.avg(bounded * bounded))).alias("bounded_rmse"),
        shown(F.avg(F.abs(bounded))).alias("bounded_mae"),
        shown(F.avg(bounded)).alias("bounded_bias"),
        F.coalesce(F.sum(outside), F.lit(0.0)).cast("long").alias("n_out_of_range"),
        shown(F.avg(outside) * 100).alias("out_of_range_pct"),
        F.count_if(~finite(F.col("prediction"))).alias("n_non_finite"),
        F.count("*").alias("n_total"),
    )
    return sums


def positive_rank(scored: DataFrame, *by: str) -> DataFrame:
    """(by, user_id, rank) of the positive, from (by, user_id, pos, is_positive, score): equal scores keep their order."""
    keys = [*by, "user_id"]
    own = Window.partitionBy(*keys)
    marked = scored.withColumn("s", F.max(F.when(F.col("is_positive"), F.col("score"))).over(own)).withColumn("p", F.max(F.when(F.col("is_positive"), F.col("pos"))).over(own))
    ahead = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("pos") < F.col("p")))
    return marked.groupBy(*keys).agg((F.sum(ahead.cast("int")) + 1).cast("int").alias("rank"))


def ranking_metrics(ranks: DataFrame, cutoff: int, candidates: int, *by: str) -> DataFrame:
    """Hit rate, NDCG and reciprocal rank at the cutoff, for one relevant item each."""
    k = min(cutoff, candidates)
    hit = (F.col("rank") <= k).cast("double")
    return ranks.groupBy(*by).agg(
        shown(F.avg(hit)).alias("hit_rate"),
        shown(F.avg(discount(F.col("rank"), k))).alias("ndcg"),
        shown(F.avg(F.when(F.col("rank") <= k, F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0)))).alias("mrr"),
        F.count("*").alias("n_evaluated"),
        F.lit(candidates).alias("n_candidates"),
        F.lit(cutoff).alias("k"),
    )
