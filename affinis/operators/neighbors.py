"""Predictions from neighbours. Both fall back to the item's mean where no neighbour says anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.prepare import centered
from affinis.operators.similarity import blocks_of, dealt, strongest


def user_knn_neighbors(pairs: DataFrame, train: DataFrame, similarity: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, nbr_id, sim, residual): of an item's raters the k most similar to the user."""
    raters, hot = centered(train).select("item_id", F.col("user_id").alias("nbr_id"), "residual"), blocks_of(train, "item_id")
    asked = dealt(pairs.select("user_id", "item_id").distinct(), "item_id", hot, "i", "j", "user_id")
    met = asked.join(dealt(raters, "item_id", hot, "j", "i", "nbr_id"), ["item_id", "i", "j"]).drop("i", "j").join(similarity.select("user_id", "nbr_id", "sim"), ["user_id", "nbr_id"])
    return strongest(met, ["user_id", "item_id"], "nbr_id", k).select("user_id", "item_id", "nbr_id", "sim", "residual")


def item_knn_neighbors(pairs: DataFrame, train: DataFrame, graph: DataFrame) -> DataFrame:
    """(user_id, item_id, nbr_id, sim, residual): of an item's neighbours in the graph those that the user rated."""
    history = centered(train).select("user_id", F.col("item_id").alias("nbr_id"), "residual")
    near = graph.select("item_id", "nbr_id", "sim")
    return pairs.select("user_id", "item_id").distinct().join(near, "item_id").join(history, ["user_id", "nbr_id"]).select("user_id", "item_id", "nbr_id", "sim", "residual")


def weighted(pairs: DataFrame, neighbors: DataFrame, user_means: DataFrame, item_means: DataFrame) -> DataFrame:
    """(user_id, item_id, prediction, n_neighbors): the user's mean plus the weighted mean of residuals."""
    sums = neighbors.groupBy("user_id", "item_id").agg(F.sum(F.col("sim") * F.col("residual")).alias("a"), F.sum(F.abs("sim")).alias("b"), F.count("*").alias("n"))
    joined = pairs.select("user_id", "item_id").join(sums, ["user_id", "item_id"], "left")
    joined = joined.join(user_means.select("user_id", F.col("mean").alias("u")), "user_id").join(item_means.select("item_id", F.col("mean").alias("i")), "item_id")
    use = F.col("b") > 0
    prediction = F.when(use, F.col("u") + F.col("a") / F.col("b")).otherwise(F.col("i"))
    return joined.select("user_id", "item_id", prediction.alias("prediction"), F.when(use, F.col("n")).otherwise(F.lit(0)).cast("int").alias("n_neighbors"))
