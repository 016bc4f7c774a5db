"""Scores of latent factors, and single steps of their trainers as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import dot, logistic, steady


def with_factors(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds p, pb, q, qb: factors and biases of user and item; null where a side is unseen.

    ``users``: (user_id, factors, bias), ``items``: (item_id, factors, bias).
    """
    p = users.select("user_id", F.col("factors").alias("p"), F.col("bias").alias("pb"))
    q = items.select("item_id", F.col("factors").alias("q"), F.col("bias").alias("qb"))
    return pairs.join(p, "user_id", "left").join(q, "item_id", "left")


def _dot() -> Column:
    return F.coalesce(dot(F.col("p"), F.col("q")), F.lit(0.0))


def mf_value() -> Column:
    """The prediction of a row with p, pb, q, qb and mu."""
    return steady(F.col("mu") + F.coalesce("pb", F.lit(0.0)) + F.coalesce("qb", F.lit(0.0)) + _dot())


def mf_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, mu: DataFrame) -> DataFrame:
    """Adds prediction: the mean, both biases and the product of the factors, each only where its side was trained."""
    both = with_factors(pairs, users, items).crossJoin(F.broadcast(mu))
    return both.withColumn("prediction", mf_value()).drop("p", "pb", "q", "qb", "mu")


def bpr_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds score: the product of the factors, 0 where a side was not trained."""
    return with_factors(pairs, users, items).withColumn("score", steady(_dot())).drop("p", "pb", "q", "qb")


def mf_step(train: DataFrame, users: DataFrame, items: DataFrame, mu: DataFrame, rate: float, reg: float) -> DataFrame:
    """(user_id, n, bias): users' biases after one full step of gradient descent from the given factors."""
    e = F.col("rating") - F.col("prediction")
    errors = mf_scores(train, users, items, mu).groupBy("user_id").agg(F.sum(steady(e)).alias("e"), F.count("*").alias("n"))
    joined = errors.join(users.select("user_id", F.col("bias").alias("b")), "user_id")
    return joined.select("user_id", "n", steady(F.col("b") + F.lit(rate) * (F.col("e") - F.lit(reg) * F.col("n") * F.col("b"))).alias("bias"))


def triples(positives: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, negative, margin): how far the user prefers the positive. ``positives``: (user_id, item_id, negative), which are made once."""
    up = with_factors(positives.select("user_id", "item_id", "negative"), users, items).withColumn("up", steady(_dot())).drop("pb", "q", "qb")
    other = items.select(F.col("item_id").alias("negative"), F.col("factors").alias("q"))
    return up.join(other, "negative", "left").select("user_id", "item_id", "negative", steady(F.col("up") - steady(_dot())).alias("margin"))


def bpr_gradients(positives: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, negative, gradient): the weight of each triple's update."""
    return triples(positives, users, items).select("user_id", "item_id", "negative", logistic(-F.col("margin")).alias("gradient"))
