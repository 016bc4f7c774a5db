"""Content profiles: item features, users' signed centroids, and the scale of their likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import dot, safe_div, steady
from affinis.operators.prepare import centered

EPS = 2.220446049250313e-16


def multi_hot(items: DataFrame) -> DataFrame:
    """(item_id, feature, x) of the distinct names in the |-separated ``genres``."""
    names = F.array_distinct(F.split("genres", "[|]"))
    return items.select("item_id", F.explode(names).alias("feature")).where("feature <> ''").withColumn("x", F.lit(1.0))


def unknown_names(items: DataFrame, known: DataFrame) -> DataFrame:
    """(feature, n): names that are not in ``known`` (feature)."""
    return multi_hot(items).join(known.select("feature"), "feature", "left_anti").groupBy("feature").agg(F.count("*").alias("n"))


def dense_features(scores: DataFrame) -> DataFrame:
    """(item_id, vector) from (item_id, tag_id, relevance), in the order of the tags."""
    pairs = F.array_sort(F.collect_list(F.struct("tag_id", "relevance")))
    return scores.groupBy("item_id").agg(F.transform(pairs, lambda p: p["relevance"]).alias("vector"))


def completeness(scores: DataFrame) -> DataFrame:
    """(item_id, n, n_tags, n_bad): rows, distinct tags and values outside [-1, 1] of each item."""
    bad = ~((F.col("relevance") >= -1) & (F.col("relevance") <= 1))
    return scores.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("tag_id").alias("n_tags"), F.sum(bad.cast("int")).alias("n_bad"))


def as_long(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", F.posexplode("vector").alias("feature", "x"))


def align(features: DataFrame, items: DataFrame) -> DataFrame:
    """The features of the items that are in use (item_id)."""
    return features.join(items.select("item_id").distinct(), "item_id", "left_semi")


def missing(features: DataFrame, items: DataFrame) -> DataFrame:
    """Items in use without features: must be empty."""
    return items.select("item_id").distinct().join(features.select("item_id").distinct(), "item_id", "left_anti")


def normalize(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values over the root of their squares' sum by key; rows of zeros stay zeros."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return rows.withColumn(value, safe_div(F.col(value), norm))


def profiles(train: DataFrame, features: DataFrame) -> DataFrame:
    """(user_id, feature, w): sums of features weighted by the centred ratings, of length 1 or 0.

    Residuals are those of all of a user's ratings; ``features`` has normalised rows.
    """
    sums = centered(train).join(features, "item_id").groupBy("user_id", "feature").agg(F.sum(F.col("residual") * F.col("x")).alias("w"))
    # what cancels out exactly in one order of summation must be zero in every other
    return normalize(sums.withColumn("w", steady(F.col("w"))), "user_id", "w")


def likeness(pairs: DataFrame, profile: DataFrame, features: DataFrame) -> DataFrame:
    """(user_id, item_id, cosine) of each pair; 0 without common features."""
    met = pairs.select("user_id", "item_id").join(features, "item_id").join(profile, ["user_id", "feature"])
    sums = met.groupBy("user_id", "item_id").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    joined = pairs.select("user_id", "item_id").join(sums, ["user_id", "item_id"], "left")
    return joined.select("user_id", "item_id", steady(F.coalesce("s", F.lit(0.0))).alias("cosine"))


def unit(vector: Column) -> Column:
    """An array of length 1, or of zeros."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: safe_div(x, norm))


def packed(profile: DataFrame) -> DataFrame:
    """(user_id, profile array) of a profile on features numbered from 0, all of which each user has."""
    pairs = F.array_sort(F.collect_list(F.struct("feature", "w")))
    return profile.groupBy("user_id").agg(F.transform(pairs, lambda x: x["w"]).alias("profile"))


def dense_likeness(pairs: DataFrame, profile: DataFrame, vectors: DataFrame) -> DataFrame:
    """As ``likeness``, of packed profiles and whole vectors (item_id, vector): a row for each pair, not for each component."""
    rows = pairs.select("user_id", "item_id").join(vectors.select("item_id", unit(F.col("vector")).alias("v")), "item_id", "left").join(profile, "user_id", "left")
    return rows.select("user_id", "item_id", steady(F.coalesce(dot(F.col("profile"), F.col("v")), F.lit(0.0))).alias("cosine"))


def scale(scored: DataFrame) -> DataFrame:
    """(beta): the nonnegative factor of least squares for rating - mean on cosine. ``scored`` has rating, mean, cosine."""
    gain = F.sum(F.col("cosine") * (F.col("rating") - F.col("mean")))
    square = F.sum(F.col("cosine") * F.col("cosine"))
    sums = scored.agg(gain.alias("a"), square.alias("b"))
    return sums.select(steady(F.when(F.col("b") > EPS, F.greatest(F.lit(0.0), F.col("a") / F.col("b"))).otherwise(F.lit(0.0))).alias("beta"))


def predicted(mean: Column, beta: Column, cosine: Column) -> Column:
    return mean + beta * cosine
