"""From ratings to splits, means and centred ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_catalog(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ratings of the items in ``catalog`` (item_id). Spark broadcasts the catalogue if it is small enough."""
    return ratings.join(catalog.select("item_id"), "item_id", "left_semi")


def filter_min_history(ratings: DataFrame, least: int) -> DataFrame:
    """Ratings of users who have at least ``least``. The window's partitioning by user serves the split as well."""
    return ratings.withColumn("n_user", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("n_user") >= least).drop("n_user")


def user_activity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count("*").alias("n"))


def chronological_split(ratings: DataFrame) -> DataFrame:
    """Adds split: each user's last rating is ``test``, the one before ``validation``; ties go by item."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    nth = F.row_number().over(last)
    return ratings.withColumn("split", F.when(nth == 1, "test").when(nth == 2, "validation").otherwise("train"))


def range_ends(distinct: DataFrame, column: str, buckets: int, drawn: int = 4096) -> DataFrame:
    """(ends), one row: ends of about equal ranges of distinct ids, from those ``drawn`` of them that have the smallest hashes.

    They depend on the ids alone and not on the order in which tasks finish, so every part of a plan has the same ones;
    quantiles merged from sketches differ from one reading of a plan to the next.
    """
    few = distinct.select(column).orderBy(F.xxhash64(column), column).limit(drawn)
    placed = few.agg(F.sort_array(F.collect_list(column)).alias("ids")).withColumn("step", F.greatest(F.lit(1), F.ceil(F.size("ids") / F.lit(buckets)).cast("int")))
    return placed.select(F.filter("ids", lambda x, k: (k + 1) % F.col("step") == 0).alias("ends"))


def dense_ids(ids: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """(column, dense_id): places of the distinct ids in order, from 0, without sorting all in one task.

    Ids are cut into ranges at about their quantiles, so wherever they lie no range has many more than another; a place is the
    count of all ranges before, plus that within.
    """
    distinct = ids.select(column).where(F.col(column).isNotNull()).distinct()
    ends = range_ends(distinct, column, buckets)
    bucket = F.size(F.filter("ends", lambda x: x < F.col(column)))
    placed = distinct.crossJoin(F.broadcast(ends)).select(column, bucket.alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # at most ``buckets`` rows
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(column)) - 1
    return placed.join(F.broadcast(offsets), "bucket").select(column, (F.col("before") + nth).cast("int").alias("dense_id"))


def dense_remap(ratings: DataFrame) -> DataFrame:
    """Adds user_dense and item_dense."""
    users = dense_ids(ratings, "user_id").withColumnRenamed("dense_id", "user_dense")
    items = dense_ids(ratings, "item_id").withColumnRenamed("dense_id", "item_dense")
    return ratings.join(users, "user_id").join(items, "item_id")


def block_bounds(ratings: DataFrame, blocks: int) -> DataFrame:
    """(block, first_user, last_user, n): contiguous users with nearly equal numbers of ratings."""
    per = user_activity(ratings)
    ends = per.agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.sum("n").alias("total"))
    coarse = F.floor((F.col("user_id") - F.col("lo")) * F.lit(1024.0) / (F.col("hi") - F.col("lo") + 1)).cast("int")
    placed = per.crossJoin(F.broadcast(ends)).withColumn("coarse", coarse)
    counts = placed.groupBy("coarse").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("coarse", before.alias("before"))
    within = F.sum("n").over(Window.partitionBy("coarse").orderBy("user_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.join(F.broadcast(offsets), "coarse").withColumn("upto", F.col("before") + within)
    block = F.floor((F.col("upto") - 1) * blocks / F.col("total")).cast("int")
    return placed.withColumn("block", block).groupBy("block").agg(F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"), F.sum("n").alias("n"))


def global_mean(train: DataFrame) -> DataFrame:
    return train.agg(F.avg("rating").alias("mu"))


def means(train: DataFrame, key: str, universe: DataFrame) -> DataFrame:
    """(key, mean, n) for each id of ``universe``: the mean of its training ratings, or of all if it has none."""
    per = train.groupBy(key).agg(F.avg("rating").alias("m"), F.count("*").alias("c"))
    joined = universe.select(key).distinct().join(per, key, "left").crossJoin(F.broadcast(global_mean(train)))
    return joined.select(key, F.coalesce("m", "mu").alias("mean"), F.coalesce("c", F.lit(0)).alias("n"))


def centered(train: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, residual): less the user's mean."""
    mean = F.avg("rating").over(Window.partitionBy("user_id"))
    return train.select("user_id", "item_id", "rating", (F.col("rating") - mean).alias("residual"))


def presence(train: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    seen = train.select(key).distinct().withColumn("seen", F.lit(True))
    return universe.select(key).distinct().join(seen, key, "left").select(key, F.coalesce("seen", F.lit(False)).alias("seen"))
