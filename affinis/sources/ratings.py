"""Sources: rating views over the test tables, and readers of the CSV files with their header checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bought(spark: SparkSession, sf_dir: str, catalog: DataFrame | None = None, part: DataFrame | None = None) -> DataFrame:
    """Lines with their orders. ``catalog`` (item_id): only lines of these items, before they meet anything else; ``part`` (l_partkey, ...) adds columns."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if catalog is not None:
        line = line.join(catalog.select(F.col("item_id").alias("l_partkey")), "l_partkey", "left_semi")
    if part is not None:
        line = line.join(part, "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def noise_ratings(spark: SparkSession, sf_dir: str, catalog: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, rating, ts) without any signal: quantities as half stars."""
    rating = F.ceil(F.avg("l_quantity") / 5) / F.lit(2.0)
    grouped = _bought(spark, sf_dir, catalog).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    return grouped.agg(rating.alias("rating"), _seconds(F.max("o_orderdate")).alias("ts"))


def planted_ratings(spark: SparkSession, sf_dir: str, catalog: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, rating, ts) in which users like the brands whose number is theirs modulo 5.

    Lines meet their items first and are then dealt by user, which serves the sums and whatever is asked of users after them.
    """
    part = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.max("p_brand").alias("brand"))
    part = part.select("l_partkey", F.substring("brand", 7, 10).cast("int").alias("brand"))
    lines = _bought(spark, sf_dir, catalog, part).repartition("o_custkey")
    sums = lines.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_quantity").alias("q"), F.max("brand").alias("brand"), _seconds(F.max("o_orderdate")).alias("ts"))
    likes = F.col("user_id") % 5 == F.col("brand") % 5
    rating = F.least(F.lit(5.0), F.lit(1.0) + F.when(likes, F.lit(2.5)).otherwise(F.lit(0.0)) + F.lit(0.5) * (F.col("q").cast("int") % 4))
    return sums.select("user_id", "item_id", rating.alias("rating"), "ts")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genres): words of the name, type and brand take the part of genres."""
    names = F.concat_ws("|", F.replace("p_name", F.lit(" "), F.lit("|")), "p_type", "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), names.alias("genres"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, vector array<double>)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))


def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag_id, relevance), long: the vectors' components take the part of tags."""
    return dense_vectors(spark, sf_dir).select("item_id", F.posexplode("vector").alias("tag_id", "relevance"))


def read_csv(spark: SparkSession, path: str, of: T.StructType, header: list[str] | None) -> DataFrame:
    """Read with a fixed schema. With ``header``, the files' first line must be exactly that."""
    if header is not None:
        first = spark.read.text(path).limit(1).collect()
        got = first[0][0].split(",") if first else []
        if got != header:
            raise ValueError(f"{path}: header {got}, not {header}")
    return spark.read.csv(path, schema=of, header=True, mode="FAILFAST", enforceSchema=True)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.RATINGS, None)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.ITEMS, ["movieId", "title", "genres"])


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.TAGS, ["tagId", "tag"])


def tag_index(tags: DataFrame) -> DataFrame:
    """(tag_id, tag, place): the tags' places from 0 in the order of the file, a dictionary of some thousand rows."""
    ordered = tags.select("tag_id", "tag", F.monotonically_increasing_id().alias("row"))
    return ordered.select("tag_id", "tag", (F.row_number().over(Window.orderBy("row")) - 1).cast("int").alias("place"))


def read_tag_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.TAG_SCORES, ["movieId", "tagId", "relevance"])


def window_of_rows(ratings: DataFrame, offset: int, limit: int) -> DataFrame:
    """Some rows in source order, for development: ``ratings`` has src_pos."""
    if offset < 0 or limit <= 0:
        raise ValueError("offset must not be negative, and limit must be positive")
    return ratings.orderBy("src_pos").offset(offset).limit(limit)
