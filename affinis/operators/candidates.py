"""Sampled ranking candidates: one relevant held-out item among unobserved ones, by reproducible shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import shuffled
from affinis.operators.prepare import dense_ids


#: Makes a table that several plans read once.
Keep = Callable[[DataFrame], DataFrame]


def relevant_heldout(heldout: DataFrame, train: DataFrame, relevance: float) -> DataFrame:
    """Held-out ratings of at least ``relevance`` whose item is in the training data."""
    return heldout.where(F.col("rating") >= relevance).join(train.select("item_id").distinct(), "item_id", "left_semi")


def known_items(splits: DataFrame) -> DataFrame:
    """(user_id, item_id) of every split."""
    return splits.select("user_id", "item_id").distinct()


def ranking_users(heldout: DataFrame, train: DataFrame, known: DataFrame, relevance: float, users: int, candidates: int, seed: int) -> DataFrame:
    """(user_id, positive): the first ``users`` in a shuffle of those with enough unobserved items. Of ``train`` only the items matter.

    Who knows few items at all has enough; only of the others are those counted that are in the catalogue.
    """
    catalog = train.select("item_id").distinct()
    size = catalog.agg(F.count("*").alias("size"))
    counts = known.groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(size)).withColumn("enough", F.col("size") - F.col("n") >= candidates - 1)
    doubtful = counts.where("NOT enough").select("user_id", "size")
    observed = known.join(doubtful.select("user_id"), "user_id", "left_semi").join(catalog, "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("observed"))
    others = doubtful.join(observed, "user_id").where(F.col("size") - F.col("observed") >= candidates - 1)
    room = counts.where("enough").select("user_id").unionByName(others.select("user_id"))
    viable = relevant_heldout(heldout, train, relevance).join(room, "user_id")
    order = [shuffled(F.lit(seed), F.col("user_id"), F.lit("u")), F.col("user_id")]
    return viable.orderBy(*order).limit(users).select("user_id", F.col("item_id").alias("positive"))


def unobserved(users: DataFrame, train: DataFrame, known: DataFrame, few: bool = False) -> DataFrame:
    """(user_id, item_id): the catalogue without what each of the given users knows.

    Each of the users meets the whole catalogue. They are broadcast if the caller knows that they are ``few``; else Spark
    broadcasts what its own threshold allows.
    """
    catalog, asked = train.select("item_id").distinct(), users.select("user_id")
    return catalog.crossJoin(F.broadcast(asked) if few else asked).join(known, ["user_id", "item_id"], "left_anti").select("user_id", "item_id")


def negatives(free: DataFrame, n: int, seed: int) -> DataFrame:
    """The first ``n`` of each user's unobserved items in a shuffle."""
    order = Window.partitionBy("user_id").orderBy(shuffled(F.lit(seed), F.col("user_id"), F.col("item_id")), "item_id")
    return free.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("user_id", "item_id")


def drawn_negatives(users: DataFrame, train: DataFrame, known: DataFrame, n: int, seed: int, keep: Keep = lambda df: df) -> DataFrame:
    """As ``negatives`` of ``unobserved``, without sorting the users times the catalogue.

    Only hashes below a bound that lets some 2 n + 64 of a user's free items through are kept as items and users meet; users
    of whom fewer than n are below it (a chance of about 1e-12 at most) get the rest as well. ``users`` are broadcast.
    """
    catalog = train.select("item_id").distinct().repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    asked = users.select("user_id").distinct()
    own = known.join(F.broadcast(asked), "user_id", "left_semi")
    size = train.agg(F.countDistinct("item_id").alias("size"))
    observed = own.groupBy("user_id").agg(F.count("*").alias("observed"))
    share = F.lit(2.0 * n + 64) / F.greatest(F.lit(1), F.col("size") - F.coalesce("observed", F.lit(0)))
    bound = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex((share * F.lit(float(1 << 52))).cast("long"))), 13, "0"))
    bounds = keep(asked.join(observed, "user_id", "left").crossJoin(F.broadcast(size)).select("user_id", bound.alias("bound")))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("item_id").cast("string")).cast("binary"))

    def free(some: DataFrame, below: bool) -> DataFrame:
        met = catalog.crossJoin(F.broadcast(some)).where(order < F.col("bound") if below else order >= F.col("bound"))
        return met.select("user_id", "item_id").join(F.broadcast(own), ["user_id", "item_id"], "left_anti")

    first = keep(free(bounds, True))
    counts = first.groupBy("user_id").agg(F.count("*").alias("n"))
    short = bounds.where("bound <> 'g'").join(counts, "user_id", "left").where(F.coalesce("n", F.lit(0)) < n).select("user_id", "bound")
    return negatives(first.unionByName(free(short, False)), n, seed)


def candidates(users: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """(user_id, pos, item_id, is_positive): the positive and the negatives, shuffled."""
    rows = users.select("user_id", F.col("positive").alias("item_id"), F.lit(True).alias("is_positive")).unionByName(drawn.withColumn("is_positive", F.lit(False)))
    order = Window.partitionBy("user_id").orderBy(shuffled(F.lit(seed), F.lit("p"), F.col("user_id"), F.col("item_id")), "item_id")
    return rows.select("user_id", (F.row_number().over(order) - 1).alias("pos"), "item_id", "is_positive")


def build(heldout: DataFrame, train: DataFrame, known: DataFrame, relevance: float, users: int, n: int, seed: int, keep: Keep = lambda df: df) -> DataFrame:
    if users <= 0 or n < 2:
        raise ValueError("users must be positive, and there must be two candidates at least")
    chosen = keep(ranking_users(heldout, train, known, relevance, users, n, seed))
    return candidates(chosen, drawn_negatives(chosen, train, known, n - 1, seed, keep), seed)


def bpr_negatives(positives: DataFrame, train: DataFrame, seed: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, item_id, *more, negative): for each positive one item of the catalogue that the user has not rated.

    Rows of ``positives`` that differ in the columns ``more`` have draws of their own.

    Draws are a chain of hashed places in the catalogue, up to DRAWS of them; the first that is free is taken.
    Where the chain has no free one, it is the first of all the user's unrated items in a shuffle; only a user who
    has rated everything has no row.
    """
    key = ["user_id", "item_id", *more]
    catalog = train.select("item_id").distinct()
    placed = dense_ids(catalog, "item_id").select(F.col("item_id").alias("negative"), F.col("dense_id").alias("place"))
    size = catalog.agg(F.count("*").alias("size"))

    def drawn_place(draw: Column) -> Column:
        return (F.conv(F.substring(shuffled(F.lit(seed), *map(F.col, key), draw), 1, 12), 16, 10).cast("bigint") % F.col("size")).cast("int")

    def tried(rows: DataFrame) -> DataFrame:
        """Adds negative, and taken where the user has rated it."""
        return rows.join(placed, "place").join(taken, ["user_id", "negative"], "left")

    taken = train.select("user_id", F.col("item_id").alias("negative"), F.lit(True).alias("taken"))
    # nearly every first draw is free: only where it is not are the others made
    first = tried(positives.select(*key).crossJoin(F.broadcast(size)).withColumn("place", drawn_place(F.lit(0))))
    first = first.groupBy(*key).agg(F.min("size").alias("size"), F.min("negative").alias("negative"), F.max("taken").alias("taken"))
    again = first.where("taken").select(*key, "size", F.explode(F.sequence(F.lit(1), F.lit(DRAWS - 1))).alias("draw"))
    again = tried(again.withColumn("place", drawn_place(F.col("draw"))))
    chains = again.groupBy(*key).agg(F.min(F.when(F.col("taken").isNull(), F.struct("draw", "negative"))).alias("x"))
    at_once = first.where("taken IS NULL").select(*key, "negative")
    drawn = chains.where("x IS NOT NULL").select(*key, F.col("x.negative").alias("negative"))
    left = chains.where("x IS NULL").select(*key)
    free = unobserved(left.select("user_id").distinct(), train, train.select("user_id", "item_id")).withColumnRenamed("item_id", "negative")
    order = F.struct(shuffled(F.lit(seed), *map(F.col, key), F.lit("f"), F.col("negative")).alias("by"), "negative")
    scanned = left.join(free, "user_id").groupBy(*key).agg(F.min(order).alias("x")).select(*key, F.col("x.negative").alias("negative"))
    return at_once.unionByName(drawn).unionByName(scanned)


DRAWS = 8
