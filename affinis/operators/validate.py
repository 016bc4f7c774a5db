"""Checks, each a row (check, violations); strict callers raise on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import finite


def count_bad(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass over ``rows`` for all checks."""
    sums = rows.agg(*[F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias(name) for name, bad in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("violations")) for name in checks])
    return sums.select(F.explode(pairs).alias("x")).select("x.check", F.col("x.violations").cast("long").alias("violations"))


def number_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def ratings(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Domains of the ratings."""
    checks = {
        "rating_not_finite": ~finite(F.col("rating")),
        "rating_out_of_range": ~F.coalesce(F.col("rating").between(low, high), F.lit(False)),
        "user_id_negative": F.coalesce(F.col("user_id") < 0, F.lit(True)),
        "item_id_negative": F.coalesce(F.col("item_id") < 0, F.lit(True)),
        "ts_missing": F.col("ts").isNull(),
    }
    empty = rows.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("violations")).select(F.lit("no_ratings").alias("check"), "violations")
    return count_bad(rows, checks).unionByName(empty)


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """(user_id, item_id, n) of pairs that are there more than once."""
    return rows.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def candidates(rows: DataFrame) -> DataFrame:
    """One positive in each user's row, and no item twice."""
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d"), F.sum(F.col("is_positive").cast("int")).alias("p"), F.max("pos").alias("last"))
    return count_bad(per, {"candidates_repeated": F.col("n") != F.col("d"), "not_one_positive": F.col("p") != 1, "positions_with_gaps": F.col("last") + 1 != F.col("n")})


def same_metadata(stored: dict, current: dict) -> list[str]:
    """Names of values that differ, numbers by more than 1e-12."""

    def same(a, b) -> bool:
        number = (int, float)
        return abs(a - b) <= 1e-12 if isinstance(a, number) and isinstance(b, number) else a == b

    return sorted(k for k in {*stored, *current} if k not in stored or k not in current or not same(stored[k], current[k]))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(checks: DataFrame) -> None:
    """Raise if any check has violations."""
    bad = checks.where("violations > 0").orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))
