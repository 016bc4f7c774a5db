"""Stages: what predicts ratings and scores candidates, the built-in ones and those of a caller, and how one is run.

A scorer takes a workspace and pairs (user_id, item_id) and returns (user_id, item_id, prediction); more columns, such
as n_neighbors, may follow. Plans of joins and column expressions are the fast kind; ``row_map``, ``row_count`` and
``per_user`` make scorers of functions over Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from affinis.functions.workers import send_package
from affinis.operators import metrics
from affinis.plans.workspace import Workspace
from affinis.schema import STAGES

Scorer = Callable[[Workspace, DataFrame], DataFrame]


def row_map(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    """A scorer of a function that gets a batch of user ids and of item ids and returns a rating for each."""

    def score(w: Workspace, pairs: DataFrame) -> DataFrame:
        send_package(w.spark)
        return pairs.select("user_id", "item_id").withColumn("prediction", pandas_udf(function, "double")("user_id", "item_id"))

    return score


def row_count(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Workspace, DataFrame], DataFrame]:
    """As ``row_map``, of a function that returns a whole number for each pair: (user_id, item_id, n)."""

    def count(w: Workspace, pairs: DataFrame) -> DataFrame:
        send_package(w.spark)
        return pairs.select("user_id", "item_id").withColumn("n", pandas_udf(function, "int")("user_id", "item_id"))

    return count


def per_user(function: Callable[[int, np.ndarray], np.ndarray]) -> Scorer:
    """A scorer of a function that gets a user id and all item ids that are asked of that user, and returns a score for each."""

    def score(w: Workspace, pairs: DataFrame) -> DataFrame:
        send_package(w.spark)

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            found = function(int(rows["user_id"].iloc[0]), rows["item_id"].to_numpy())
            return rows.assign(prediction=np.asarray(found, float))

        return pairs.select("user_id", "item_id").groupBy("user_id").applyInPandas(one, "user_id long, item_id long, prediction double")

    return score


@dataclass(frozen=True)
class Stage:
    """``rate`` predicts held-out ratings; ``rank`` scores candidates, as ``rate`` does if it is None."""

    name: str
    rate: Scorer
    rank: Scorer | None = None

    def rated(self, w: Workspace, split: str = "test") -> DataFrame:
        """(user_id, item_id, rating, prediction, ...) of a split."""
        rows = w.split(split)
        return rows.join(self.rate(w, rows), ["user_id", "item_id"])

    def scores(self, w: Workspace, split: str = "test") -> DataFrame:
        """(user_id, pos, item_id, is_positive, score) of the candidates."""
        rows = w.candidates(split)
        found = (self.rank or self.rate)(w, rows).select("user_id", "item_id", F.col("prediction").alias("score"))
        return rows.join(found, ["user_id", "item_id"]).select("user_id", "pos", "item_id", "is_positive", "score")


class BuiltIn(Stage):
    """A stage of the engine: its plans are the workspace's."""

    def __init__(self, key: str) -> None:
        super().__init__(STAGES[key], lambda w, pairs: w.predict(key, pairs))
        object.__setattr__(self, "key", key)

    def rated(self, w: Workspace, split: str = "test") -> DataFrame:
        return w.counted(self.key, split)

    def scores(self, w: Workspace, split: str = "test") -> DataFrame:
        return w.rank_scores(self.key, split)


#: All stages by key, in the order in which reports show them; callers may add theirs.
REGISTRY: dict[str, Stage] = {key: BuiltIn(key) for key in STAGES}


def rating_metrics(w: Workspace, stage: Stage) -> DataFrame:
    return metrics.rating_metrics(stage.rated(w).select("rating", "prediction"), w.p.low, w.p.high)


def ranking_metrics(w: Workspace, stage: Stage) -> DataFrame:
    return metrics.ranking_metrics(metrics.positive_rank(stage.scores(w)), w.p.cutoff, w.p.candidates)


def timed(action: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    found = action()
    return found, time.perf_counter() - began
