"""Schemas of the inputs, and every parameter of the engine with its default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RATINGS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("ts", T.LongType()),
    ]
)
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
TAGS = T.StructType([T.StructField("tag_id", T.IntegerType()), T.StructField("tag", T.StringType())])
TAG_SCORES = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("tag_id", T.IntegerType()), T.StructField("relevance", T.DoubleType())])

#: The names of the stages and of their results, in the order in which reports show them.
STAGES = {
    "global_mean": "Global mean",
    "genre_content": "Genre content profile",
    "genome_content": "Tag Genome content profile",
    "user_knn": "User-based k-NN",
    "movie_knn": "Movie-based k-NN",
    "mf": "Biased MF",
    "bpr": "BPR-MF thresholded positives",
    "hybrid": "Tag Genome weighted hybrid",
    "mf_bpr": "MF+BPR hybrid",
}


@dataclass(frozen=True)
class Params:
    min_history: int = 5
    relevance: float = 3.5
    low: float = 0.5
    high: float = 5.0
    item_neighbors: int = 40
    user_neighbors: int = 40
    min_common: int = 2
    shrinkage: float = 10.0
    ranking_users: int = 500
    candidates: int = 1000
    cutoff: int = 10
    validation_seed: int = 2025
    test_seed: int = 2026
    baseline_seed: int = 42
    tags: int = 1128
    grid_steps: int = 10
    tolerance: float = 1e-12
    factors: int = 50
    epochs: int = 20
    mf_rate: float = 0.005
    mf_scale: float = 0.1
    mf_grid: tuple[float, ...] = (0.02, 0.05)
    bpr_rate: float = 0.01
    bpr_scale: float = 0.01
    bpr_grid: tuple[float, ...] = (0.0025, 0.01)
    bpr_negatives: int = 4
    bpr_in_blocks: bool = False
    monitored: int = 2000
    seed: int = 42


#: For the test tables, of whose items a few hundred have dense vectors: fewer than the default number of candidates.
SMALL = Params(candidates=100)
