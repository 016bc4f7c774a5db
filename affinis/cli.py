"""Command line: derive the tables of a run, train its models, and leave the results of some stages in a folder."""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import content, prepare as P
from affinis.operators.validate import require, same_metadata
from affinis.plans import stages as S
from affinis.plans.workspace import Workspace
from affinis.schema import SMALL, STAGES, Params
from affinis.sources import ratings as source
from affinis.sources.artifacts import Artifacts, merge_results

#: The trained models that a stage needs.
MODELS = {"mf": ("mf",), "bpr": ("bpr",), "mf_bpr": ("mf", "bpr")}


def csv_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The caller's ratings.csv, movies.csv, genome-tags.csv and genome-scores.csv as tables of a workspace."""
    tags = source.tag_index(source.read_tags(spark, f"{folder}/genome-tags.csv"))
    scores = source.read_tag_scores(spark, f"{folder}/genome-scores.csv").join(F.broadcast(tags.select("tag_id", "place")), "tag_id")
    vectors = content.dense_features(scores.select("item_id", F.col("place").alias("tag_id"), "relevance"))
    return {"ratings": source.read_ratings(spark, f"{folder}/ratings.csv"), "items": source.read_items(spark, f"{folder}/movies.csv"), "vectors": vectors}


def configure(store: Artifacts, configuration: dict, restart: bool) -> None:
    """A folder holds one configuration: another one raises, unless the run starts anew and leaves what is there unused."""
    stored = store.read_meta("configuration")
    differ = same_metadata(stored, configuration) if stored is not None else []
    if differ and not restart:
        raise ValueError(f"{store.path} has results of another configuration: {', '.join(differ)}")
    if stored is None or differ:
        store.write_meta("configuration", configuration)


def prepare(w: Workspace, store: Artifacts) -> None:
    """Write what later runs and readers need; refuses data that fail a check."""
    require(w.quality())
    store.write("interactions", w.splits, "split")
    for key in ("user_id", "item_id"):  # the training ratings in both orientations, each key's rows together
        store.write(f"train_by_{key[:4]}", w.train.repartitionByRange(key).sortWithinPartitions(key))
        store.write(f"presence_{key[:4]}", P.presence(w.train, w.splits, key))
    store.write("user_stats", w.user_means)
    store.write("item_stats", w.item_means)
    store.write("features_genre", content.align(w.genre_features, w.splits))
    store.write("features_dense", content.align(w.vectors, w.splits))
    store.write("profiles_genre", w.profiles("genre"))
    store.write("profiles_dense", w.packed_profiles)
    store.write("item_similarity", w.item_graph)
    for split in ("validation", "test"):
        store.write(f"candidates_{split}", w.candidates(split))
    store.write("metadata", w.metadata())


def trained(w: Workspace, store: Artifacts, model: str, fresh: bool) -> tuple[DataFrame, float]:
    """The factors of a model, read if they are there and of the same shape, else trained; and the seconds that this took."""
    users, items = w.train.select("user_id").distinct().count(), w.train.select("item_id").distinct().count()
    found, took = (None if fresh else store.read_factors(model, users, items)), 0.0
    if found is None:
        _, took = S.timed(lambda: store.write_factors(model, w.train_model(model), users, items))
        store.write_meta(f"factors_{model}_seconds", {"train": took})
        found = store.read_factors(model, users, items)
    return found, (store.read_meta(f"factors_{model}_seconds") or {}).get("train", took)


def run_stage(w: Workspace, store: Artifacts, stage: str, fresh: bool = False) -> DataFrame:
    """Predictions, neighbour counts, scores, sidecar and results of a stage; what is in the folder is not made again, unless ``fresh``."""
    seconds = {"train": 0.0}
    for model in MODELS.get(stage, ()):
        if model not in w.models:
            w.models[model], took = trained(w, store, model, fresh)
            seconds["train"] += took
    one = S.REGISTRY[stage]
    if fresh or store.read_stage("predictions", stage) is None:
        rated = one.rated(w)
        _, seconds["predict"] = S.timed(lambda: store.write_stage("predictions", stage, rated))
        if "n_neighbors" in rated.columns:
            store.write_stage("counts", stage, store.read_stage("predictions", stage).select("user_id", "item_id", "n_neighbors"))
    if fresh or store.read_stage("scores", stage) is None:
        _, seconds["rank"] = S.timed(lambda: store.write_stage("scores", stage, one.scores(w)))
    if fresh or store.read_stage("results", stage) is None:
        rows, scores = store.read_stage("predictions", stage), store.read_stage("scores", stage)
        rating = S.metrics.rating_metrics(rows, w.p.low, w.p.high)
        ranking = S.metrics.ranking_metrics(S.metrics.positive_rank(scores), w.p.cutoff, w.p.candidates)
        found = rating.crossJoin(F.broadcast(ranking)).select(F.lit(stage).alias("stage"), F.lit(one.name).alias("name"), "*")
        store.write_stage("results", stage, found.where(F.col("n_non_finite") == 0))
        store.write_meta(f"meta_{stage}", {"seconds": seconds, "weights": weights(w, stage)})
    return store.read_stage("results", stage)


def weights(w: Workspace, stage: str) -> dict[str, float]:
    """What a stage has fitted on the validation split, by name."""
    fitted = {
        "genre_content": lambda: {"beta": w.beta("genre")},
        "genome_content": lambda: {"beta": w.beta("tag")},
        "bpr": lambda: {"slope": w.affine.select("slope"), "intercept": w.affine.select("intercept")},
        "hybrid": lambda: {"alpha": w.alpha.select("alpha")},
        "mf_bpr": lambda: {"lambda_rating": w.rating_lambda.select("lam"), "lambda_ranking": w.ranking_lambda.select("lam")},
    }
    return {name: df.first()[0] for name, df in fitted.get(stage, dict)().items()}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True, help="folder of the input tables, or with --csv of ratings.csv, movies.csv, genome-tags.csv and genome-scores.csv")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--csv", action="store_true")
    parser.add_argument("--stages", nargs="*", choices=list(S.REGISTRY), default=list(STAGES))
    parser.add_argument("--full-size", action="store_true", help="1000 candidates for each ranking user, not 100")
    parser.add_argument("--bpr-blocks", action="store_true", help="train bpr in blocks of users, for ratings that are too many for a task")
    parser.add_argument("--merge", action="store_true", help="only put together the results of earlier runs")
    parser.add_argument("--restart", action="store_true", help="make everything anew, also under another configuration")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("affinis").getOrCreate()
    store = Artifacts(spark, given.out)
    if not given.merge:
        params = replace(Params() if given.full_size else SMALL, bpr_in_blocks=given.bpr_blocks)
        plain = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(params).items()}
        configure(store, {"data": given.data, "csv": given.csv, **plain}, given.restart)
        w = Workspace(spark, given.data, params, catalog=True, tables=csv_tables(spark, given.data) if given.csv else None)
        prepare(w, store)
        if "hybrid" in given.stages:  # the components of its weight are kept for later runs
            parts = None if given.restart else store.read("components_hybrid")
            if parts is None:
                store.write("components_hybrid", w.held_components)
                parts = store.read("components_hybrid")
            w.tables["components"] = parts
            w.__dict__.pop("held_components", None)
        for stage in given.stages:
            run_stage(w, store, stage, given.restart)
        w.release()
    parts = [p for s in S.REGISTRY if (p := store.read_stage("results", s)) is not None]
    if parts:
        every = parts[0].withColumn("part", F.lit(0))
        for k, part in enumerate(parts[1:]):
            every = every.unionByName(part.withColumn("part", F.lit(k + 1)))
        store.write("results_merged", merge_results(every).orderBy("stage"))
        store.write("timings", store.timings(list(S.REGISTRY)))
        store.read("results_merged").show(truncate=False)


if __name__ == "__main__":
    main()
