"""All tables that a run derives from ratings, each a lazy plan that is built once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import shown, steady, uniform
from affinis.functions.workers import shared_folder
from affinis.operators import candidates as C
from affinis.operators import best, blocks, content, ensemble, factors, metrics, neighbors, prepare, raters, similarity, trainers, validate
from affinis.schema import SMALL, Params
from affinis.sources import ratings as source


#: Up to so many users or items (some 16 MB of ids) are broadcast.
BROADCAST_IDS = 1_000_000
#: Characters of a plan's text that Spark keeps for its listeners.
PLAN_CHARS = 50_000


class Workspace:
    """``catalog``: restrict to items with dense vectors. Tables with several readers are kept while memory or disk lasts.

    ``tables``: ratings (user_id, item_id, rating, ts), items (item_id, title, genres) and vectors (item_id, vector) of the
    caller, instead of the views over the test tables. ``models``: trained factors by model (mf, bpr), as the trainers
    return them for one regularisation, and without them the stand-ins. ``report``: several stages will be asked for; what
    is kept is then a table in the shared folder, made at once, as the plans of all stages in one outgrow the driver.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = SMALL, catalog: bool = False, noise: bool = False, tables: dict[str, DataFrame] | None = None, models: dict[str, DataFrame] | None = None, report: bool = False) -> None:
        self.spark, self.sf_dir, self.p, self.catalog, self.noise = spark, sf_dir, params, catalog, noise
        self.tables, self.models, self.report, self.kept = tables or {}, models or {}, report, []
        self.drawing = Lock()
        # kept tables stand in plans with the plans that made them, so texts of whole plans outgrow the driver
        if int(spark.conf.get("spark.sql.maxPlanStringLength", str(PLAN_CHARS + 1))) > PLAN_CHARS:
            spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))

    def keep(self, df: DataFrame) -> DataFrame:
        if self.report:
            return self.written(df)
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.kept[-1]

    def written(self, df: DataFrame) -> DataFrame:
        """The rows as a table in the shared folder, made at once: plans that read it do not have those that made it."""
        path = f"{shared_folder(self.spark)}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame) -> DataFrame:
        """In a report, ``keep``: a part of few rows that further plans need not compute again."""
        return self.keep(df) if self.report else df

    def release(self) -> None:
        """Give back what is kept; the workspace's tables still work, and are computed anew. Tables of a report stay, as results read them."""
        while self.kept:
            self.kept.pop().unpersist()

    # sources
    @cached_property
    def raw(self) -> DataFrame:
        if "ratings" in self.tables:
            return self.tables["ratings"]
        return self._source()(self.spark, self.sf_dir)

    def _source(self) -> Callable[..., DataFrame]:
        return source.noise_ratings if self.noise else source.planted_ratings

    @cached_property
    def items(self) -> DataFrame:
        return self.tables["items"] if "items" in self.tables else source.items(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.tables["vectors"] if "vectors" in self.tables else source.dense_vectors(self.spark, self.sf_dir)

    @cached_property
    def in_catalog(self) -> DataFrame:
        if not self.catalog or "ratings" in self.tables:
            return prepare.filter_catalog(self.raw, self.vectors) if self.catalog else self.raw
        # the test tables' lines are restricted before they are joined and summed
        ids = self.vectors.select("item_id")
        return self._source()(self.spark, self.sf_dir, F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids)

    # splits and means
    @cached_property
    def splits(self) -> DataFrame:
        return self.keep(prepare.chronological_split(prepare.filter_min_history(self.in_catalog, self.p.min_history)))

    def split(self, name: str) -> DataFrame:
        return self.splits.where(F.col("split") == name).select("user_id", "item_id", "rating")

    @cached_property
    def train(self) -> DataFrame:
        return self.split("train")

    @cached_property
    def mu(self) -> DataFrame:
        return self.settle(prepare.global_mean(self.train))

    @cached_property
    def user_means(self) -> DataFrame:
        return self.keep(prepare.means(self.train, "user_id", self.splits))

    @cached_property
    def item_means(self) -> DataFrame:
        return self.keep(prepare.means(self.train, "item_id", self.splits))

    @cached_property
    def catalogue(self) -> DataFrame:
        """(item_id, mean): the items of the training ratings."""
        return self.keep(self.train.groupBy("item_id").agg(F.avg("rating").alias("mean")))

    # content
    @cached_property
    def genre_features(self) -> DataFrame:
        return content.normalize(content.multi_hot(self.items), "item_id", "x")

    @cached_property
    def tag_features(self) -> DataFrame:
        return content.normalize(content.as_long(self.vectors), "item_id", "x")

    def features(self, kind: str) -> DataFrame:
        return self.genre_features if kind == "genre" else self.tag_features

    def profiles(self, kind: str) -> DataFrame:
        if kind not in self._profiles:
            self._profiles[kind] = self.keep(content.profiles(self.train, self.features(kind)))
        return self._profiles[kind]

    @cached_property
    def packed_profiles(self) -> DataFrame:
        return self.keep(content.packed(content.profiles(self.train, self.tag_features)))

    @cached_property
    def _profiles(self) -> dict[str, DataFrame]:
        return {}

    def cosines(self, pairs: DataFrame, kind: str) -> DataFrame:
        if kind == "tag":
            return content.dense_likeness(pairs, self.packed_profiles, self.vectors)
        return content.likeness(pairs, self.profiles(kind), self.features(kind))

    def beta(self, kind: str) -> DataFrame:
        if kind not in self._betas:
            rows = self.split("validation")
            scored = rows.join(self.cosines(rows, kind), ["user_id", "item_id"]).join(self.user_means.select("user_id", "mean"), "user_id")
            self._betas[kind] = self.settle(content.scale(scored))
        return self._betas[kind]

    @cached_property
    def _betas(self) -> dict[str, DataFrame]:
        return {}

    def content(self, pairs: DataFrame, kind: str) -> DataFrame:
        """(user_id, item_id, prediction)."""
        scored = self.cosines(pairs, kind).join(self.user_means.select("user_id", "mean"), "user_id").crossJoin(F.broadcast(self.beta(kind)))
        return scored.select("user_id", "item_id", steady(content.predicted(F.col("mean"), F.col("beta"), F.col("cosine"))).alias("prediction"))

    # neighbours
    @cached_property
    def item_edges(self) -> DataFrame:
        return similarity.item_similarity(self.train, self.p.min_common, self.p.shrinkage)

    @cached_property
    def item_graph(self) -> DataFrame:
        return self.keep(similarity.strongest(self.item_edges, ["item_id"], "nbr_id", self.p.item_neighbors))

    @cached_property
    def user_edges(self) -> DataFrame:
        return self.keep(similarity.user_similarity(self.train, self.p.min_common, self.p.shrinkage))

    def user_neighbors(self, pairs: DataFrame, k: int) -> DataFrame:
        """(user_id, item_id, nbr_id, sim, residual); only the raters of the pairs' items need similarities."""
        return raters.user_knn_neighbors(pairs, self.train, k, self.p.min_common, self.p.shrinkage)

    def user_knn(self, pairs: DataFrame, k: int | None = None) -> DataFrame:
        """(user_id, item_id, prediction, n_neighbors)."""
        found = self.user_neighbors(pairs, k or self.p.user_neighbors)
        return self._steady(neighbors.weighted(pairs, found, self.user_means, self.item_means))

    def item_knn(self, pairs: DataFrame) -> DataFrame:
        found = neighbors.item_knn_neighbors(pairs, self.train, self.item_graph)
        return self._steady(neighbors.weighted(pairs, found, self.user_means, self.item_means))

    def _steady(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", steady(F.col("prediction")))

    # candidates
    @cached_property
    def known(self) -> DataFrame:
        return C.known_items(self.splits)

    def seed(self, split: str) -> int:
        return {"validation": self.p.validation_seed, "test": self.p.test_seed}[split]

    def ranking_users(self, split: str) -> DataFrame:
        return C.ranking_users(self.split(split), self.catalogue, self.known, self.p.relevance, self.p.ranking_users, self.p.candidates, self.seed(split))

    def candidates(self, split: str) -> DataFrame:
        """(user_id, pos, item_id, is_positive)."""
        with self.drawing:  # what else runs may ask for the same
            if split not in self._candidates:
                self._candidates[split] = self.written(C.build(self.split(split), self.catalogue, self.known, self.p.relevance, self.p.ranking_users, self.p.candidates, self.seed(split), self.written))
        return self._candidates[split]

    @cached_property
    def _candidates(self) -> dict[str, DataFrame]:
        return {}

    # factors: trained ones, or fixed stand-ins for them, with which everything after training has an exact answer
    def stand_in(self, ids: DataFrame, key: str, shift: int, means: DataFrame | None) -> DataFrame:
        size = self.vectors.agg(F.count("*").alias("size"))
        place = ids.select(key).distinct().crossJoin(F.broadcast(size)).withColumn("place", (F.col(key) + shift) % F.col("size"))
        vectors = self.vectors.select(F.col("item_id").alias("place"), F.col("vector").alias("factors"))
        if means is None:
            return place.join(vectors, "place").select(key, "factors").withColumn("bias", F.lit(0.0))
        rows = place.join(means.select(key, "mean"), key).join(vectors, "place").crossJoin(F.broadcast(self.mu))  # vectors last: they move once
        return rows.select(key, "factors", steady(F.col("mean") - F.col("mu")).alias("bias"))

    def near(self, model: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(users, items) of a model for the ids of candidates alone, which are few whatever the data are."""
        return self._near(model, "users", "user_id", pairs), self._near(model, "items", "item_id", pairs)

    def _near(self, model: str, name: str, key: str, ids: DataFrame) -> DataFrame:
        few = F.broadcast(ids.select(key).distinct())
        if model in self.models:
            return self._side(model, name, key).join(few, key, "left_semi")
        shift = {"mf": (0, 0), "bpr": (1, 3)}[model][name == "items"]
        means = None if model == "bpr" else self.user_means if name == "users" else self.item_means
        return self.stand_in(self.train.select(key).join(few, key, "left_semi"), key, shift, means)

    def _side(self, model: str, name: str, key: str) -> DataFrame | None:
        return trainers.side(self.models[model], name, key) if model in self.models else None

    @cached_property
    def mf_users(self) -> DataFrame:
        return self._side("mf", "users", "user_id") or self.stand_in(self.train, "user_id", 0, self.user_means)

    @cached_property
    def mf_items(self) -> DataFrame:
        return self._side("mf", "items", "item_id") or self.stand_in(self.train, "item_id", 0, self.item_means)

    @cached_property
    def bpr_users(self) -> DataFrame:
        return self._side("bpr", "users", "user_id") or self.stand_in(self.train, "user_id", 1, None)

    @cached_property
    def bpr_items(self) -> DataFrame:
        return self._side("bpr", "items", "item_id") or self.stand_in(self.train, "item_id", 3, None)

    def bpr_blocks(self) -> DataFrame:
        """A model for each regularisation, of the trainer for data of any size."""
        return blocks.bpr_blocks(self.train, self.p)

    def train_model(self, model: str) -> DataFrame:
        """(reg, side, id, bias, factors, seen) of the regularisation that does best on the validation split."""
        if model == "mf":
            grid = self.keep(trainers.mf_grid(self.train, self.p))
            best = trainers.best_mf(trainers.mf_errors(grid, self.split("validation")))
        else:
            grid = self.bpr_blocks() if self.p.bpr_in_blocks else self.keep(trainers.bpr_grid(self.train, self.p))
            best = trainers.best_bpr(trainers.bpr_quality(grid, self.candidates("validation"), self.p.cutoff, self.p.candidates))
        return self.settle(grid.join(F.broadcast(best.select("reg")), "reg"))

    def mf(self, pairs: DataFrame) -> DataFrame:
        return factors.mf_scores(pairs.select("user_id", "item_id"), self.mf_users, self.mf_items, self.mu)

    def bpr(self, pairs: DataFrame) -> DataFrame:
        """(user_id, item_id, score)."""
        return factors.bpr_scores(pairs.select("user_id", "item_id"), self.bpr_users, self.bpr_items)

    @cached_property
    def held_scores(self) -> DataFrame:
        """(user_id, item_id, a, score): both factor models on both held-out splits. A report's weights and predictions all read these."""
        rows = self.mf(self.splits.where("split <> 'train'").select("user_id", "item_id").distinct()).withColumnRenamed("prediction", "a")
        return self.keep(factors.bpr_scores(rows, self.bpr_users, self.bpr_items))

    @cached_property
    def affine(self) -> DataFrame:
        rows = self.split("validation")
        scored = self.held_scores.drop("a") if self.report else self.bpr(rows)
        return self.settle(ensemble.affine(rows.join(scored, ["user_id", "item_id"])))

    def bpr_ratings(self, pairs: DataFrame) -> DataFrame:
        return self._mapped(self.bpr(pairs)).select("user_id", "item_id", F.col("b").alias("prediction"))

    def _mapped(self, scored: DataFrame) -> DataFrame:
        """Adds b: the score as a rating."""
        return scored.crossJoin(F.broadcast(self.affine)).withColumn("b", steady(F.col("slope") * F.col("score") + F.col("intercept")))

    # ensembles
    def components(self, pairs: DataFrame, kind: str = "tag") -> DataFrame:
        """(user_id, item_id, content, knn, n_neighbors)."""
        knn = self.user_knn(pairs).withColumnRenamed("prediction", "knn")
        return self.content(pairs, kind).withColumnRenamed("prediction", "content").join(knn, ["user_id", "item_id"])

    @cached_property
    def held_components(self) -> DataFrame:
        """The components of both held-out splits, of which one fits the weight and the other is predicted."""
        if "components" in self.tables:
            return self.tables["components"]
        return self.keep(self.components(self.splits.where("split <> 'train'").select("user_id", "item_id")))

    @cached_property
    def alpha_sweep(self) -> DataFrame:
        return self.settle(ensemble.alpha_sweep(self.split("validation").join(self.held_components, ["user_id", "item_id"]), self.p.grid_steps))

    @cached_property
    def alpha(self) -> DataFrame:
        return ensemble.best_alpha(self.alpha_sweep)

    def hybrid(self, pairs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """(user_id, item_id, prediction, n_neighbors); ``parts`` has the pairs' components, if they are known."""
        rows = (self.components(pairs) if parts is None else parts).crossJoin(F.broadcast(self.alpha.select("alpha")))
        return self._steady(ensemble.confident(rows, F.col("alpha"))).select("user_id", "item_id", "prediction", "n_neighbors")

    def hybrid_ranking(self, pairs: DataFrame) -> DataFrame:
        """As the ratings, but blended whether or not there are neighbours."""
        return self._blended(self.settle(self.components(pairs)))

    def _blended(self, parts: DataFrame) -> DataFrame:
        rows = parts.crossJoin(F.broadcast(self.alpha.select("alpha")))
        return rows.select("user_id", "item_id", steady(ensemble.blend(F.col("alpha"), F.col("content"), F.col("knn"))).alias("prediction"))

    def ranked_components(self, split: str) -> DataFrame:
        """The components of a split's candidates, made once in a report."""
        if split not in self._ranked:
            self._ranked[split] = self.settle(self.components(self.candidates(split)))
        return self._ranked[split]

    @cached_property
    def _ranked(self) -> dict[str, DataFrame]:
        return {}

    def held_ratings(self) -> DataFrame:
        """As ``two_ratings`` of both held-out splits."""
        return self._mapped(self.held_scores).select("user_id", "item_id", "a", "b")

    def two_ratings(self, pairs: DataFrame) -> DataFrame:
        """(user_id, item_id, a, b) of both factor models."""
        return self.mf(pairs).withColumnRenamed("prediction", "a").join(self.bpr_ratings(pairs).withColumnRenamed("prediction", "b"), ["user_id", "item_id"])

    @cached_property
    def rating_sweep(self) -> DataFrame:
        rows = self.split("validation")
        two = self.held_ratings() if self.report else self.two_ratings(rows)
        return self.settle(ensemble.rating_sweep(rows.join(two, ["user_id", "item_id"]), self.p.grid_steps))

    @cached_property
    def rating_lambda(self) -> DataFrame:
        return ensemble.best_rating_lambda(self.rating_sweep)

    def mf_bpr(self, pairs: DataFrame) -> DataFrame:
        return self._fused_ratings(self.two_ratings(pairs))

    def _fused_ratings(self, two: DataFrame) -> DataFrame:
        rows = two.crossJoin(F.broadcast(self.rating_lambda.select("lam")))
        return rows.select("user_id", "item_id", steady(ensemble.blend(F.col("lam"), F.col("a"), F.col("b"))).alias("prediction"))

    def two_scores(self, split: str) -> DataFrame:
        """(user_id, pos, item_id, is_positive, a, b): raw scores of both factor models, made once in a report."""
        if split in self._two:
            return self._two[split]
        rows = self.candidates(split)
        near = {m: self.near(m, rows) for m in ("mf", "bpr")}
        rows = factors.with_factors(rows, *near["mf"]).crossJoin(F.broadcast(self.mu))
        rows = rows.withColumn("a", factors.mf_value()).drop("p", "pb", "q", "qb", "mu")
        self._two[split] = self.settle(factors.bpr_scores(rows, *near["bpr"]).withColumnRenamed("score", "b"))
        return self._two[split]

    @cached_property
    def _two(self) -> dict[str, DataFrame]:
        return {}

    @cached_property
    def ranking_sweep(self) -> DataFrame:
        return self.settle(ensemble.ranking_sweep(self.two_scores("validation"), self.p.grid_steps, self.p.cutoff, self.p.candidates))

    @cached_property
    def ranking_lambda(self) -> DataFrame:
        return ensemble.best_ranking_lambda(self.ranking_sweep)

    def fused(self, split: str) -> DataFrame:
        return ensemble.fused(self.two_scores(split).crossJoin(F.broadcast(self.ranking_lambda.select("lam"))), F.col("lam"))

    # stages
    def predict(self, stage: str, pairs: DataFrame) -> DataFrame:
        """(user_id, item_id, prediction), and n_neighbors of the stages that have neighbours."""
        if stage == "global_mean":
            return pairs.select("user_id", "item_id").crossJoin(F.broadcast(self.mu)).select("user_id", "item_id", F.col("mu").alias("prediction"))
        if stage in ("genre_content", "genome_content"):
            return self.content(pairs, "genre" if stage == "genre_content" else "tag")
        if stage in ("user_knn", "hybrid"):
            return {"user_knn": self.user_knn, "hybrid": self.hybrid}[stage](pairs)
        found = {"movie_knn": self.item_knn, "mf": self.mf, "bpr": self.bpr_ratings, "mf_bpr": self.mf_bpr}[stage](pairs)
        return found.select("user_id", "item_id", "prediction", *[c for c in found.columns if c == "n_neighbors"])

    def rank_scores(self, stage: str, split: str = "test") -> DataFrame:
        """(user_id, pos, item_id, is_positive, score) of the candidates."""
        rows = self.candidates(split)
        if stage == "global_mean":
            return rows.withColumn("score", uniform(F.lit(self.p.baseline_seed), F.col("user_id"), F.col("pos")))
        if stage == "mf_bpr":
            return self.fused(split).select("user_id", "pos", "item_id", "is_positive", "score")
        if self.report and stage in ("mf", "bpr"):  # the fused scores are of these
            return self.two_scores(split).select("user_id", "pos", "item_id", "is_positive", F.col({"mf": "a", "bpr": "b"}[stage]).alias("score"))
        if self.report and self.catalog and stage in ("user_knn", "genome_content", "hybrid"):
            parts = self.ranked_components(split)
            scored = self._blended(parts).withColumnRenamed("prediction", "score") if stage == "hybrid" else parts.withColumnRenamed({"user_knn": "knn", "genome_content": "content"}[stage], "score")
        elif stage == "bpr":
            scored = factors.bpr_scores(rows.select("user_id", "item_id"), *self.near("bpr", rows))
        elif stage == "mf":
            scored = factors.mf_scores(rows.select("user_id", "item_id"), *self.near("mf", rows), self.mu).withColumnRenamed("prediction", "score")
        elif stage == "hybrid":
            scored = self.hybrid_ranking(rows).withColumnRenamed("prediction", "score")
        else:
            scored = self.predict(stage, rows).withColumnRenamed("prediction", "score")
        return rows.join(scored.select("user_id", "item_id", "score"), ["user_id", "item_id"]).select("user_id", "pos", "item_id", "is_positive", "score")

    def counted(self, stage: str, split: str = "test") -> DataFrame:
        """(user_id, item_id, rating, prediction), and n_neighbors of the stages that have neighbours."""
        rows = self.split(split)
        if stage == "hybrid":
            found = self.hybrid(rows, self.held_components)
        elif self.report and self.catalog and stage in ("user_knn", "genome_content"):  # the hybrid's parts are there
            names = {"user_knn": ["knn", "n_neighbors"], "genome_content": ["content"]}[stage]
            found = self.held_components.select("user_id", "item_id", F.col(names[0]).alias("prediction"), *names[1:])
        elif self.report and stage in ("mf", "bpr"):
            found = self.held_ratings().select("user_id", "item_id", F.col({"mf": "a", "bpr": "b"}[stage]).alias("prediction"))
        elif self.report and stage == "mf_bpr":
            found = self._fused_ratings(self.held_ratings())
        else:
            found = self.predict(stage, rows)
        return rows.join(found, ["user_id", "item_id"])

    def predictions(self, stage: str, split: str = "test") -> DataFrame:
        return self.counted(stage, split).select("user_id", "item_id", "rating", "prediction")

    def quality(self) -> DataFrame:
        """(check, violations) of the ratings, the splits and the features."""
        short = prepare.user_activity(self.splits).where(F.col("n") < self.p.min_history)
        return validate.union(
            validate.ratings(self.raw, self.p.low, self.p.high),
            validate.number_of(validate.duplicate_pairs(self.splits), "pair_repeated"),
            validate.number_of(short, "history_too_short"),
            validate.number_of(content.missing(self.genre_features, self.splits), "features_missing"),
            validate.number_of(self.items.groupBy("item_id").count().where("count > 1"), "item_repeated"),
        )

    def metadata(self) -> DataFrame:
        """One row: sizes of the data and every parameter that the prepared tables depend on."""
        p = self.p
        return self.splits.agg(
            F.countDistinct("user_id").alias("n_users"),
            F.countDistinct("item_id").alias("n_items"),
            shown(F.avg(F.when(F.col("split") == "train", F.col("rating")))).alias("global_mean"),
            *[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in ("train", "validation", "test")],
            F.count("*").alias("n_rows"),
            *[F.lit(v).alias(k) for k, v in {"min_history": p.min_history, "min_train": p.min_history - 2, "tie_break": "item", "catalog": self.catalog, "relevance": p.relevance, "item_neighbors": p.item_neighbors, "user_neighbors": p.user_neighbors, "min_common": p.min_common, "shrinkage": p.shrinkage, "ranking_users": p.ranking_users, "n_candidates": p.candidates, "validation_seed": p.validation_seed, "test_seed": p.test_seed}.items()],
        )

    def rating_metrics(self, stage: str) -> DataFrame:
        return self.settle(metrics.rating_metrics(self.predictions(stage), self.p.low, self.p.high))

    def ranks(self, stage: str, split: str = "test") -> DataFrame:
        return metrics.positive_rank(self.rank_scores(stage, split))

    def ranking_metrics(self, stage: str) -> DataFrame:
        return self.settle(metrics.ranking_metrics(self.ranks(stage), self.p.cutoff, self.p.candidates))

    def top_n(self, users: DataFrame, stage: str, n: int) -> DataFrame:
        """(user_id, nth, item_id, score): the best unobserved items of the whole catalogue for the given users."""
        users, found = self.written(users.select("user_id").distinct()), None
        if stage == "mf":
            items = self._side("mf", "items", "item_id")
            if items is None:
                items = self.stand_in(self.catalogue, "item_id", 0, self.catalogue)
            else:
                items = self.catalogue.select("item_id").join(items, "item_id", "left")
            found = best.best_by_factors(users, self._near("mf", "users", "user_id", users), items, self.known, self.mu, n)
        if found is None:
            found = self.predict(stage, C.unobserved(users, self.catalogue, self.known, users.count() <= BROADCAST_IDS))
        order = similarity.Window.partitionBy("user_id").orderBy(F.desc("prediction"), "item_id")
        ranked = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
        return ranked.select("user_id", "nth", "item_id", shown(F.col("prediction")).alias("score"))
