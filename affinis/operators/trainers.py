"""Trainers of latent factors.

``mf_grid`` and ``bpr_grid`` run the sequential recurrences, one task for each regularisation: right for
training data that fits a task, some million ratings. Steps that share no user and no item are taken together, which
changes nothing but the time. ``mf_als`` is for any size: a distributed trainer towards a like objective.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import dot, steady
from affinis.functions.workers import send_package
from affinis.operators.factors import mf_value
from affinis.operators.metrics import positive_rank, ranking_metrics
from affinis.operators.prepare import dense_ids
from affinis.schema import Params

MODEL = "reg double, side string, id long, bias double, factors array<double>, seen boolean"
MONITOR = "reg double, epoch int, loss double"
#: Steps among which ``in_turn`` looks for independent ones: at most, and where few are, at least.
WIDE, NARROW = 1 << 13, 1 << 6
#: Draws that are compared with the rated items at once, at most, and ratings or rows of a model that are handled at once.
AHEAD, PART = 1 << 16, 1 << 14


def in_turn(touched: np.ndarray, size: int, step: Callable[[np.ndarray], None]) -> None:
    """The effect of ``step`` on each row of ``touched`` in order, by calls for many rows (their places) at a time.

    A row has the numbers, below ``size``, of all that its step reads or changes. Rows of one call have none in common, and
    each comes after every earlier row with which it shares one, so it finds what it would find in a loop over the rows.
    """
    none, at, width = len(touched), 0, WIDE
    first = np.full(size, none)
    while at < none:
        left = np.arange(at, min(at + width, none))
        at, rounds = at + len(left), 0
        while len(left):
            own = touched[left]
            np.minimum.at(first, own.ravel(), np.repeat(left, own.shape[1]))
            ready = (first[own] == left[:, None]).all(1)
            first[own] = none
            step(left[ready])
            left, rounds = left[~ready], rounds + 1
        width = max(NARROW, width // 2) if rounds > 64 else min(WIDE, 2 * width) if rounds < 24 else width


class Coded(NamedTuple):
    """Ratings by the places of their users and items among the distinct ids."""

    user_ids: np.ndarray
    item_ids: np.ndarray
    u: np.ndarray
    i: np.ndarray
    r: np.ndarray


def coded(users: np.ndarray, items: np.ndarray, ratings: np.ndarray) -> Coded:
    (user_ids, u), (item_ids, i) = np.unique(users, return_inverse=True), np.unique(items, return_inverse=True)
    return Coded(user_ids, item_ids, u.astype(np.int32), i.astype(np.int32), ratings.astype(float, copy=False))


def _frame(rows: pd.DataFrame) -> Coded:
    return coded(*(rows[c].to_numpy() for c in ("user_id", "item_id", "rating")))


def train_mf(rows: pd.DataFrame, reg: float, p: Params, epochs: int, monitor: bool = True) -> tuple[dict, list[float]]:
    """Stochastic gradient descent on (user_id, item_id, rating), in a new order each epoch. With ``monitor``, the error after each."""
    return _train_mf(_frame(rows), reg, p, epochs, monitor)


def _train_mf(data: Coded, reg: float, p: Params, epochs: int, monitor: bool = True) -> tuple[dict, list[float]]:
    rng = np.random.default_rng(p.seed)
    user_ids, item_ids, u, i, r = data
    mu = r.mean()
    bu, bi = np.zeros(len(user_ids)), np.zeros(len(item_ids))
    pu, qi = rng.normal(0, p.mf_scale, (len(user_ids), p.factors)), rng.normal(0, p.mf_scale, (len(item_ids), p.factors))
    losses = []
    rate, order = p.mf_rate, np.arange(len(r))
    keep = 1 - rate * reg

    def error(at: np.ndarray) -> np.ndarray:
        return r[at] - (mu + bu[u[at]] + bi[i[at]] + np.einsum("kf,kf->k", pu[u[at]], qi[i[at]]))

    def step(at: np.ndarray) -> None:
        at = order[at]
        a, b = u[at], i[at]
        x, y, c, d = pu.take(a, 0), qi.take(b, 0), bu[a], bi[b]
        e = rate * (r[at] - (mu + c + d + np.einsum("kf,kf->k", x, y)))
        bu[a], bi[b] = keep * c + e, keep * d + e
        e = e[:, None]
        to_x, to_y = e * y, e * x
        x *= keep
        x += to_x
        y *= keep
        y += to_y
        pu[a], qi[b] = x, y

    for _ in range(epochs):
        rng.shuffle(order)
        in_turn(np.stack([u[order], i[order] + np.int32(len(user_ids))], 1), len(user_ids) + len(item_ids), step)
        if monitor:
            squares = [np.square(error(slice(k, k + PART))).sum() for k in range(0, len(r), PART)]
            losses.append(float(np.sqrt(sum(squares) / len(r))))
    return {"mu": mu, "users": (user_ids, bu, pu), "items": (item_ids, bi, qi)}, losses


class Rated:
    """Whether users have rated items, of places below ``size``: a table of hashes says no at once to most that they have not."""

    def __init__(self, u: np.ndarray, i: np.ndarray, size: int) -> None:
        self.size, self.keys = size, np.unique(u * np.int64(size) + i)
        self.shift = np.uint64(64 - max(8, min(26, (8 * len(self.keys)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._hash(self.keys)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of_users(self, n: int) -> np.ndarray:
        """How many items each of ``n`` users has rated."""
        return np.bincount(self.keys // self.size, minlength=n)

    def __call__(self, u: np.ndarray, i: np.ndarray) -> np.ndarray:
        keys = u * np.int64(self.size) + i
        found = self.maybe[self._hash(keys)]
        at = np.flatnonzero(found)
        found[at] = self.keys[np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)] == keys[at]
        return found


def draw_free(rng: np.random.Generator, users: np.ndarray, rated: Rated) -> np.ndarray:
    """An item that is not rated for each of ``users`` in order, as if drawn one by one and anew while it is rated."""
    out, drawn = np.empty(len(users), np.int32), np.zeros(0, np.int64)
    at, many = 0, AHEAD
    while at < len(users):
        if len(drawn) < min(many, len(users) - at):  # no more are drawn than are needed if all of them are free
            drawn = np.concatenate([drawn, rng.integers(rated.size, size=min(16 * AHEAD, len(users) - at) - len(drawn))])
        now = drawn[: min(many, len(users) - at)]
        taken = rated(users[at : at + len(now)], now)
        free = int(taken.argmax()) if taken.any() else len(now)
        out[at : at + free] = now[:free]
        many = min(AHEAD, 2 * many) if free == len(now) else max(32, (many + 2 * free) // 2)
        at, drawn = at + free, drawn[min(free + 1, len(now)) :]
    return out


def train_bpr(rows: pd.DataFrame, reg: float, p: Params, epochs: int) -> tuple[dict, list[float]]:
    """Pairwise ranking on ratings of at least ``relevance`` against items that the user has not rated."""
    return _train_bpr(_frame(rows), reg, p, epochs)


def _train_bpr(data: Coded, reg: float, p: Params, epochs: int) -> tuple[dict, list[float]]:
    rng = np.random.default_rng(p.seed)
    user_ids, item_ids, u, i, r = data
    liked = np.flatnonzero(r >= p.relevance)
    pu, qi = rng.normal(0, p.bpr_scale, (len(user_ids), p.factors)), rng.normal(0, p.bpr_scale, (len(item_ids), p.factors))
    touched_u, touched_i = np.zeros(len(user_ids), bool), np.zeros(len(item_ids), bool)
    accuracy, rate, times = [], p.bpr_rate, p.bpr_negatives
    keep = 1 - rate * reg
    rated = Rated(u, i, len(item_ids))
    room = rated.of_users(len(user_ids)) < len(item_ids)
    for _ in range(epochs):
        rng.shuffle(liked)
        able = liked[room[u[liked]]]
        a, b = u[able], i[able]
        j = draw_free(rng, np.repeat(a, times), rated).reshape(-1, times)
        right = 0

        def step(at: np.ndarray) -> None:
            """A positive with all its negatives, one after the other."""
            nonlocal right
            x, y = pu.take(a[at], 0), qi.take(b[at], 0)
            for c in j[at].T:
                z = qi.take(c, 0)
                apart = y - z
                margin = np.einsum("kf,kf->k", x, apart)
                right += np.count_nonzero(margin > 0)
                g = (rate / (1.0 + np.exp(np.clip(margin, -500, 500))))[:, None]
                by = g * x
                z *= keep
                z -= by
                qi[c] = z
                y *= keep
                y += by
                x *= keep
                apart *= g
                x += apart
            pu[a[at]], qi[b[at]] = x, y

        items = np.int32(len(user_ids))
        in_turn(np.column_stack([a, b + items, j + items]), len(user_ids) + len(item_ids), step)
        touched_u[a] = touched_i[b] = touched_i[j.ravel()] = True
        accuracy.append(right / max(1, j.size))
    pu[~touched_u], qi[~touched_i] = 0, 0
    return {"mu": 0.0, "users": (user_ids, np.zeros(len(user_ids)), pu), "items": (item_ids, np.zeros(len(item_ids)), qi)}, accuracy


def _sorted(group: pa.Table) -> list[np.ndarray]:
    columns = [group[c].to_numpy() for c in ("user_id", "item_id", "rating")]
    order = np.lexsort((columns[1], columns[0]))
    return [x[order] for x in columns]


def _grid(train: DataFrame, regs: tuple[float, ...], schema: str, run: Callable[[Coded, float], pa.Table]) -> DataFrame:
    """Each regularisation with all training rows, in a task of its own."""
    send_package(train.sparkSession)
    rows = train.select("user_id", "item_id", "rating", F.explode(F.array(*map(F.lit, regs))).alias("reg")).repartition(len(regs) * 8, "reg")

    def one(group: pa.Table) -> pa.Table:
        return run(coded(*_sorted(group)), group["reg"][0].as_py())

    return rows.groupBy("reg").applyInArrow(one, schema)


def _rows(model: dict, reg: float) -> pa.Table:
    """The model's rows, in parts, so that no batch has all factors."""

    def part(side: str, ids: np.ndarray, bias: np.ndarray, factors: np.ndarray, seen: np.ndarray) -> pa.Table:
        ends = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(factors.shape[1])
        columns = [np.full(len(ids), reg), np.full(len(ids), side), pa.array(ids, from_pandas=True).cast(pa.int64()), bias, pa.ListArray.from_arrays(ends, factors.ravel()), seen]
        return pa.table([pa.array(x) for x in columns], ["reg", "side", "id", "bias", "factors", "seen"])

    parts = [part("mu", np.zeros(1, np.int64), np.array([float(model["mu"])]), np.zeros((1, 0)), np.ones(1, bool))]
    for side in ("users", "items"):
        ids, bias, factors = model[side]
        for k in range(0, len(ids), PART):
            own = factors[k : k + PART]
            parts.append(part(side, ids[k : k + PART], bias[k : k + PART], own, np.abs(own).sum(1) > 0))
    return pa.concat_tables(parts)


def _monitored(values: list[float], reg: float) -> pa.Table:
    return pa.table({"reg": np.full(len(values), reg), "epoch": np.arange(1, len(values) + 1, dtype=np.int32), "loss": np.array(values, float)})


def mf_grid(train: DataFrame, p: Params, epochs: int | None = None) -> DataFrame:
    """(reg, side, id, bias, factors, seen): a model for each regularisation; side mu holds the mean."""
    return _grid(train, p.mf_grid, MODEL, lambda data, reg: _rows(_train_mf(data, reg, p, epochs or p.epochs, False)[0], reg))


def bpr_grid(train: DataFrame, p: Params, epochs: int | None = None) -> DataFrame:
    return _grid(train, p.bpr_grid, MODEL, lambda data, reg: _rows(_train_bpr(data, reg, p, epochs or p.epochs)[0], reg))


def mf_monitor(train: DataFrame, p: Params, epochs: int | None = None) -> DataFrame:
    """(reg, epoch, loss): the training error after each epoch."""
    return _grid(train, p.mf_grid, MONITOR, lambda data, reg: _monitored(_train_mf(data, reg, p, epochs or p.epochs)[1], reg))


def bpr_monitor(train: DataFrame, p: Params, epochs: int | None = None) -> DataFrame:
    """(reg, epoch, loss): the share of triples in the right order, as they were met in each epoch."""
    return _grid(train, p.bpr_grid, MONITOR, lambda data, reg: _monitored(_train_bpr(data, reg, p, epochs or p.epochs)[1], reg))


def side(model: DataFrame, name: str, key: str) -> DataFrame:
    """(key, factors, bias) of one side; untrained rows are left out."""
    return model.where((F.col("side") == name) & F.col("seen")).select(F.col("id").alias(key), "factors", "bias")


def mf_als(train: DataFrame, p: Params, reg: float, damping: float = 5.0) -> DataFrame:
    """(side, id, bias, factors): alternating least squares on what damped biases leave. Another objective than ``mf_grid``."""
    from pyspark.ml.recommendation import ALS

    mu = train.agg(F.avg("rating").alias("mu"))
    rows = train.select("user_id", "item_id", "rating").crossJoin(F.broadcast(mu)).withColumn("r", F.col("rating") - F.col("mu"))
    bi = rows.groupBy("item_id").agg((F.sum("r") / (F.count("*") + damping)).alias("bi"))
    rows = rows.join(bi, "item_id").withColumn("r", F.col("r") - F.col("bi"))
    bu = rows.groupBy("user_id").agg((F.sum("r") / (F.count("*") + damping)).alias("bu"))
    rows = rows.join(bu, "user_id").withColumn("r", F.col("r") - F.col("bu"))
    # the library takes ids of 32 bits: places stand for ids of any size
    user_places, item_places = dense_ids(rows, "user_id").withColumnRenamed("dense_id", "u"), dense_ids(rows, "item_id").withColumnRenamed("dense_id", "i")
    placed = rows.join(user_places, "user_id").join(item_places, "item_id").select("u", "i", "r")
    model = ALS(rank=p.factors, maxIter=p.epochs // 2, regParam=reg, userCol="u", itemCol="i", ratingCol="r", seed=p.seed, coldStartStrategy="nan").fit(placed)
    users, items = (f.select(F.col("id").alias(place), F.col("features").cast("array<double>").alias("factors")).join(ids, place).drop(place) for f, place, ids in ((model.userFactors, "u", user_places), (model.itemFactors, "i", item_places)))
    users, items = users.join(bu, "user_id"), items.join(bi, "item_id")
    a = users.select(F.lit("users").alias("side"), F.col("user_id").alias("id"), F.col("bu").alias("bias"), "factors")
    b = items.select(F.lit("items").alias("side"), F.col("item_id").alias("id"), F.col("bi").alias("bias"), "factors")
    return a.unionByName(b)


def mf_errors(model: DataFrame, validation: DataFrame) -> DataFrame:
    """(reg, rmse) of each model of a grid on held-out ratings; untrained sides say nothing."""
    mu = model.where("side = 'mu'").select("reg", F.col("bias").alias("mu"))
    rows = validation.crossJoin(F.broadcast(mu))  # as many rows as there are regularisations
    for name, key, factors, bias in (("users", "user_id", "p", "pb"), ("items", "item_id", "q", "qb")):
        own = model.where((F.col("side") == name) & F.col("seen"))
        rows = rows.join(own.select("reg", F.col("id").alias(key), F.col("factors").alias(factors), F.col("bias").alias(bias)), ["reg", key], "left")
    error = mf_value() - F.col("rating")
    return rows.groupBy("reg").agg(steady(F.sqrt(F.avg(error * error))).alias("rmse"))


def best_mf(errors: DataFrame) -> DataFrame:
    """The least error; the first regularisation of equal ones."""
    return errors.orderBy("rmse", "reg").limit(1)


def bpr_quality(model: DataFrame, candidates: DataFrame, cutoff: int, n: int) -> DataFrame:
    """(reg, hit_rate, ndcg, mrr) of each model of a grid on sampled candidates."""
    regs = model.where("side = 'mu'").select("reg")
    rows = candidates.crossJoin(F.broadcast(regs))
    for name, key, factors in (("users", "user_id", "p"), ("items", "item_id", "q")):
        own = model.where((F.col("side") == name) & F.col("seen"))
        rows = rows.join(own.select("reg", F.col("id").alias(key), F.col("factors").alias(factors)), ["reg", key], "left")
    scored = rows.withColumn("score", steady(F.coalesce(dot(F.col("p"), F.col("q")), F.lit(0.0))))
    return ranking_metrics(positive_rank(scored, "reg"), cutoff, n, "reg").select("reg", "hit_rate", "ndcg", "mrr")


def best_bpr(quality: DataFrame) -> DataFrame:
    """The best NDCG; the larger regularisation of equal ones."""
    return quality.orderBy(F.desc("ndcg"), F.desc("reg")).limit(1)
