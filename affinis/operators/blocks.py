"""Pairwise ranking factors for training data of any size.

Users are dealt to blocks of some ``rows`` triples (user, item that is liked, item that is not rated). In an epoch each
block draws its own triples and goes through them, in a new order and some AT_ONCE at a time, from the factors that the last
epoch left; an item's new factors are the mean of what its blocks made of it, weighted by how often each moved it. A task thus
holds one block's ratings and triples and the factors that these name, whatever the numbers of users, items and ratings are.
Inside, items are places in the catalogue, so a block draws items without having the catalogue. Where all is one block and
the model has at most ONE_TASK numbers, a task goes through all epochs by itself, with the same draws.

Defined results: ratings without user, item or value teach nothing; repeated ones count once; a user who has rated
everything, or nothing well enough, and an item that no triple names, have factors of zero and are not ``seen``; empty
data give a model without users and items.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.workers import delete, send_package, shared_folder
from affinis.operators.prepare import dense_ids
from affinis.schema import Params

#: Triples of a block, and triples whose updates are added up before the next ones see them.
ROWS, AT_ONCE = 1 << 20, 64
#: Numbers of a model (128 MB) that a task may have for all epochs.
ONE_TASK = 1 << 24
#: Draws anew for a triple whose item is rated, before its user's free items are listed.
DRAWS = 8
NAMED, LEARNT = "part int, side string, id long", "reg double, side string, id long, factors array<double>, seen boolean"
MOVED = "side string, id long, n long, step array<double>, reg double"


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def start(side: Column, key: Column, n: int, scale: float, seed: int) -> Column:
    """Normal numbers that depend on the side, the id and the seed alone."""
    a, b = (lambda k, x=x: _uniform(side, key, k, F.lit(2 * seed + x)) for x in (0, 1))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lit(scale) * F.sqrt(F.lit(-2.0) * F.log(a(k))) * F.cos(F.lit(2 * math.pi) * b(k)))


def draw(rated: pd.DataFrame, size: int, times: int, seed: list[int]) -> pd.DataFrame:
    """A block's triples (user_id, item_id, negative, d) of one epoch, from its ratings (user_id, place, liked), each once.

    Each liked place has ``times`` negatives, drawn from those of the ``size`` places that its user has not rated.
    """
    rated = rated.sort_values(["user_id", "place"], kind="stable")
    users, u = np.unique(rated["user_id"].to_numpy(), return_inverse=True)
    place, liked = rated["place"].to_numpy(np.int64), rated["liked"].to_numpy(bool)
    taken, known = u * size + place, np.bincount(u, minlength=len(users))
    of = np.repeat(np.flatnonzero(liked & (known[u] < size)), times)
    rng = np.random.default_rng(seed)
    negative = rng.integers(size, size=len(of)) if len(of) else np.zeros(0, np.int64)

    def unfree(at: np.ndarray) -> np.ndarray:
        key = u[of[at]] * size + negative[at]
        return at[taken[np.minimum(np.searchsorted(taken, key), len(taken) - 1)] == key]

    again = unfree(np.arange(len(of)))
    for _ in range(DRAWS):
        negative[again] = rng.integers(size, size=len(again))
        again = unfree(again)
    for user in np.unique(u[of[again]]):
        at, free = again[u[of[again]] == user], np.setdiff1d(np.arange(size), place[u == user])
        negative[at] = free[rng.integers(len(free), size=len(at))]
    return pd.DataFrame({"user_id": users[u[of]], "item_id": place[of], "negative": negative, "d": np.arange(len(of)) % times})


def learn(triples: pd.DataFrame, known: pd.DataFrame, rate: float, reg: float, seed: list[int]) -> pd.DataFrame:
    """What one block's triples make of the factors that they name: (side, id, n, step), n the number of updates."""
    triples = triples.sort_values(["user_id", "item_id", "d"], kind="stable")
    model, places = {}, {}
    for side, names in (("users", ["user_id"]), ("items", ["item_id", "negative"])):
        own = known[known["side"] == side].sort_values("id")
        ids = own["id"].to_numpy()
        model[side] = (ids, np.stack(own["factors"].to_numpy()).astype(float), np.zeros(len(ids), np.int64))
        places |= {name: np.searchsorted(ids, triples[name].to_numpy()) for name in names}
    (users, p, n_p), (items, q, n_q) = model["users"], model["items"]
    before = p.copy(), q.copy()
    order = np.random.default_rng(seed).permutation(len(triples))
    for at in range(0, len(order), AT_ONCE):
        u, i, j = (places[name][order[at : at + AT_ONCE]] for name in ("user_id", "item_id", "negative"))
        apart = q[i] - q[j]
        pull = 1 / (1 + np.exp(np.clip((p[u] * apart).sum(1), -500, 500)))[:, None]
        steps = ((p, u, pull * apart - reg * p[u]), (q, i, pull * p[u] - reg * q[i]), (q, j, -pull * p[u] - reg * q[j]))
        for factors, where, by in steps:
            np.add.at(factors, where, rate * by)
    for counts, names in ((n_p, ["user_id"]), (n_q, ["item_id", "negative"])):
        for name in names:
            counts += np.bincount(places[name], minlength=len(counts))
    parts = [("users", users, n_p, p - before[0]), ("items", items, n_q, q - before[1])]
    return pd.concat([pd.DataFrame({"side": side, "id": ids, "n": n, "step": list(step)}) for side, ids, n, step in parts], ignore_index=True)


def _names(size: int, p: Params, epoch: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The users and places that a block's triples of an epoch name."""

    def names(group: tuple, rated: pd.DataFrame) -> pd.DataFrame:
        triples = draw(rated, size, p.bpr_negatives, [p.seed, epoch, int(group[0]), 1])
        ids = (("users", triples["user_id"].unique()), ("items", np.union1d(triples["item_id"], triples["negative"])))
        return pd.concat([pd.DataFrame({"part": int(group[0]), "side": side, "id": x}) for side, x in ids], ignore_index=True)

    return names


def _step(size: int, p: Params, epoch: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a group (reg, block): its regularisation is the model's, its triples and their order are the block's own."""

    def step(group: tuple, rated: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        reg, block = float(group[0]), int(group[1])
        triples = draw(rated, size, p.bpr_negatives, [p.seed, epoch, block, 1])
        return (learn(triples, known, p.bpr_rate, reg, [p.seed, epoch, block]) if len(triples) else pd.DataFrame(columns=["side", "id", "n", "step"])).assign(reg=reg)

    return step


def _all_epochs(size: int, p: Params, epochs: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a regularisation: what ``epochs`` steps of the one block 0 make of the state."""

    def run(group: tuple, rated: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        state = state[["side", "id", "factors"]].assign(seen=False).sort_values(["side", "id"], kind="stable", ignore_index=True)
        factors, index = np.stack(state["factors"].to_numpy()), pd.MultiIndex.from_frame(state[["side", "id"]])
        for epoch in range(1, epochs + 1):
            moved = _step(size, p, epoch)((group[0], 0), rated, state.assign(factors=list(factors)))
            moved = moved[moved["n"] > 0]
            if len(moved):
                at = index.get_indexer(pd.MultiIndex.from_frame(moved[["side", "id"]]))
                factors[at] += np.stack(moved["step"].to_numpy())
                state.loc[at, "seen"] = True
        return state.assign(factors=list(factors), reg=float(group[0]))

    return run


def bpr_blocks(train: DataFrame, p: Params, epochs: int | None = None, rows: int = ROWS, one_task: int = ONE_TASK) -> DataFrame:
    """(reg, side, id, bias, factors, seen): a model for each regularisation, in the form of the sequential trainer's grid.

    All models see the same triples. Each epoch's factors are a table in the shared folder, so a lost executor costs a part of one epoch.
    """
    spark = train.sparkSession
    send_package(spark)
    folder = f"{shared_folder(spark)}/factors-{uuid.uuid4().hex}"
    seed, width, epochs = p.seed, p.factors, epochs or p.epochs

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def each_reg() -> Column:
        return F.explode(F.array(*[F.lit(float(x)) for x in p.bpr_grid])).alias("reg")

    rated = train.where("user_id IS NOT NULL AND item_id IS NOT NULL AND rating IS NOT NULL")
    rated = kept(rated.groupBy("user_id", "item_id").agg((F.max("rating") >= p.relevance).alias("liked")), "rated")
    places = kept(dense_ids(rated, "item_id").select("item_id", F.col("dense_id").cast("long").alias("place")), "places")
    n = rated.agg(F.count("*").alias("rows"), F.count_if("liked").alias("liked"), F.countDistinct("user_id").alias("users")).first()
    size = places.count()
    blocks = max(1, -(-n.liked * p.bpr_negatives // rows))
    block = F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(blocks)).cast("int").alias("block")
    placed = kept(rated.join(places, "item_id").select("user_id", "place", "liked", block), "placed")
    ids = placed.select(F.lit("users").alias("side"), F.col("user_id").alias("id"), F.col("user_id").alias("key")).distinct()
    ids = ids.unionByName(places.select(F.lit("items").alias("side"), F.col("place").alias("id"), F.col("item_id").alias("key")))
    state = kept(ids.select("side", "id", "key", start(F.col("side"), F.col("key"), width, p.bpr_scale, seed).alias("factors"), F.lit(False).alias("seen"), each_reg()), "state-0")
    keys = state.where(F.col("reg") == float(p.bpr_grid[0])).select("side", "id", "key")
    if blocks == 1 and n.rows <= rows and (n.users + size) * width <= one_task:
        whole = placed.select("user_id", "place", "liked", each_reg()).groupBy("reg").cogroup(state.groupBy("reg"))
        state = kept(whole.applyInPandas(_all_epochs(size, p, epochs), LEARNT), f"state-{epochs}")
    else:
        for epoch in range(1, epochs + 1):
            part = placed.groupBy("block").applyInPandas(_names(size, p, epoch), NAMED)
            known = part.join(state.select("side", "id", "factors", F.col("reg").alias("of")), ["side", "id"])
            moved = placed.select("*", each_reg()).groupBy("reg", "block").cogroup(known.groupBy("of", "part")).applyInPandas(_step(size, p, epoch), MOVED)
            # sums per id before the shuffle; the blocks' mean, weighted by their updates
            sums = [F.sum(F.col("n") * F.get("step", F.lit(k))).alias(f"s{k}") for k in range(width)]
            total = moved.groupBy("reg", "side", "id").agg(F.sum("n").alias("n"), *sums)
            new = F.zip_with("factors", F.array(*[F.col(f"s{k}") / F.col("n") for k in range(width)]), lambda x, y: x + y)
            factors = F.when(F.col("n").isNull(), F.col("factors")).otherwise(new)
            state = kept(state.join(total, ["reg", "side", "id"], "left").select("reg", "side", "id", factors.alias("factors"), (F.col("seen") | F.col("n").isNotNull()).alias("seen")), f"state-{epoch}")
            if epoch > 1:
                delete(spark, f"{folder}/state-{epoch - 1}")
    nothing = F.transform("factors", lambda x: F.lit(0.0))
    model = state.join(keys, ["side", "id"]).select("reg", "side", F.col("key").alias("id"), F.lit(0.0).alias("bias"), F.when(F.col("seen"), F.col("factors")).otherwise(nothing).alias("factors"), "seen")
    model = kept(model, "model")
    for done in ("rated", "places", "placed", "state-0", f"state-{epochs}"):
        delete(spark, f"{folder}/{done}")
    mean = spark.range(1).select(each_reg(), F.lit("mu").alias("side"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("bias"), F.array().cast("array<double>").alias("factors"), F.lit(True).alias("seen"))
    return model.unionByName(mean)
