"""Nearest neighbours by collision counting.

Vectors are dealt to blocks by a tree of splits along PROJECTIONS random directions, which is fitted on a bounded
sample; every vector is indexed. Each block keeps, for every direction, its vectors in order of their projection. A
query opens a window around its own projection in each of these sorted arrays and counts how often each vector falls
in; widening all windows by a factor (virtual rehashing) adds the newly covered entries alone. Vectors that collide in
THRESHOLD of the arrays are verified by their exact distance. Windows stop widening when a vector as near as the k-th
best so far would have been counted to the threshold with a probability of CERTAINTY; there is no cap on candidates.

There are two rounds. In the first a query searches the block that it falls into itself, and so learns how wide its
windows must be. In the second it goes on to those blocks alone in which some vector could still collide often enough:
windows of that width must meet a block's range in THRESHOLD of the directions. Clustered vectors leave a query few
blocks; of vectors that lie alike in all directions every block remains, as for any search whose windows reach the
typical distance. Blocks and groups of queries are bounded, and only k rows per query and block leave them.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of another dimension than the query's are no candidates; ties go to the
smaller id; rows that repeat an id are candidates each, but none for a query of the same id, and of those that ask the one with the
least vector does; fewer than k candidates give as many rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut_table, ready_workers, unit_hash

K = 10
PROJECTIONS, THRESHOLD = 64, 44
CERTAINTY, WIDEN = 0.9, 1.25
#: The first windows hold about this share of a block.
FIRST = 0.05
#: Vectors in a block, and queries that are taken to it together.
BLOCK, QUERIES = 8192, 4096
#: The tree is fitted on about so many vectors, drawn by a hash (64 MB at 128 dimensions on the driver).
SAMPLE = 1 << 16
#: Ranges of so many blocks at most (32 MB) go to the workers; of more blocks, neighbours share a range.
RANGES = 1 << 15
SEED = 4
#: Projections of one vector may differ by so much of its length, as they are summed in another order.
SLACK = 1e-9


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


class Tree:
    """Splits along directions, each at its sample's median, down to leaves that should hold a block."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.depth = min(max(0, math.ceil(math.log2(max(1, rows / BLOCK)))), max(0, int(math.log2(max(1, len(sample)))) - 3))
        self.splits: dict[int, tuple[int, float]] = {}
        self._split(1, sample @ directions(sample.shape[1]) if self.depth else np.zeros((0, PROJECTIONS)), self.depth)

    def _split(self, node: int, values: np.ndarray, left: int) -> None:
        if left and len(values):
            j = int(np.argmax(values.std(0)))
            at = float(np.median(values[:, j]))
            self.splits[node] = (j, at)
            low = values[:, j] < at
            self._split(2 * node, values[low], left - 1)
            self._split(2 * node + 1, values[~low], left - 1)

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """The leaf of each row of projections; leaves of one parent have neighbouring numbers."""
        node = np.ones(len(values), np.int64)
        for _ in range(self.depth):
            for at in np.unique(node):
                j, cut_at = self.splits.get(int(at), (0, math.inf))
                here = node == at
                node[here] = 2 * at + (values[here, j] >= cut_at)
        return node - (1 << self.depth)


def _tail(p: float) -> float:
    """The probability that a vector which collides in one array with probability p does so in THRESHOLD of them."""
    return sum(math.comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(THRESHOLD, PROJECTIONS + 1))


def _reach() -> float:
    """The window's half-width, in distances, at which a vector of that distance is counted with CERTAINTY."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(math.erf(mid / math.sqrt(2))) < CERTAINTY else (low, mid)
    return high


class Block:
    """Sorted projections of a block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.directions = directions(vectors.shape[1])
        values = vectors @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.reach = _reach()
        self.verified = 0  # by all searches so far

    def search(self, own: int, query: np.ndarray, k: int, within: float | None = None) -> list[tuple[float, int]]:
        """The k best; of vectors that are ``within`` a distance, if it is given: windows are of its width at once."""
        n = len(self.ids)
        centre = query @ self.directions
        counts = np.zeros(n, np.uint8)
        verified = self.ids == own  # the query's own rows are no candidates
        left = n - int(verified.sum())
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre)])
        high = low.copy()
        best: list[tuple[float, int]] = []
        m = int(FIRST * n / 2)
        wide = [s[min(at + m, n - 1)] - s[min(max(at - m, 0), n - 1)] for s, at in zip(self.sorted, low)]
        half = max(float(np.median(wide)) / 2, 1e-6 * float(np.sqrt(query @ query)))
        half = half if within is None else self.reach * within + SLACK * float(np.sqrt(query @ query))
        done = 0
        while done < left:
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.sorted[j], centre[j] - half, "left")
                b = np.searchsorted(self.sorted[j], centre[j] + half, "right")
                a, b = min(a, low[j]), max(b, high[j])
                counts[self.order[j, a : low[j]]] += 1
                counts[self.order[j, high[j] : b]] += 1
                low[j], high[j] = a, b
            new = np.flatnonzero((counts >= THRESHOLD) & ~verified)
            if len(new):
                verified[new] = True
                done += len(new)
                self.verified += len(new)
                distance = np.sqrt(((self.vectors[new] - query) ** 2).sum(1))
                if len(best) == k:
                    distance_keep = distance <= best[-1][0]
                    new, distance = new[distance_keep], distance[distance_keep]
                if len(new) > k:
                    first = np.lexsort((self.ids[new], distance))[:k]
                    new, distance = new[first], distance[first]
                best = sorted(best + list(zip(distance.tolist(), self.ids[new].tolist())))[:k]
            if within is not None or len(best) == k and half >= self.reach * best[-1][0]:
                break
            half *= WIDEN
        return best


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.float64)


def dealt(rows: DataFrame) -> DataFrame:
    """(id, v, dim, block) of the vectors (id, v): leaves of each dimension's tree, overfull ones cut by a hash. Cut as a table."""
    spark = rows.sparkSession
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    large = [d for d, n in sizes.items() if n > BLOCK]
    trees: dict[int, Tree] = {}
    if large:
        share = min(1.0, SAMPLE / sum(sizes.values()))
        drawn = rows.where(F.size("v").isin(large) & (unit_hash(F.col("id"), F.col("v"), seed=SEED) < share)).select("v").toPandas()
        drawn["dim"] = drawn["v"].map(len)
        trees = {int(d): Tree(_stacked(x), sizes[int(d)]) for d, x in drawn.groupby("dim")}
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["dim"] = batch["v"].map(len)
            batch["leaf"] = 0
            for dim, some in batch.groupby("dim"):
                if int(dim) in shared.value:
                    batch.loc[some.index, "leaf"] = shared.value[int(dim)].leaves(_stacked(some) @ directions(int(dim)))
            yield batch

    placed = cut_table(rows.mapInPandas(place, "id long, v array<double>, dim int, leaf long"))
    leaves = sorted(tuple(r) for r in placed.groupBy("dim", "leaf").agg(F.count("*")).collect())  # as many rows as leaves
    first, parts, at = [], [], 0
    for _, _, n in leaves:
        first.append(at)
        parts.append(-(-n // BLOCK))
        at += parts[-1]
    table = spark.createDataFrame([(d, leaf, a, p) for (d, leaf, _), a, p in zip(leaves, first, parts)], "dim int, leaf long, first long, parts int")
    # repeated rows of one id may share a block: the hash takes the vector too
    block = F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    return cut_table(placed.join(F.broadcast(table), ["dim", "leaf"]).select("id", "v", "dim", block.alias("block")))


def ranges(blocks: DataFrame, together: int) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each dimension (number of the range, least and largest projections) of each run of ``together`` blocks."""

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        values = _stacked(part) @ directions(int(part["dim"].iloc[0]))
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "range": [part["block"].iloc[0] // together], "lo": [values.min(0)], "hi": [values.max(0)]})

    per = blocks.groupBy("dim", "block").applyInPandas(spread, "dim int, range long, lo array<double>, hi array<double>")
    low = [F.min(F.col("lo")[j]).alias(f"l{j}") for j in range(PROJECTIONS)] + [F.max(F.col("hi")[j]).alias(f"h{j}") for j in range(PROJECTIONS)]
    out: dict[int, list] = {}
    for r in per.groupBy("dim", "range").agg(*low).collect():  # at most RANGES rows, and one for each dimension
        out.setdefault(r["dim"], []).append((r["range"], np.array(r[2 : 2 + PROJECTIONS]), np.array(r[2 + PROJECTIONS :])))
    return out


SEARCHED = "query_id long, vec_id long, score double"


def _searched(kept: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query (id, v, dim, block, within) in each block it is taken to."""
    groups = asks.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    asks = asks.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).cast("int")).drop("groups")
    kept = kept.join(groups, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups").withColumn("within", F.lit(None).cast("double"))
    both = kept.withColumn("asks", F.lit(0)).unionByName(asks.withColumn("asks", F.lit(1)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asking = part["asks"].to_numpy() == 1
        out = []
        if asking.any() and not asking.all():
            ids, v, within = part["id"].to_numpy(np.int64), _stacked(part), part["within"].to_numpy(float)
            block = Block(ids[~asking], v[~asking])
            for own, query, most in zip(ids[asking], v[asking], within[asking]):
                out += [(own, other, distance) for distance, other in block.search(own, query, k, None if np.isnan(most) else most)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return both.groupBy("dim", "block", "group").applyInPandas(run, SEARCHED)


def nearest(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` (over ``id``) holds."""
    spark = vectors.sparkSession
    ready_workers(spark)
    kept = dealt(usable(vectors, vec_id, embedding))
    asks = cut_table(kept.where(queries).groupBy("id").agg(F.min(F.struct("v", "dim", "block")).alias("x")).select("id", "x.*"))
    found = cut_table(_searched(kept, asks.withColumn("within", F.lit(None).cast("double")), k))
    blocks = kept.agg(F.max("block")).first()[0]
    if blocks:
        together = -(-(blocks + 1) // RANGES)
        shared = spark.sparkContext.broadcast((ranges(kept, together), _reach(), together, blocks))
        worst = found.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("within"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")

        def going(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of_dim, reach, run, last = shared.value
            for batch in batches:
                hosts = []
                for v, home, within in zip(batch["v"], batch["block"], batch["within"]):
                    centre, met = np.asarray(v) @ directions(len(v)), []
                    half = reach * within + SLACK * float(np.sqrt(v @ v))
                    for number, lo, hi in of_dim[len(v)]:
                        if np.isnan(within) or ((lo <= centre + half) & (hi >= centre - half)).sum() >= THRESHOLD:
                            met += [b for b in range(number * run, min((number + 1) * run, last + 1)) if b != home]
                    hosts.append(met)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "dim": batch["dim"], "hosts": hosts, "within": batch["within"]})

        more = asks.join(worst, "id", "left").mapInPandas(going, "id long, v array<double>, dim int, hosts array<long>, within double")
        more = more.select("id", "v", "dim", F.explode("hosts").alias("block"), "within")
        found = found.unionByName(_searched(kept, more, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
