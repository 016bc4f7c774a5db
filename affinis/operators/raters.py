"""The neighbours that a user's prediction can use: raters of the item that is asked for, alone.

Of all pairs of users few share enough, and of these few are asked for: a graph of all users is made of very many products for
the sake of the rest. Here a user's ratings go once to each bucket of users in which an item that they are asked for has raters; there
they meet those raters' ratings. What is sent grows with the asked pairs and their raters, at most one history for each of both.

Defined results: those of ``neighbors.user_knn_neighbors`` over the whole graph of users. Rows without a user or item meet none, a
null rating adds nothing, repeated ratings count as often as they are there, and a user is no neighbour of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.workers import bound_batches
from affinis.operators import packing as P
from affinis.operators.similarity import shrunk_users, strongest

#: Ratings in a bucket of users, and ratings or products that a worker holds at once.
BUCKET, AT_ONCE = 1 << 17, 1 << 21
#: Kinds of what is sent: the ratings of a bucket's own users, and those of users who ask, followed by the items that they ask for.
OWN, ASKING = 0, 1


def _cut(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))


def _send(at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of users (user, own, m, ids, xs, asked, buckets): rows (a, kind, sent, asked) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            user, own, mean = (P.filled(batch[c]) for c in ("user", "own", "m"))
            (sizes, ids), (_, xs), (n_asked, asked) = (P.lists(batch[c]) for c in ("ids", "xs", "asked"))
            _, nested = P.lists(batch["buckets"])
            n_buckets, buckets = P.lists(nested)
            ids, xs, asked, buckets = map(P.filled, (ids, xs, asked, buckets))
            start, none = np.cumsum(sizes) - sizes, np.zeros(0, np.int64)
            # (bucket, user, item) that are asked for, and with them the user's own bucket
            row = np.repeat(np.repeat(np.arange(len(user)), n_asked), n_buckets)
            item = np.repeat(asked, n_buckets)
            for kind, row, to, item in ((OWN, np.arange(len(user)), own, none), (ASKING, row, buckets, item)):
                order = np.lexsort((item, row, to) if kind == ASKING else (row, to))
                row, to = row[order].astype(np.int64), to[order].astype(np.int64)
                item = item[order] if kind == ASKING else item
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])))) if len(row) else none
                n_items = np.diff(np.concatenate((first, [len(row)])))
                ends = np.concatenate(([0], np.cumsum(n_items)))
                row, to = row[first], to[first]
                for at, end in P.chunks(sizes[row], at_once):
                    cuts = at + _cut(to[at:end])
                    sent, wanted = [], []
                    for low, high in zip(cuts[:-1], cuts[1:]):
                        who = row[low:high]
                        there = P.spans(start[who], sizes[who])
                        sent.append(P.pack(user[who], mean[who], np.zeros(len(who)), sizes[who], ids[there], xs[there], False))
                        if kind == ASKING:
                            some = item[ends[low] : ends[high]]
                            wanted.append(P.pack(user[who], np.zeros(len(who)), np.zeros(len(who)), n_items[low:high], some, np.zeros(len(some)), False))
                        else:
                            wanted.append(None)
                    if sent:
                        yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]], pa.int64()), pa.array([kind] * len(sent), pa.int32()), pa.array(sent, pa.binary()), pa.array(wanted, pa.binary())], names=["a", "kind", "sent", "asked"])

    return run


class Bucket:
    """The ratings of a bucket's users, by user and by item."""

    def __init__(self, blobs: list[pa.Buffer]) -> None:
        users, means, _, sizes, ids, xs = (np.concatenate(c) for c in zip(*[P.unpack(b, False) for b in blobs]))
        self.users, self.ys = users, xs - np.repeat(means, sizes)
        self.items, dense = np.unique(ids, return_inverse=True)
        row = np.repeat(np.arange(len(users)), sizes)
        self.keys = row * len(self.items) + dense
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.key_ys = self.keys[order], self.ys[order]
        by_item = np.argsort(dense, kind="stable")
        self.row, self.item_ys = row[by_item], self.ys[by_item]
        self.ends = np.searchsorted(dense[by_item], np.arange(len(self.items) + 1))
        self.bits = max(10, int(8 * len(self.items)).bit_length())
        self.some = np.zeros(1 << self.bits, bool)
        self.some[P.bucket_of(self.items, 1 << self.bits)] = True

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` of the bucket's items, and which ones they are."""
        there = np.flatnonzero(self.some[P.bucket_of(ids, 1 << self.bits)])
        dense = np.minimum(np.searchsorted(self.items, ids[there]), len(self.items) - 1)
        same = self.items[dense] == ids[there]
        return there[same], dense[same]

    def met(self, sent: pa.Buffer, asked: pa.Buffer, least: int) -> Iterator[list[np.ndarray]]:
        """(user_id, item_id, nbr_id, residual, xy, xx, yy, n) of each asked item's raters who share ``least`` items with the user."""
        users, means, _, sizes, ids, xs = P.unpack(sent, False)
        n_asked, wanted = P.unpack(asked, False)[3:5]
        xs = xs - np.repeat(means, sizes)
        there, dense = self.find(ids)
        count = np.bincount(np.repeat(np.arange(len(users)), sizes)[there], minlength=len(users))
        first, xs = np.cumsum(count) - count, xs[there]
        asks, which = self.find(wanted)
        of = np.repeat(np.arange(len(users)), n_asked)[asks]
        n_raters = self.ends[which + 1] - self.ends[which]
        for at, to in P.chunks(n_raters * np.maximum(count[of], 1), AT_ONCE):
            n = n_raters[at:to]
            u, item, place = np.repeat(of[at:to], n), np.repeat(self.items[which[at:to]], n), P.spans(self.ends[which[at:to]], n)
            v = self.row[place]
            stay = (count[u] >= 1) & (self.users[v] != users[u])
            u, item, place, v = (c[stay] for c in (u, item, place, v))
            n = count[u]
            pair, entry = np.repeat(np.arange(len(u)), n), P.spans(first[u], n)
            keys = np.repeat(v, n) * len(self.items) + dense[entry]
            low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
            times = high - low
            pair, x, y = np.repeat(pair, times), xs[np.repeat(entry, times)], self.key_ys[P.spans(low, times)]
            shared = np.bincount(pair, minlength=len(u))
            enough = shared >= least
            sums = [np.bincount(pair, c, len(u))[enough] for c in (x * y, x * x, y * y)]
            yield [users[u[enough]], item[enough], self.users[v[enough]], self.item_ys[place[enough]], *sums, shared[enough]]


NAMES = ["user_id", "item_id", "nbr_id", "residual", "xy", "xx", "yy", "n"]


def _meet(least: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's rows (kind, sent, asked): what ``Bucket.met`` finds."""

    def run(group: pa.Table) -> pa.Table:
        kind, sent, asked = group["kind"].to_numpy(), group["sent"], group["asked"]
        own = [sent[int(k)].as_buffer() for k in np.flatnonzero(kind == OWN)]
        out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 4 + [np.zeros(0, np.int64)]]
        if own:
            bucket = Bucket(own)
            for k in np.flatnonzero(kind == ASKING):
                out += bucket.met(sent[int(k)].as_buffer(), asked[int(k)].as_buffer(), least)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=NAMES)

    return run


def raters_met(pairs: DataFrame, train: DataFrame, least: int, shrinkage: float) -> DataFrame:
    """(user_id, item_id, nbr_id, sim, residual): the raters of each pair's item whose similarity to the user is not 0."""
    bound_batches(train.sparkSession)
    mean = F.avg("rating").over(Window.partitionBy("user_id"))
    rows = train.select(F.col("user_id").cast("long").alias("user"), F.col("item_id").cast("long").alias("item"), F.coalesce("rating", mean, F.lit(0.0)).cast("double").alias("x"), F.coalesce(mean, F.lit(0.0)).alias("m"))
    rows = rows.where("user IS NOT NULL AND item IS NOT NULL")
    total = train.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET).cast("int")).alias("buckets"))
    own = F.pmod(F.xxhash64("user"), F.col("buckets")).cast("int").alias("own")
    asked = pairs.select(F.col("user_id").cast("long").alias("user"), F.col("item_id").cast("long").alias("item")).where("user IS NOT NULL AND item IS NOT NULL").distinct()
    placed = rows.select("user", "item").join(asked.select("item").distinct(), "item", "left_semi").crossJoin(F.broadcast(total)).select("item", own)
    where = placed.repartition("item").groupBy("item").agg(F.collect_set("own").alias("buckets"))
    asks = asked.join(where, "item").groupBy("user").agg(F.collect_list(F.struct("item", "buckets")).alias("asks"))
    lists = rows.groupBy("user").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("item", "x"))).alias("e"))
    known = lists.join(asks, "user", "left").crossJoin(F.broadcast(total))
    known = known.select("user", own, "m", F.col("e.item").alias("ids"), F.col("e.x").alias("xs"), F.col("asks.item").alias("asked"), F.col("asks.buckets").alias("buckets"))
    sent = known.mapInArrow(_send(AT_ONCE), "a long, kind int, sent binary, asked binary").repartition("a")
    found = sent.groupBy("a").applyInArrow(_meet(least), "user_id long, item_id long, nbr_id long, residual double, xy double, xx double, yy double, n long")
    kinds = {"user_id": train.schema["user_id"].dataType, "item_id": train.schema["item_id"].dataType, "nbr_id": train.schema["user_id"].dataType}
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], shrunk_users(shrinkage).alias("sim"), "residual").where("sim <> 0")


def user_knn_neighbors(pairs: DataFrame, train: DataFrame, k: int, least: int, shrinkage: float) -> DataFrame:
    """(user_id, item_id, nbr_id, sim, residual): of an item's raters the k most similar to the user."""
    return strongest(raters_met(pairs, train, least, shrinkage), ["user_id", "item_id"], "nbr_id", k)
