"""Shrunk similarities of items over common raters, and of users over common items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import steady
from affinis.functions.workers import bound_batches
from affinis.operators import packing as P
from affinis.operators.prepare import centered


#: Rows of one key that meet each other in one task; a key of more is cut into blocks of about so many.
HOT_ROWS = 2000
#: Ratings of one id whose pairs are summed in one bucket; the pairs of an id of more are dealt to parts.
HOT_PAIRS = 100_000
#: Pairs that a worker holds to send or to sum them.
PAIRS_AT_ONCE = 1 << 21


def blocks_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, blocks) of the keys with more than HOT_ROWS rows: at most a row for each HOT_ROWS rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    return counts.select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("blocks"))


def dealt(rows: DataFrame, key: str, hot: DataFrame, own: str, other: str, by: str) -> DataFrame:
    """Each row in its block ``own`` of its key, once for each block ``other`` of the rows that it is to meet."""
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn(own, F.pmod(F.xxhash64(by), blocks).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")


def packed(rows: DataFrame) -> DataFrame:
    """(on, i, blocks, m, e): what meets over a key, as an array of (id, x, parts) in the order of ids; a hot key has several blocks."""
    rows = rows.join(blocks_of(rows.select("on"), "on"), "on", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return rows.groupBy("on", "i", "blocks").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("id", "x", "parts"))).alias("e"))


def met(lists: DataFrame) -> DataFrame:
    """(m, ids, xs, parts, f_ids, f_xs): lists that meet the list f, or themselves where that is null: the blocks of a hot key meet each other, too."""
    fields = [F.col(f"e.{c}").alias(n) for c, n in (("id", "ids"), ("x", "xs"), ("parts", "parts"))]
    own = lists.select("m", *fields, F.lit(None).cast("array<long>").alias("f_ids"), F.lit(None).cast("array<double>").alias("f_xs"))
    hot = lists.where("blocks > 1").select("on", "m", "i", "e")
    other = hot.select("on", F.col("i").alias("j"), F.col("e.id").alias("f_ids"), F.col("e.x").alias("f_xs"))
    return own.unionByName(hot.join(other, "on").where("i <> j").select("m", *fields, "f_ids", "f_xs"))


def _messages(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, ...]:
    """Of a batch of lists that meet: (bucket, key, base, x, start, size) of each row's later ids, which are (ids, xs) from start on."""
    (sizes, ids), (_, xs), (_, parts) = (P.lists(batch[c]) for c in ("ids", "xs", "parts"))
    (f_sizes, f_ids), (_, f_xs) = (P.lists(batch[c]) for c in ("f_ids", "f_xs"))
    ids, xs, parts, f_ids, f_xs = map(P.filled, (ids, xs, parts, f_ids, f_xs))
    ends, row = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (row[1:] != row[:-1])) + 1
    stops = np.concatenate((new, [len(ids)]))
    start, stop = stops[np.searchsorted(stops, np.arange(len(ids)), "right")] if len(ids) else stops[:0], ends[row]
    f_ends = np.cumsum(f_sizes)
    for r in np.flatnonzero(P.filled(batch["f_ids"].is_valid())):  # blocks of hot keys
        low, high = f_ends[r] - f_sizes[r], f_ends[r]
        here = slice(ends[r] - sizes[r], ends[r])
        start[here] = len(ids) + low + np.searchsorted(f_ids[low:high], ids[here], "right")
        stop[here] = len(ids) + high
    key, base, x, size = ids, P.filled(batch["m"])[row], xs, stop - start
    ids, xs = np.concatenate((ids, f_ids)), np.concatenate((xs, f_xs))
    bucket, stays = P.bucket_of(key, buckets), size > 0
    hot = np.flatnonzero(stays & (parts > 1))
    if len(hot):  # the later ids of a hot id are dealt to its parts
        stays[hot] = False
        more, places, at = [], [], len(ids)
        for k in hot:
            there = np.arange(start[k], stop[k])
            part = P.bucket_of(ids[there], int(parts[k]))
            there = there[np.argsort(part, kind="stable")]
            for p, n in zip(*np.unique(part, return_counts=True)):
                more.append((k, (bucket[k] + p) % buckets, at, n))
                at += n
            places.append(there)
        places = np.concatenate(places)
        ids, xs = np.concatenate((ids, ids[places])), np.concatenate((xs, xs[places]))
        k, to, at, n = np.array(more, np.int64).T
        pick = [(c[stays], d) for c, d in ((bucket, to), (key, key[k]), (base, base[k]), (x, x[k]), (start, at), (size, n))]
        return *map(np.concatenate, pick), ids, xs
    return *(c[stays] for c in (bucket, key, base, x, start, size)), ids, xs


def _send_pairs(at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of lists that meet: (a, sent), what goes to each bucket of ids, in chunks of some ``at_once`` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *messages, ids, xs = _messages(batch, batch["buckets"][0].as_py())
            for at, to in P.chunks(messages[-1], at_once):
                bucket, key, base, x, start, size = (c[at:to] for c in messages)
                order = np.lexsort((key, bucket))
                bucket, key, base, x, start, size = (c[order] for c in (bucket, key, base, x, start, size))
                place, ends = P.spans(start, size), np.concatenate(([0], np.cumsum(size)))
                cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
                sent = []
                for low, high in zip(cuts[:-1], cuts[1:]):
                    there = place[ends[low] : ends[high]]
                    sent.append(P.pack(key[low:high], base[low:high], x[low:high], size[low:high], ids[there], xs[there]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(sent, pa.binary())], names=["a", "sent"])

    return run


def _pair_sums(least: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's rows (a, sent): (a, b, xy, xx, yy, n) of the pairs that are there ``least`` times."""

    def run(group: pa.Table) -> pa.Table:
        cols = []
        for blob in group["sent"]:
            key, base, x, sizes, ids, ys = P.unpack(blob.as_buffer())
            base = np.repeat(base, sizes)
            cols.append((np.repeat(key, sizes), ids, np.repeat(x, sizes) - base, ys - base))
        a, b, x, y = (np.concatenate(c) for c in zip(*cols))
        del cols
        ids, place = np.unique(a, return_inverse=True)
        low, high = int(b.min()), int(b.max())
        if len(ids) * (high - low + 1) < 1 << 63:
            key = place * (high - low + 1) + (b - low)
            order = np.argsort(key)
            key = key[order]
            new = key[1:] != key[:-1]
        else:
            order = np.lexsort((b, place))
            new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        n = np.diff(np.concatenate(([0], np.flatnonzero(new) + 1, [len(order)])))
        order, n = order[np.repeat(n >= least, n)], n[n >= least]
        starts = np.cumsum(n) - n
        x, y = x[order], y[order]
        sums = [np.add.reduceat(c, starts) if len(n) else c[:0] for c in (x * y, x * x, y * y)]
        return pa.Table.from_arrays([pa.array(c) for c in (a[order[starts]], b[order[starts]], *sums, n)], names=["a", "b", "xy", "xx", "yy", "n"])

    return run


def pair_stats(train: DataFrame, of: str, over: str, least: int) -> DataFrame:
    """(a, b, xy, xx, yy, n) for a < b: sums over what both share, at least ``least`` of it.

    Most pairs share a single thing, so sums on the mappers save nothing. The ids are dealt to buckets of some PAIRS_AT_ONCE
    pairs each; a row goes to its id's bucket once, with the later ids that it meets, and pairs are made where they are summed:
    of a pair, the shuffle holds some two bytes. A user or item with very many ratings is cut into blocks, and each pair of
    blocks is met by itself; the pairs of an id with very many are dealt to several buckets by their other id. Rows without a
    user or item meet none; a null rating adds nothing.
    """
    bound_batches(train.sparkSession)
    mean = F.avg("rating").over(Window.partitionBy("user_id"))
    rows = train.select(F.col(of).cast("long").alias("id"), F.col(over).alias("on"), F.coalesce("rating", mean, F.lit(0.0)).cast("double").alias("x"), F.coalesce(mean, F.lit(0.0)).alias("m"))
    if over != "user_id":  # there the users' means differ within a list
        rows = rows.withColumn("x", F.col("x") - F.col("m")).withColumn("m", F.lit(0.0))
    rows = rows.where("id IS NOT NULL AND on IS NOT NULL")
    parts = train.groupBy(F.col(of).cast("long").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS)
    parts = parts.select("id", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("parts"))  # at most a row for each HOT_PAIRS ratings
    rows = rows.join(F.broadcast(parts), "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sizes = train.where(F.col(of).isNotNull()).groupBy(over).agg(F.count("*").cast("double").alias("n"))
    total = sizes.agg(F.greatest(F.lit(1.0), F.ceil(F.sum(F.col("n") * (F.col("n") - 1)) / (2 * PAIRS_AT_ONCE))).cast("long").alias("buckets"))
    sent = met(packed(rows)).crossJoin(F.broadcast(total)).mapInArrow(_send_pairs(PAIRS_AT_ONCE), "a long, sent binary").repartition("a")
    sums = sent.groupBy("a").applyInArrow(_pair_sums(least), "a long, b long, xy double, xx double, yy double, n long")
    return sums.select(*[F.col(c).cast(train.schema[of].dataType).alias(c) for c in ("a", "b")], "xy", "xx", "yy", "n")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders. The pairs are made once: a union would make them for each of its sides."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
    return pairs.select(turned, *rest).select("w.a", "w.b", *rest)


def _sim(norm: Column, shrinkage: float) -> Column:
    n = F.col("n").cast("double")
    return steady(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / norm * (n / (n + F.lit(shrinkage)))).otherwise(F.lit(0.0)))


def shrunk_users(shrinkage: float) -> Column:
    """The similarity of two users with the sums xy, xx and yy over n common items."""
    return _sim(F.sqrt("xx") * F.sqrt("yy"), shrinkage)


def _shrunk(stats: DataFrame, sim: Column) -> DataFrame:
    return stats.select("a", "b", sim.alias("sim"), "n").where("sim <> 0")


def item_similarity(train: DataFrame, least: int, shrinkage: float) -> DataFrame:
    """(item_id, nbr_id, sim, support), both ways: adjusted cosine over common raters, times n / (n + shrinkage)."""
    stats = pair_stats(train, "item_id", "user_id", least)
    edges = both_ways(_shrunk(stats, _sim(F.sqrt(F.col("xx") * F.col("yy")), shrinkage)))
    return edges.select(F.col("a").alias("item_id"), F.col("b").alias("nbr_id"), "sim", F.col("n").alias("support"))


def user_similarity(train: DataFrame, least: int, shrinkage: float) -> DataFrame:
    """(user_id, nbr_id, sim, n_common), both ways: cosine of centred ratings of common items, times n / (n + shrinkage)."""
    stats = pair_stats(train, "user_id", "item_id", least)
    edges = both_ways(_shrunk(stats, shrunk_users(shrinkage)))
    return edges.select(F.col("a").alias("user_id"), F.col("b").alias("nbr_id"), "sim", F.col("n").alias("n_common"))


def user_similarity_to(train: DataFrame, users: DataFrame, least: int, shrinkage: float) -> DataFrame:
    """As ``user_similarity``, of the given users (user_id) alone: only their ratings meet the others'."""
    rows = centered(train).select("user_id", "item_id", "residual")
    hot = blocks_of(train, "item_id")
    mine = rows.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", F.col("residual").alias("x"))
    others = rows.select(F.col("user_id").alias("nbr_id"), "item_id", F.col("residual").alias("y"))
    met = dealt(mine, "item_id", hot, "i", "j", "user_id").join(dealt(others, "item_id", hot, "j", "i", "nbr_id"), ["item_id", "i", "j"]).where("user_id <> nbr_id")
    x, y = F.col("x"), F.col("y")
    sums = met.groupBy(F.col("user_id").alias("a"), F.col("nbr_id").alias("b")).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.count("*").alias("n")).where(F.col("n") >= least)
    edges = _shrunk(sums, shrunk_users(shrinkage))
    return edges.select(F.col("a").alias("user_id"), F.col("b").alias("nbr_id"), "sim", F.col("n").alias("n_common"))


def strongest(edges: DataFrame, keys: list[str], neighbor: str, k: int) -> DataFrame:
    """The k edges of each key with the largest absolute similarity; ties go to the smaller neighbour."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("sim")), neighbor)
    return edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
