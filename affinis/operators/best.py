"""The best items of a whole catalogue for some users by latent factors, without a row for each user and item.

Items stay where they are; the users, who are few, go to them. A product of matrices over a block of items rules out those that
cannot be among a user's best; the others' predictions are summed and rounded as ``factors.mf_value`` does, and each task
returns the best of each user.

Defined results: those of numbering ``factors.mf_scores`` of all unobserved items. A side without factors, with a null among them or with
another number of them than the users' adds no product; NaN is above all numbers; an item without an id is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.workers import bound_batches

#: Users, and items that these know, that are sent to all tasks; and predictions that a task holds at once.
USERS, KNOWN, AT_ONCE = 4096, 1_000_000, 1 << 20
_DIGITS, _EXACT = Decimal("1e-9"), Context(prec=400, rounding=ROUND_HALF_UP)


def _rounded(values: np.ndarray) -> np.ndarray:
    """As Spark's round to nine decimals: half up of the shortest decimal."""
    few, place = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(float(x))).quantize(_DIGITS, context=_EXACT)) if np.isfinite(x) else x for x in few])[place]


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each vector, and whether it is one; zeros where it is null, holds a null or has another size."""
    out = np.zeros((len(column), size))
    if not len(column) or not size:
        return out, np.zeros(len(column), bool)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without those of null rows
    fits = sizes == size
    if flat.null_count == 0 and fits.all():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, size), fits
    held = np.maximum(sizes, 0)
    at, null = np.cumsum(held) - held, np.cumsum(np.concatenate(([0], flat.is_null().to_numpy(zero_copy_only=False))))
    fits &= null[at + held] == null[at]
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(fits):
        out[k] = values[at[k] : at[k] + size]
    return out, fits


def _finder(ids: np.ndarray, bias: np.ndarray, p: np.ndarray, trained: np.ndarray, known: tuple[np.ndarray, np.ndarray], mu: float, n: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of items (item_id, bias, factors): the n best (user_id, item_id, prediction) of each user. ``known``: items in order, and the users' places."""
    step, norms = max(1, at_once // max(1, len(ids))), np.sqrt((p * p).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users, items, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            item = batch["item_id"].to_numpy(zero_copy_only=False)
            own = batch["bias"].fill_null(0.0).to_numpy(zero_copy_only=False)
            factors, fits = _vectors(batch["factors"], p.shape[1])
            for at in range(0, len(item), step):
                i, b, q, has = (x[at : at + step] for x in (item, own, factors, fits))
                with np.errstate(all="ignore"):
                    a = p @ q.T
                    a[~trained], a[:, ~has] = 0.0, 0.0
                    a += bias[:, None] + b + mu
                    a[np.isnan(a)] = np.inf
                    slack = 1e-8 + 1e-12 * (norms * np.sqrt((q * q).sum(axis=1).max()) + np.abs(bias) + np.abs(b).max() + abs(mu))
                    order = np.argsort(i, kind="stable")
                    lo, hi = np.searchsorted(known[0], i[order], "left"), np.searchsorted(known[0], i[order], "right")
                    row = np.concatenate([known[1][s:e] for s, e in zip(lo, hi, strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
                    column = np.repeat(order, hi - lo)
                    a[row, column] = -np.inf
                    floor = np.maximum(least, np.partition(a, len(i) - n, axis=1)[:, len(i) - n]) if len(i) > n else least
                    floor = floor - slack
                    keep = a >= np.where(np.isnan(floor), -np.inf, floor)[:, None]
                    keep[row, column] = False
                    r, c = np.nonzero(keep)
                    if not len(r):
                        continue
                    s = np.zeros(len(r))
                    for k in range(p.shape[1]):
                        s += p[r, k] * q[c, k]
                    s[~(trained[r] & has[c])] = 0.0
                    v = _rounded(((mu + bias[r]) + b[c]) + s)
                users, items, values = np.concatenate((users, r)), np.concatenate((items, i[c])), np.concatenate((values, v))
                best = np.lexsort((items, -np.where(np.isnan(values), np.inf, values), ~np.isnan(values), users))
                users, items, values = users[best], items[best], values[best]
                nth = np.arange(len(users)) - np.searchsorted(users, users, "left")
                users, items, values, nth = (x[nth < n] for x in (users, items, values, nth))
                full = nth == n - 1
                least[users[full]] = np.where(np.isnan(values[full]), np.inf, values[full])
        if len(users):
            yield pa.RecordBatch.from_arrays([pa.array(ids[users]), pa.array(items), pa.array(values)], ["user_id", "item_id", "prediction"])

    return run


def best_by_factors(asked: DataFrame, users: DataFrame, items: DataFrame, known: DataFrame, mu: DataFrame, n: int, at_once: int = AT_ONCE) -> DataFrame | None:
    """(user_id, item_id, prediction): each task's best of ``items`` (item_id, factors, bias) for each user; None if the users are too many.

    ``asked``: (user_id), ``users``: (user_id, factors, bias), ``known``: (user_id, item_id), which are none of the user's.
    """
    rows = asked.join(users, "user_id", "left").select("user_id", F.col("factors").cast("array<double>"), F.col("bias").cast("double")).limit(USERS + 1).toArrow().combine_chunks()
    seen = known.join(F.broadcast(asked), "user_id", "left_semi").select("user_id", "item_id").where("item_id IS NOT NULL")
    seen = seen.limit(KNOWN + 1).toArrow() if rows.num_rows <= USERS else None
    factors = rows["factors"].combine_chunks()
    sizes = {x for x in factors.value_lengths().to_pylist() if x is not None}
    if seen is None or seen.num_rows > KNOWN or len(sizes) > 1:
        return None
    ids = rows["user_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    p, trained = (x[order] for x in _vectors(factors, max(sizes, default=0)))
    bias, ids = rows["bias"].fill_null(0.0).to_numpy()[order], ids[order]
    item, place = seen["item_id"].to_numpy(), np.searchsorted(ids, seen["user_id"].to_numpy())
    by_item = np.argsort(item, kind="stable")
    mean = mu.first()[0]
    bound_batches(items.sparkSession)
    run = _finder(ids, bias, p, trained, (item[by_item], place[by_item]), np.nan if mean is None else float(mean), n, at_once)
    of = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("prediction", T.DoubleType())])
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("bias").cast("double"), F.col("factors").cast("array<double>"))
    return rows.mapInArrow(run, of)
