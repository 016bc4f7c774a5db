"""What pairs and neighbours send is small, and comes out as it went in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import packing, similarity

RATED = "user_id long, item_id long, rating double"


def test_ratings_are_packed_without_loss():
    """about two bytes a rating where there are few different ones; ids and numbers of any size come back."""
    draw = np.random.default_rng(1)
    sizes = draw.integers(0, 40, 5000)
    ids = np.concatenate([np.sort(draw.integers(0, 20_000, n)) for n in sizes]) + 7
    key, base, x = np.sort(draw.integers(0, 7, 5000)), draw.random(5000), draw.integers(1, 6, 5000) / 2
    ys = draw.integers(1, 9, len(ids)) / 2
    blob = packing.pack(key, base, x, sizes, ids, ys)
    assert all(np.array_equal(a, b) for a, b in zip(packing.unpack(blob), (key, base, x, sizes, ids, ys)))
    assert len(blob) < 2.8 * len(ids)
    odd = np.array([-(1 << 62), -3, 0, 1 << 62]), np.array([0.0, -1.5, 2.0, 1e300]), np.array([np.nan, -0.0, 0.0, np.inf]), np.array([0, 2, 0, 1]), np.array([-(1 << 61), 5, 1 << 62]), draw.random(3)
    for after in (True, False):
        got = packing.unpack(packing.pack(*odd, after), after)
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, odd))
    none = packing.unpack(packing.pack(*[c[:0] for c in odd]))
    assert not any(len(c) for c in none)


def test_pairs_are_sent_packed(spark):
    """no shuffle has an array of ids and ratings for each rating."""
    train = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(9) for i in range(u % 3, 7)] + [(3, 3, None), (3, 3, 2.0)], RATED)
    found = similarity.pair_stats(train, "item_id", "user_id", 2)
    assert "RepartitionByExpression [a#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "sent#" in plan and "ys#" not in plan
    got = {(r.a, r.b): (r.n, round(r.xy, 9)) for r in found.collect()}
    rows = [r for r in train.withColumn("m", F.expr("avg(rating) over (partition by user_id)")).collect()]
    want = {}
    for p in rows:
        for q in rows:
            if p.user_id == q.user_id and p.item_id < q.item_id:
                n, s = want.get((p.item_id, q.item_id), (0, 0.0))
                x, y = ((0.0 if r.rating is None else r.rating - r.m) for r in (p, q))
                want[p.item_id, q.item_id] = n + 1, s + x * y
    assert set(got) == {k for k, v in want.items() if v[0] >= 2}
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-9)) for k in got)
