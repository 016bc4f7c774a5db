"""The sequential trainers take steps together that share no user and no item: the same as a loop over the ratings."""

from threading import Barrier
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest

from affinis.operators import trainers
from affinis.schema import Params

P = Params(factors=5, mf_rate=0.02, bpr_rate=0.05)


def ratings(users, items, n, hot=False):
    rng = np.random.default_rng(1)
    i = np.minimum(rng.geometric(0.1, n) - 1, items - 1) if hot else rng.integers(0, items, n)
    rows = pd.DataFrame({"user_id": 7 * rng.integers(0, users, n), "item_id": 3 * i + 1, "rating": rng.integers(1, 11, n) / 2})
    return rows.drop_duplicates(["user_id", "item_id"]).reset_index(drop=True)


def plain_mf(rows, reg, epochs):
    rng = np.random.default_rng(P.seed)
    (users, u), (items, i) = (np.unique(rows[c], return_inverse=True) for c in ("user_id", "item_id"))
    r = rows["rating"].to_numpy()
    bu, bi, pu, qi = np.zeros(len(users)), np.zeros(len(items)), rng.normal(0, P.mf_scale, (len(users), P.factors)), rng.normal(0, P.mf_scale, (len(items), P.factors))
    order = np.arange(len(r))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            a, b, x, y = u[k], i[k], pu[u[k]].copy(), qi[i[k]].copy()
            e = r[k] - (r.mean() + bu[a] + bi[b] + x @ y)
            bu[a] += P.mf_rate * (e - reg * bu[a])
            bi[b] += P.mf_rate * (e - reg * bi[b])
            pu[a] += P.mf_rate * (e * y - reg * x)
            qi[b] += P.mf_rate * (e * x - reg * y)
    return {"users": (users, bu, pu), "items": (items, bi, qi)}


def plain_bpr(rows, reg, epochs):
    rng = np.random.default_rng(P.seed)
    (users, u), (items, i) = (np.unique(rows[c], return_inverse=True) for c in ("user_id", "item_id"))
    liked, rated = np.flatnonzero(rows["rating"] >= P.relevance), set(zip(u, i))
    known = np.bincount(u)
    pu, qi = rng.normal(0, P.bpr_scale, (len(users), P.factors)), rng.normal(0, P.bpr_scale, (len(items), P.factors))
    moved = set()
    for _ in range(epochs):
        rng.shuffle(liked)
        for a, b in ((u[k], i[k]) for k in liked if known[u[k]] < len(items)):
            for _ in range(P.bpr_negatives):
                j = rng.integers(len(items))
                while (a, j) in rated:
                    j = rng.integers(len(items))
                x, y, z = pu[a].copy(), qi[b].copy(), qi[j].copy()
                g = 1 / (1 + np.exp(x @ (y - z)))
                pu[a] += P.bpr_rate * (g * (y - z) - reg * x)
                qi[b] += P.bpr_rate * (g * x - reg * y)
                qi[j] += P.bpr_rate * (-g * x - reg * z)
                moved |= {("u", a), ("i", b), ("i", j)}
    for side, factors in (("u", pu), ("i", qi)):
        factors[[k for k in range(len(factors)) if (side, k) not in moved]] = 0
    return {"users": (users, np.zeros(len(users)), pu), "items": (items, np.zeros(len(items)), qi)}


@pytest.mark.parametrize("shape", [(60, 40, 600, False), (15, 10, 120, False), (100, 30, 800, True), (30, 1, 30, False)])
def test_steps_together_are_the_loop(monkeypatch, shape):
    monkeypatch.setattr(trainers, "WIDE", 256)
    monkeypatch.setattr(trainers, "AHEAD", 100)
    rows = ratings(*shape)
    for train, plain in ((trainers.train_mf, plain_mf), (trainers.train_bpr, plain_bpr)):
        got, want = train(rows, 0.02, P, 3)[0], plain(rows, 0.02, 3)
        for side in ("users", "items"):
            for a, b in zip(got[side], want[side]):
                assert np.allclose(a, b, rtol=0, atol=1e-10)


def test_few_calls_and_each_row_in_turn():
    rng = np.random.default_rng(2)
    touched = np.stack([rng.integers(0, 5000, 30_000), 5000 + rng.integers(0, 4000, 30_000)], 1)
    touched[100:200, 0], touched[20_000:20_300] = 3, (4, 5004)
    version, seen, calls = np.zeros(9000, int), np.zeros(touched.shape, int), 0

    def step(at):
        nonlocal calls
        calls += 1
        assert len(np.unique(touched[at])) == touched[at].size
        seen[at] = version[touched[at]]
        version[touched[at]] += 1

    trainers.in_turn(touched, 9000, step)
    want = pd.Series(touched.ravel()).groupby(touched.ravel()).cumcount().to_numpy().reshape(touched.shape)
    assert (seen == want).all() and calls < 1000


def test_a_step_is_not_a_rating(monkeypatch):
    """Before, a product of factors was made for each rating; now one for each set of independent ones."""
    calls = []
    monkeypatch.setattr(trainers.np, "einsum", lambda *a, f=np.einsum: calls.append(len(a[1])) or f(*a))
    rows = ratings(2000, 1500, 6000)
    trainers.train_mf(rows, 0.02, P, 1, False)
    assert sum(calls) == len(rows) and len(calls) < len(rows) / 50


def test_both_models_train_at_the_same_time(monkeypatch):
    from affinis.plans import queries

    both = Barrier(2, timeout=20)
    w = MagicMock(train_model=lambda m: both.wait() * 0 or m)
    monkeypatch.setattr(queries, "Workspace", lambda *a, **options: MagicMock(**options))
    assert queries._trained(w).models == {"mf": "mf", "bpr": "bpr"}
