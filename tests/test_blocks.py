"""The ranking trainer in blocks: draws, and one task for all epochs against epochs in stages."""

import numpy as np
import pandas as pd

from affinis.operators import blocks
from affinis.schema import Params


def test_draws_are_free_items():
    """User 1 has rated all of 6 places, user 2 all but place 4, user 3 one."""
    rows = [(1, k, True) for k in range(6)] + [(2, k, k < 2) for k in range(6) if k != 4] + [(3, 5, True)]
    rated = pd.DataFrame(rows, columns=["user_id", "place", "liked"])
    got = blocks.draw(rated, 6, 200, [1])
    assert got.groupby(["user_id", "item_id"]).size().to_dict() == {(2, 0): 200, (2, 1): 200, (3, 5): 200}
    assert set(got[got.user_id == 2].negative) == {4} and set(got[got.user_id == 3].negative) == {0, 1, 2, 3, 4}
    assert got.equals(blocks.draw(rated.sample(frac=1, random_state=0), 6, 200, [1]))


def test_one_task_is_the_epochs(spark):
    rng = np.random.default_rng(0)
    rows = [(u, 7 * i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(12) for i in range(10) if rng.random() < 0.5]
    train = spark.createDataFrame(rows + [(50, 7, 1.0)], "user_id long, item_id long, rating double")
    p = Params(factors=3, bpr_rate=0.05, bpr_grid=(0.0025,))
    once, staged = ({(r.side, r.id): r for r in blocks.bpr_blocks(train, p, 2, one_task=most).collect()} for most in (1 << 24, 0))
    assert set(once) == set(staged) and ("items", 63) in once and not once["users", 50].seen
    for key, r in once.items():
        assert r.seen == staged[key].seen and np.allclose(r.factors, staged[key].factors, atol=1e-12)
    assert any(x != 0 for x in once["users", 0].factors)
