"""Negatives below a bound of hashes are those of the whole sort."""

from affinis.operators import candidates as C


def test_drawn_negatives_are_the_sorted_ones(spark):
    """User 1 knows little of 3,000 items, user 2 all but 12, user 3 all but 3."""
    rows = [(0, k) for k in range(3000)] + [(1, 5), (1, 6)] + [(2, k) for k in range(12, 3000)] + [(3, k) for k in range(3, 3000)]
    train = spark.createDataFrame(rows, "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    want = sorted(map(tuple, C.negatives(C.unobserved(users, train, train), 10, 7).collect()))
    assert sorted(map(tuple, C.drawn_negatives(users, train, train, 10, 7).collect())) == want and len(want) == 23
    # a bound too low for anybody: the rest is brought in
    kept = []
    low = C.drawn_negatives(users, train, train, 10, 7, lambda df: kept.append(df) or (df.withColumn("bound", C.F.lit("0")) if "bound" in df.columns else df))
    assert sorted(map(tuple, low.collect())) == want and len(kept) == 2
