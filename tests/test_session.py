from lorekiln.session import hot_join


def test_hot_join_equals_join(spark):
    """A key with half of all rows, null keys and keys without a partner."""
    rows = [("hot", k) for k in range(3000)] + [(f"k{k}", k) for k in range(3000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "key string, n int")
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("none", 3), (None, 4)], "key string, v int")
    for how in ("left", "inner"):
        assert sorted(hot_join(left, right, ["key"], how).collect(), key=str) == sorted(left.join(right, "key", how).collect(), key=str)


def test_hot_join_empty(spark):
    left = spark.createDataFrame([], "key string, n int")
    assert hot_join(left, spark.createDataFrame([("a", 1)], "key string, v int"), ["key"]).count() == 0


def test_stored_tables_are_released(spark):
    import os

    from lorekiln import session

    stored = session.store(spark.range(5), "numbers")
    folder = next(f for f in session._STORED if "/numbers-" in f).removeprefix("file:")
    assert stored.count() == 5 and os.path.isdir(folder)
    assert session.release(spark) >= 1 and not os.path.exists(folder)
