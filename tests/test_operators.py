import pytest

from tessera.operators import frames


def test_asof_and_islands(spark):
    left = spark.createDataFrame([(k,) for k in range(8)], "t long")
    right = spark.createDataFrame([(2, "a"), (5, "b")], "t long, v string")
    got = {r["t"]: r["v"] for r in frames.asof(left, right, "t", ["v"]).collect()}
    assert got == {0: None, 1: None, 2: "a", 3: "a", 4: "a", 5: "b", 6: "b", 7: "b"}
    at = spark.createDataFrame([("k", t) for t in (1, 2, 4, 9, 10)], "g string, t long")
    got = sorted((r["first"], r["last"], r["n"]) for r in frames.islands(at, ["g"], "t", gap=2).collect())
    assert got == [(1, 4, 3), (9, 10, 2)]


def test_nearest_takes_the_lowest_of_equals(spark):
    points = spark.createDataFrame([(1, 5), (2, 0)], "id long, v long")
    centres = spark.createDataFrame([(7, 4), (3, 6)], "centre long, v long")
    assert {r["id"]: r["centre"] for r in frames.nearest(points, centres, ["v"]).collect()} == {1: 3, 2: 7}
    with pytest.raises(ValueError):
        frames.nearest(points, centres, ["v"], most=1)
