"""Equal intervals of two masks are a tie in the order of a union's windows; the union is the same whatever their order."""

from pulsegrid.operators import intervals as iv


def test_equal_intervals_of_two_masks(spark):
    high = spark.createDataFrame([(1, 3, 5), (1, 7, 8), (1, 9, 12)], "rec long, start long, end_excl long")
    error = spark.createDataFrame([(1, 1, 2), (1, 7, 8), (1, 12, 13)], "rec long, start long, end_excl long")
    for masks in ((high, error), (error, high)):
        got = sorted(tuple(r) for r in iv.union(*masks).collect())
        assert got == [(1, 1, 2), (1, 3, 5), (1, 7, 8), (1, 9, 13)]
