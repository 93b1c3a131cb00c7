"""Dense ranks on the many-cell path: skew, ties, odd values, any partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowdeck.operators import ordering, ranking, shuffles


def sort_key(value):
    if value is None:
        return (2, 0)
    if isinstance(value, float) and math.isnan(value):
        return (1, 0)
    return (0, value)


def check_sort(spark, values, kind, partitions=3):
    frame = spark.createDataFrame(list(enumerate(values)), f"pos bigint, v {kind}").repartition(partitions)
    got = {r["pos"]: r["new_pos"] for r in ordering.stable_sort(frame, "v").collect()}
    order = sorted(range(len(values)), key=lambda i: (sort_key(values[i]), i))
    assert got == {pos: rank for rank, pos in enumerate(order)}


@pytest.mark.parametrize(
    "name,values,kind",
    [
        ("empty", [], "bigint"),
        ("one", [5], "bigint"),
        ("all equal", [3] * 300, "int"),
        ("hot third", [1] * 100 + list(range(200)), "bigint"),
        ("two hot", [9, 1] * 120 + [5] * 20 + list(range(-30, 30)), "bigint"),
        ("hot at both ends", [0.0] * 90 + [i / 2 for i in range(1, 60)] + [99.0] * 90, "double"),
        ("nulls and NaN", [None, float("nan"), 1.0, 2.0] * 70, "double"),
        ("only nulls", [None] * 200, "double"),
        ("infinities", [float("inf"), -float("inf"), 0.0, 1e308] * 60, "double"),
        ("float", [0.5, 0.25, 0.1] * 70, "float"),
        ("long beyond double", [2**53, 2**53 + 1, 2**53 - 1, 2**62, 2**62 + 1] * 60, "bigint"),
        ("extreme longs", [2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1] * 60, "bigint"),
    ],
)
def test_stable_sort(spark, tiny_cells, name, values, kind):
    check_sort(spark, values, kind)


def test_stable_sort_random(spark, tiny_cells):
    draw = random.Random(1)
    check_sort(spark, [draw.choice([7, draw.randrange(1000)]) for _ in range(1500)], "bigint", 5)


def test_hot_value_is_cut_into_many_cells(spark, tiny_cells):
    """A value with all rows must not end in one task."""
    frame = spark.range(4000).select(F.col("id").alias("_value") * 0, F.col("id").alias("_tie"))
    frame = frame.toDF("_value", "_tie")
    sizes = [r["count"] for r in ranking._cut(frame, 4000, 16).groupBy("_cell").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 4000 / 16


def test_same_result_for_any_partitioning_and_cell_size(spark, monkeypatch):
    results = set()
    for cell_rows in (1 << 17, 64, 16):
        monkeypatch.setattr(ranking, "CELL_ROWS", cell_rows)
        for partitions in (1, 3, 8):
            frame = spark.range(0, 500, 1, partitions)
            rows = shuffles.keyed_shuffle(frame, "id", 11).collect()
            results.add(tuple(sorted(map(tuple, rows))))
    assert len(results) == 1


def test_output_is_laid_out_in_order(spark, tiny_cells):
    rows = shuffles.keyed_shuffle(spark.range(500), "id", 3).collect()
    assert [r["pos"] for r in rows] == list(range(500))


def test_only_numbers_are_sorted(spark):
    with pytest.raises(TypeError):
        ordering.stable_sort(spark.range(3).withColumn("v", F.lit("x")), "v", "id")


def test_existing_column_is_refused(spark):
    with pytest.raises(ValueError):
        shuffles.keyed_shuffle(spark.range(3), "id", 1, out="id")
    with pytest.raises(ValueError):
        ordering.stable_sort(spark.range(3), "id", "id", out="id")


# input and golden order of the digit sort: counts of 1 .. 10, units digit first
COUNTS = {1: 14, 2: 9, 3: 4, 4: 7, 5: 22, 6: 11, 7: 11, 8: 6, 9: 8, 10: 8}


def test_digit_order_golden(spark, tiny_cells):
    values = [v for v, n in COUNTS.items() for _ in range(n)]
    random.Random(2).shuffle(values)
    frame = spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint")
    rows = ordering.radix_order(frame, "v").orderBy("new_pos").collect()
    assert [r["v"] for r in rows] == [10] * 8 + [v for v in range(1, 10) for _ in range(COUNTS[v])]


def test_digit_order_negatives_and_wide_numbers(spark):
    def brute(values):
        places = len(str(max(values)))
        return sorted(range(len(values)), key=lambda i: ([(values[i] // 10**d) % 10 for d in range(places)], i))

    for values in ([5, -5, 12, -12, 0, 100, -1], [-3, -12, -7], [2**62, 10**18, 7, 9 * 10**18, -4]):
        frame = spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint")
        rows = ordering.radix_order(frame, "v").orderBy("new_pos").collect()
        assert [r["pos"] for r in rows] == brute(values)


def test_lane_order(spark):
    table = spark.createDataFrame([(0, 5, 2.0), (1, 3, 1.0), (2, 4, 2.0), (3, 0, 0.5)], "lane bigint, rows bigint, m double")
    got = {r["lane"]: (r["rank"], r["offset"]) for r in ordering.lane_offsets(table, "m").collect()}
    assert got == {3: (0, 0), 1: (1, 0), 0: (2, 3), 2: (3, 8)}
