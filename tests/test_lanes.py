"""Closed-form lanes against lists dealt out by hand."""

import pytest
from pyspark.sql import functions as F

from rowdeck.operators import lanes as L


def dealt(rule, rows):
    """Lane number to positions, for each kind of rule."""
    name, k = rule
    out = [[] for _ in range(k)]
    for i in range(rows):
        if name == "strided":
            lane = i % k
        elif name == "diagonal":
            lane = (i + i // k) % k
        elif name == "ceil":
            lane = i // -(-rows // k)
        elif name == "floor":
            lane = min(i // (rows // k), k - 1) if rows // k else k - 1
        elif name == "balanced":
            lane = i * k // rows
        out[lane].append(i)
    return out


MAKERS = {
    "strided": L.Strided,
    "diagonal": L.Diagonal,
    "ceil": L.ceil_chunks,
    "floor": L.FloorChunks,
    "balanced": L.Balanced,
}


@pytest.mark.parametrize("name", sorted(MAKERS))
def test_rules_match_hand_dealt_lists(spark, name):
    for k in (1, 2, 3, 7):
        for rows in (0, 1, 2, k - 1, k, k + 1, 3 * k + 2, 50):
            rule = MAKERS[name](rows, k)
            lane = F.col("lane")
            got = {
                r["id"]: r
                for r in L.with_lane(spark.range(0, rows, 1, 2), rule, "id")
                .select(
                    "id",
                    "lane",
                    rule.rank(F.col("id")).alias("rank"),
                    rule.start(lane).alias("start"),
                    rule.size(lane).alias("size"),
                    rule.member(lane, rule.rank(F.col("id"))).alias("member"),
                )
                .collect()
            }
            start = 0
            for number, members in enumerate(dealt((name, k), rows)):
                assert len(members) <= rule.largest
                for rank, pos in enumerate(members):
                    row = got[pos]
                    assert (row["lane"], row["rank"], row["start"]) == (number, rank, start)
                    assert (row["size"], row["member"]) == (len(members), pos)
                start += len(members)
            assert len(got) == rows


@pytest.mark.parametrize("percent,head", [(0, 0), (30, 3), (29, 2), (100, 10), ("12.5", 1)])
def test_percent_split(spark, percent, head):
    rule = L.HeadTail(10, percent)
    parts = L.split(spark.range(10), rule, "id")
    assert [p.count() for p in parts] == [head, 10 - head]


def test_bad_arguments():
    with pytest.raises(ValueError):
        L.HeadTail(10, 101)
    with pytest.raises(ValueError):
        L.HeadTail(10, -1)
    with pytest.raises(ValueError):
        L.HeadTail.by_shares(10, 30, 60)
    assert L.HeadTail.by_shares(10, 30, 70).head == 3
    with pytest.raises(ValueError):
        L.Strided(10, 0)
    with pytest.raises(ValueError):
        L.Batches(10, 0)


def test_percent_is_exact_where_floats_fall_short(spark):
    # 100 * (29 / 100) is 28.999999999999996 in floats
    assert L.HeadTail(100, 29).head == 29


def test_half_rotate(spark):
    for rows, k in ((10, 2), (11, 3), (1, 4), (0, 2)):
        rule = L.ceil_chunks(rows, k)
        got = dict(L.half_rotate(spark.range(rows), rule, "id").collect())
        want, start = {}, 0
        for members in dealt(("ceil", k), rows) if rows else []:
            half = len(members) // 2
            for place, pos in enumerate(members[half:] + members[:half]):
                want[pos] = start + place
            start += len(members)
        assert got == want


def test_loads_and_extremes(spark):
    rows = L.with_lane(spark.range(10), L.Strided(10, 4), "id")
    loads = L.lane_loads(rows, "lane", F.col("id"))
    assert sorted(map(tuple, loads.collect())) == [(0, 3, 12), (1, 3, 15), (2, 2, 8), (3, 2, 10)]
    assert tuple(L.lane_extremes(loads).first()) == (0, 3, 2, 2)


def test_physical_lanes(spark):
    frame = L.repartition_lanes(spark.range(20), L.Strided(20, 3), "id")
    rows = frame.withColumn("part", F.spark_partition_id()).collect()
    assert frame.rdd.getNumPartitions() == 3 and all(r["part"] == r["id"] % 3 for r in rows)


def test_balanced_lanes_of_huge_tables(spark):
    rule = L.Balanced(10**11, 10**9)
    frame = spark.createDataFrame([(0,), (99,), (100,), (10**11 - 1,)], "pos bigint")
    got = [tuple(r) for r in frame.select(rule.lane(F.col("pos")), rule.rank(F.col("pos"))).collect()]
    assert got == [(0, 0), (0, 99), (1, 0), (10**9 - 1, 99)]


def test_contiguous_lanes_reach_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    for rule in (L.ceil_chunks(1000, 7), L.FloorChunks(1000, 7), L.Balanced(1000, 7), L.HeadTail(1000, 30)):
        parts = L.split(frame, rule, "id")
        assert "GreaterThanOrEqual(id" in parts[1]._jdf.queryExecution().executedPlan().toString()
        for number, part in enumerate(parts):
            want = L.with_lane(frame, rule, "id").filter(F.col("lane") == number)
            assert sorted(r["id"] for r in part.collect()) == sorted(r["id"] for r in want.collect())
