"""Even lanes by moving surplus, by cost, radix sort, uniform merges, cycles."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowdeck.operators import balance, cycles, radix, ranking, riffle, shuffles


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranking, "CELL_ROWS", 16)
    monkeypatch.setattr(ranking, "TASK_ROWS", 8)
    monkeypatch.setattr(balance, "CELL", 8)


def test_fill_is_the_greedy_rule():
    rng = random.Random(1)
    for _ in range(400):
        loads = np.array([rng.randrange(20) for _ in range(rng.randrange(1, 6))], np.int64)
        cost, rows = rng.randrange(1, 7), rng.randrange(1, 30)
        now, want = loads.copy(), np.zeros(len(loads), np.int64)
        for _ in range(rows):
            lane = int(np.argmin(now))
            now[lane] += cost
            want[lane] += 1
        assert (balance.fill(loads, cost, rows) == want).all()
    assert balance.fill(np.array([5, 0, 0]), 0, 7).tolist() == [3, 2, 2]


@pytest.mark.parametrize("lanes, count", [([0] * 50, 7), ([0, 1, 2, 3] * 5, 4), ([5] * 40 + [1, 2, 2], 6), ([], 3), ([1, 1, 2], 5), ([3] * 9 + [0] * 9, 4)])
def test_only_surplus_moves(spark, small, lanes, count):
    frame = spark.createDataFrame(list(enumerate(lanes)), "pos bigint, lane int")
    rows = balance.rebalance(frame, "lane", count).orderBy("pos").collect()
    assert [(r.pos, r.lane) for r in rows] == list(enumerate(lanes))
    loads, after = Counter(lanes), Counter(r.new_lane for r in rows)
    sizes = [after[k] for k in range(count)]
    assert sum(sizes) == len(lanes) and max(sizes) - min(sizes) <= 1
    moved = [r for r in rows if r.new_lane != r.lane]
    assert len(moved) == sum(max(0, loads[k] - after[k]) for k in range(count))
    # few rows must move, and a lane gives away its last ones
    assert len(moved) == min(sum(max(0, loads[k] - t[k]) for k in range(count)) for t in _targets(len(lanes), count, loads))
    for k in range(count):
        own = [r for r in rows if r.lane == k]
        assert all(r.new_lane == k for r in own[: min(loads[k], after[k])])


def _targets(rows, count, loads):
    whole, extra = divmod(rows, count)
    order = sorted(range(count), key=lambda k: (-loads[k], k))
    yield [whole + (order.index(k) < extra) for k in range(count)]


def test_lane_outside_fails(spark):
    frame = spark.createDataFrame([(0, 0), (1, 9)], "pos bigint, lane int")
    with pytest.raises(Exception, match="lane is not within"):
        balance.rebalance(frame, "lane", 3).collect()


@pytest.mark.parametrize("bits", (20, 3))
@pytest.mark.parametrize("costs", [[7] * 60, [0] * 10 + [1] * 20, [], [5, 900, 3, 3, 3, 40, 41, 42] * 6, None])
def test_least_loaded(spark, small, bits, costs):
    rng = random.Random(3)
    costs = [rng.choice([rng.randrange(2000), 13]) for _ in range(200)] + [None] if costs is None else costs
    frame = spark.createDataFrame(list(enumerate(costs)), "pos bigint, cost int")
    rows = balance.least_loaded(frame, "cost", 5, bits=bits).collect()
    assert sorted((r.pos, r.cost) for r in rows) == list(enumerate(costs))
    loads, counts = defaultdict(int), Counter(r.lane for r in rows)
    for r in rows:
        loads[r.lane] += r.cost or 0
    known = [c or 0 for c in costs]
    sizes = [loads[k] for k in range(5)]
    assert all(0 <= r.lane < 5 for r in rows)
    if bits == 20:  # exact classes: just the greedy rule
        now = [0] * 5
        for cost in sorted(filter(None, known), reverse=True):
            now[now.index(min(now))] += cost
        assert sizes == now
    assert max(sizes) - min(sizes) <= max(known, default=0) * (1 if bits == 20 else 1.5)
    if known and max(known) == 7:
        assert max(counts.values()) - min(counts.values()) <= 1


VALUES = {
    "one value": [7] * 300,
    "third equal": [3] * 100 + list(range(-100, 100)),
    "wide": [-(1 << 63), (1 << 63) - 1, 0, -1, 1] * 20 + list(range(100)),
    "nulls": [None] * 150 + [5, 4, 4, None] * 30,
    "only nulls": [None] * 100,
    "none": [],
}


@pytest.mark.parametrize("name", VALUES)
@pytest.mark.parametrize("tasks", (None, 7))
def test_radix_sort(spark, small, name, tasks):
    values = VALUES[name]
    random.Random(2).shuffle(values)
    frame = spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint").repartition(4)
    sorted_ = radix.radix_sort(frame, "v", tasks=tasks)
    rows = sorted(sorted_.collect(), key=lambda r: r.new_pos)
    assert [r.new_pos for r in rows] == list(range(len(values)))
    assert [(r.v, r.pos) for r in rows] == sorted(((v, k) for k, v in enumerate(values)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_radix_cells_are_even(spark, small):
    """No task gets more than two cells' worth, though half of the rows share one value."""
    frame = spark.range(4000).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id") * 1000).alias("v"))
    sorted_ = radix.radix_sort(frame, "v", tasks=20)
    sizes = [r["count"] for r in sorted_.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 200
    assert "SampleExec" not in sorted_._jdf.queryExecution().toString() and "Window" not in sorted_._jdf.queryExecution().optimizedPlan().toString()


def test_radix_refuses_fractions(spark):
    with pytest.raises(TypeError):
        radix.radix_sort(spark.range(3).select(F.col("id").alias("pos"), F.rand().alias("v")), "v")


def chi_square(counts, kinds):
    expected = sum(counts.values()) / kinds
    return sum((counts[k] - expected) ** 2 for k in counts) / expected + (kinds - len(counts)) * expected


@pytest.mark.parametrize("lane, paths", [(4, "window"), (5, "window"), (4, "threshold")])
def test_uniform_merges(spark, monkeypatch, lane, paths):
    """All interleavings of 2 and 2 (or 2 and 3) rows are equally likely, over thousands of lanes."""
    width, lanes = 2, 3000 if paths == "window" else 1
    if paths == "threshold":
        monkeypatch.setattr(riffle, "SMALL_LANE", 1)
        lanes = 3000
    frame = spark.range(lanes * lane).select(F.col("id").alias("pos"))
    merged = riffle._riffle(frame, lanes * lane, lane, width, 5, "pos", "new_pos", True).collect()
    found = defaultdict(dict)
    for r in merged:
        found[r.pos // lane][r.new_pos % lane] = r.pos % lane
    orders = Counter()
    for k, order in found.items():
        order = tuple(order[j] for j in range(lane))
        assert [x for x in order if x < width] == [0, 1] and [x for x in order if x >= width] == list(range(2, lane))
        orders[order] += 1
    kinds = {4: 6, 5: 10}[lane]
    assert len(orders) == kinds and chi_square(orders, kinds) < 35  # p of about 10^-5 for 9 degrees


def test_merging_alone_is_uniform(spark):
    """Every order of 4 rows, as blocks of one row merged twice; independent lanes side by side."""
    trials, orders = 4800, Counter()
    frame = spark.range(trials * 4).select(F.col("id").alias("pos"))
    moved = riffle.riffle_pairs(frame, trials * 4, 1, 11, out="one", uniform=True).drop("pos").withColumnRenamed("one", "pos")
    origin = riffle.riffle_pairs(frame, trials * 4, 1, 11, out="one", uniform=True)
    twice = riffle.riffle_pairs(origin.select(F.col("pos").alias("origin"), F.col("one").alias("pos")), trials * 4, 2, 12, uniform=True)
    found = defaultdict(dict)
    for r in twice.collect():
        found[r.origin // 4][r.new_pos % 4] = r.origin % 4
    for order in found.values():
        orders[tuple(order[j] for j in range(4))] += 1
    assert moved.count() == trials * 4 and len(orders) == 24 and chi_square(orders, 24) < 65  # p of about 10^-5


def test_uniform_merge_shuffle_keeps_all_rows(spark):
    frame = spark.range(1001).select(F.col("id").alias("pos"))
    got = shuffles.merge_shuffle(frame, 3, "pos", 4, uniform=True).collect()
    assert sorted(r.new_pos for r in got) == list(range(1001)) and sum(r.pos == r.new_pos for r in got) < 20
    with pytest.raises(ValueError):
        shuffles.merge_shuffle(frame, 3, "pos", 4, coarse=True, uniform=True)


def test_cycles(spark):
    rng = random.Random(8)
    to = list(range(60))
    rng.shuffle(to)
    want = {}
    for start in range(60):
        if start not in want:
            at, members = start, []
            while at not in members:
                members.append(at)
                at = to[at]
            want |= dict.fromkeys(members, min(members))
    frame = spark.createDataFrame(list(enumerate(to)), "pos bigint, new_pos bigint")
    assert {r.pos: r.cycle for r in cycles.cycle_of(frame).collect()} == want
    assert {r.cycle: r.length for r in cycles.cycle_lengths(frame).collect()} == Counter(want.values())
    with pytest.raises(ValueError):
        cycles.cycle_of(spark.createDataFrame([(0, 1), (1, 1)], "pos bigint, new_pos bigint"))
    assert cycles.cycle_of(frame.where("false")).count() == 0


def test_cyclic_shuffle_has_one_cycle_per_chunk(spark):
    frame = spark.range(400).select(F.col("id").alias("pos"))
    found = cycles.cycle_lengths(shuffles.cyclic_shuffle(frame, 7, "pos", 3)).collect()
    assert sorted((r.cycle, r.length) for r in found) == [(k * 58, 58 if k < 6 else 52) for k in range(7)]
