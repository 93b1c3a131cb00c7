"""Shuffles: lossless, confined to their lanes, uniform."""

import collections

import pytest
from pyspark.sql import functions as F

from rowdeck.functions import coin as fair, uniform
from rowdeck.functions.hashing import COIN, SAMPLE
from rowdeck.operators import lanes as L, ordering, riffle, shuffles
from rowdeck.plans.oracle import _hash_long

SIZES = (0, 1, 2, 3, 4, 5, 63, 200)


def moved(frame, pos="id", out="new_pos"):
    return {r[pos]: r[out] for r in frame.collect()}


def is_permutation(got, rows):
    return sorted(got) == list(range(rows)) and sorted(got.values()) == list(range(rows))


@pytest.mark.parametrize("rows", SIZES)
def test_all_shuffles_keep_every_row(spark, tiny_cells, rows):
    frame = spark.range(0, rows, 1, 3)
    runs = {
        "keyed": shuffles.keyed_shuffle(frame, "id", 5, out="new_pos"),
        "cyclic": shuffles.cyclic_shuffle(frame, 4, "id", 5, pos="id"),
        "batch": shuffles.batch_shuffle(frame, 4, "id", 5, pos="id"),
        "pairs": shuffles.pair_exchange(frame, 4, "id", 5, pos="id"),
        "rotate": shuffles.rotate_shuffle(frame, L.ceil_chunks(rows, 4), 5, pos="id"),
        "in place": shuffles.lane_shuffle_in_place(frame, L.Diagonal(rows, 4), "id", 5, pos="id"),
        "merge": shuffles.merge_shuffle(frame, 2, "id", 5, pos="id", coarse=True),
        "uniform merge": shuffles.merge_shuffle(frame, 2, "id", 5, pos="id"),
        "column": shuffles.column_lane_shuffle(frame.withColumn("lane", F.col("id") % 3), "lane", "id", 5),
    }
    for rule in (L.Strided, L.Diagonal, L.ceil_chunks, L.FloorChunks, L.Balanced):
        runs[rule.__name__] = shuffles.lane_shuffle(frame, rule(rows, 4), "id", 5, pos="id")
    for name, run in runs.items():
        assert is_permutation(moved(run), rows), name


def test_rows_stay_in_their_lane(spark, tiny_cells):
    rule = L.ceil_chunks(200, 3)
    got = moved(shuffles.lane_shuffle(spark.range(200), rule, "id", 1, pos="id"))
    assert all(pos // rule.batch == new // rule.batch for pos, new in got.items())
    got = moved(shuffles.lane_shuffle_in_place(spark.range(200), L.Strided(200, 3), "id", 1, pos="id"))
    assert all(pos % 3 == new % 3 for pos, new in got.items())


@pytest.mark.parametrize("chunks", (1, 3))
def test_cyclic_shuffle_is_one_cycle_per_chunk(spark, tiny_cells, chunks):
    got = moved(shuffles.cyclic_shuffle(spark.range(200), chunks, "id", 9, pos="id"))
    size = -(-200 // chunks)
    for start in range(0, 200, size):
        members = set(range(start, min(start + size, 200)))
        at, seen = start, set()
        while at not in seen:
            seen.add(at)
            assert got[at] != at
            at = got[at]
        assert seen == members


def test_uniform_over_all_orders(spark, tiny_cells):
    """2400 batches of four rows: chi-square over the 24 orders below the 0.001 cut."""
    got = moved(shuffles.batch_shuffle(spark.range(9600), 4, "id", 11, pos="id"))
    counts = collections.Counter(tuple(got[4 * k + j] - 4 * k for j in range(4)) for k in range(2400))
    assert len(counts) == 24
    assert sum((c - 100) ** 2 / 100 for c in counts.values()) < 49.7


def test_uniform_places(spark, tiny_cells):
    """Where 10,000 rows go in a global shuffle: 10 by 10 places below the 0.001 cut."""
    got = moved(shuffles.keyed_shuffle(spark.range(10_000), "id", 12, out="new_pos"))
    counts = collections.Counter((pos // 1000, new // 1000) for pos, new in got.items())
    assert sum((counts[i, j] - 100) ** 2 / 100 for i in range(10) for j in range(10)) < 148.2


def test_streams_of_one_seed_are_apart(spark):
    """Generated values, orders, lane orders, coins and samples share nothing but the seed."""
    values = spark.range(4000).select("id", uniform(7, "id").alias("u"))
    rows = shuffles.keyed_shuffle(values, "id", 7, out="new_pos").orderBy("new_pos").collect()
    descents = sum(a["u"] > b["u"] for a, b in zip(rows, rows[1:]))
    assert 1800 < descents < 2200
    sample = {r["id"] for r in shuffles.sample_k(spark.range(4000), 400, "id", 7).collect()}
    assert 10 < len(sample & {r["id"] for r in rows[:400]}) < 80
    heads = {r["id"] for r in spark.range(4000).filter(fair(7, "id")).collect()}
    assert 850 < len(heads & {r["id"] for r in rows[:2000]}) < 1150


def test_tasks_follow_bytes_and_the_caller(spark, tmp_path):
    wide = spark.range(0, 48, 1, 2).select("id", F.repeat(F.uuid(), 30_000).alias("text"))
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert shuffles.keyed_shuffle(wide, "id", 3).rdd.getNumPartitions() > 2
    assert ordering.stable_sort(wide, "id", "id", "to").rdd.getNumPartitions() > 2
    narrow = spark.range(1000)
    assert shuffles.keyed_shuffle(narrow, "id", 3).rdd.getNumPartitions() == 1
    asked = shuffles.keyed_shuffle(narrow, "id", 3, tasks=5)
    assert asked.rdd.getNumPartitions() == 5
    assert moved(asked, out="pos") == moved(shuffles.keyed_shuffle(narrow, "id", 3), out="pos")


@pytest.mark.parametrize("rule", [L.FloorChunks(9999, 5000), L.FloorChunks(999, 1000), L.HeadTail(9999, 1), L.FloorChunks(9999, 7)])
def test_uneven_lanes_give_even_tasks(spark, rule):
    placed = shuffles.lane_shuffle(spark.range(rule.rows), rule, "id", 5, pos="id", tasks=16)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * rule.rows / 16
    assert is_permutation(moved(placed), rule.rows)
    assert moved(placed) == moved(shuffles.lane_shuffle(spark.range(rule.rows), rule, "id", 5, pos="id", tasks=1))


def test_positions_that_do_not_fit_fail(spark):
    gaps = spark.createDataFrame([(0,), (2,), (5,), (9,)], "id bigint")
    with pytest.raises(Exception, match="not within"):
        shuffles.lane_shuffle(gaps, L.ceil_chunks(4, 3), "id", 1, pos="id").collect()
    twice = spark.createDataFrame([(0,), (0,), (0,), (1,)], "id bigint")
    with pytest.raises(Exception, match="more rows than"):
        shuffles.lane_shuffle(twice, L.ceil_chunks(4, 2), "id", 1, pos="id", tasks=2).collect()
    with pytest.raises(TypeError):
        shuffles.lane_shuffle_in_place(spark.range(9), L.Pairs(L.Strided(9, 3)), "id", 1, pos="id")


def test_coarse_merge_moves_wide_rows_once(spark, tmp_path):
    wide = spark.range(600).select("id", F.repeat(F.lit("x"), 50).alias("text"))
    plan = shuffles.merge_shuffle(wide, 64, "id", 5, pos="id", coarse=True)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("repeat(") <= 1 and is_permutation(moved(plan), 600)


def test_integer_width_does_not_change_the_draw(spark):
    wide = spark.range(50).select(F.col("id"))
    narrow = wide.select(F.col("id").cast("int").alias("id"))
    assert moved(shuffles.keyed_shuffle(wide, "id", 3, "new_pos")) == moved(
        shuffles.keyed_shuffle(narrow, "id", 3, "new_pos")
    )


def coin(seed, slot):
    return _hash_long(slot, _hash_long(COIN, _hash_long(seed, 42))) >= 1 << 63


def riffled(left, right, seed, start=0):
    """Toss a coin per slot, append what is left: the definition, on lists."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if coin(seed, start + i + j):
            out.append(left[i])
            i += 1
        else:
            out.append(right[j])
            j += 1
    return out + left[i:] + right[j:]


@pytest.mark.parametrize("left,right", [(0, 0), (0, 5), (5, 0), (1, 1), (40, 200), (200, 40), (300, 300)])
def test_riffle_merge(spark, monkeypatch, left, right):
    monkeypatch.setattr(riffle, "TASK_SLOTS", 16)
    a = spark.range(left).select(F.col("id").alias("pos"), F.concat(F.lit("a"), "id").alias("v"))
    b = spark.range(right).select(F.col("id").alias("pos"), F.concat(F.lit("b"), "id").alias("v"))
    got = [r["v"] for r in riffle.riffle_merge(a, b, 21).orderBy("new_pos").collect()]
    want = riffled([f"a{i}" for i in range(left)], [f"b{i}" for i in range(right)], 21)
    assert got == want


@pytest.mark.parametrize("small", (1, 1 << 14, 20))
@pytest.mark.parametrize("rows,width", [(0, 3), (1, 3), (100, 7), (100, 50), (100, 64), (99, 100)])
def test_riffle_pairs(spark, monkeypatch, rows, width, small):
    monkeypatch.setattr(riffle, "TASK_SLOTS", 7)
    monkeypatch.setattr(riffle, "SMALL_LANE", small)
    got = moved(riffle.riffle_pairs(spark.range(rows), rows, width, 4, pos="id"))
    want, items = [], list(range(rows))
    for start in range(0, rows, 2 * width):
        want += riffled(items[start : start + width], items[start + width : start + 2 * width], 4, start)
    assert got == {pos: new for new, pos in enumerate(want)}


@pytest.mark.parametrize("top", [10_000, 10])
def test_sample(spark, monkeypatch, top):
    monkeypatch.setattr(shuffles, "TOP_LIMIT", top)
    drawn, columns = shuffles.shuffle_order(spark.range(3000), "id", 6, use=SAMPLE)
    order = [r["id"] for r in drawn.orderBy(*columns).collect()]
    for size in (0, 1, 40, 2999, 3000, 9999):
        got = {r["id"] for r in shuffles.sample_k(spark.range(3000), size, "id", 6).collect()}
        assert got == set(order[:size])


def test_plain_shuffle_keeps_rows(spark):
    assert sorted(r["id"] for r in shuffles.rand_shuffle(spark.range(100), 1).collect()) == list(range(100))
