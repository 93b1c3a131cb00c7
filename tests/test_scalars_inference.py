"""Scalar functions against Python, and models in batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowdeck import functions as fn
from rowdeck.operators import inference, lanes as L, ordering, pairing


def values(spark, items, kind, expression):
    frame = spark.createDataFrame([(x,) for x in items], f"x {kind}").coalesce(1)
    return [r[0] for r in frame.select(expression(F.col("x"))).collect()]


def test_digits(spark):
    items = [0, 7, 10, 123, -1, -12, -100, 2**62, -(2**62)]
    for place in (0, 1, 2, 18):
        got = values(spark, items, "bigint", lambda x: fn.digit(x, place))
        assert got == [(v // 10**place) % 10 for v in items]


def test_round_significant(spark):
    items = [1.0, 10.0, 1000.0, 999.0, 12500.0, 0.0123, 5.55e-7, 140.741949]
    for digits in (1, 2, 3):
        got = values(spark, items, "double", lambda x: fn.round_significant(x, digits))
        want = [round(x, -math.floor(math.log10(x)) + digits - 1) for x in items]
        assert got == pytest.approx(want, rel=1e-12)
    for bad in (0.0, -1.0):
        with pytest.raises(Exception, match="significant"):
            values(spark, [bad], "double", lambda x: fn.round_significant(x, 2))


def test_readable_size(spark):
    got = values(spark, [800_000, 1 << 20, (1 << 30) - 1, 1 << 30, 80_000_000], "bigint", fn.readable_size)
    assert got == ["0.76 MB", "1.00 MB", "1024.00 MB", "1.00 GB", "76.29 MB"]


def test_strip_and_argmax(spark):
    texts = [" a ", "\t\r\na b\x0b\x0c", "　x ", "", "  "]
    assert values(spark, texts, "string", fn.strip) == [t.strip() for t in texts]
    assert values(spark, [[1.0, 3.0, 3.0], [2.0]], "array<float>", fn.argmax) == [1, 0]


def test_flatten_zip_concat(spark):
    frame = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "pos bigint, a int, b int")
    flat = pairing.flatten(frame, ["a", "b"], "float")
    assert sorted(map(tuple, flat.collect())) == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    other = spark.createDataFrame([(0, 10)], "pos bigint, c int")
    assert [tuple(r) for r in pairing.zip_add(frame, other, "a", "c").select("pos", "total").collect()] == [(0, 11)]
    both = pairing.concat(frame, frame)
    assert sorted(r["pos"] for r in both.collect()) == [0, 1, 2, 3]
    indices = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "pos bigint, src bigint")
    assert sorted((r["pos"], r["a"]) for r in pairing.gather(frame, indices).collect()) == [(0, 3), (1, 3), (2, 1)]


def features(spark, rows=1000):
    frame = spark.range(0, rows, 1, 2)
    return frame.select("id", F.array(*[fn.uniform(i, "id") for i in range(4)]).alias("x"))


def test_model_is_built_once_per_worker_and_called_in_batches(spark):
    built, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    weights = np.eye(4)

    def build():
        built.add(1)

        def model(batch):
            if len(batch) > 64:
                raise ValueError("batch too large")
            sizes.add(len(batch))
            return (np.stack(batch["x"].to_numpy()) @ weights.T).argmax(axis=1)

        return model

    out = inference.batch_predict(features(spark), build, ["x"], "label", "bigint", batch_size=64)
    rows = out.collect()
    assert 1 <= built.value <= 2 and sizes.value == 1000
    assert all(r["label"] == int(np.argmax(r["x"])) for r in rows)
    limited = inference.batch_predict(features(spark), build, ["x"], "label", "bigint", batch_size=64, tasks=1)
    assert limited.rdd.getNumPartitions() == 1


def test_model_errors_fail_the_job(spark):
    def build():
        def model(batch):
            raise RuntimeError("model broke")

        return model

    with pytest.raises(Exception, match="model broke"):
        inference.batch_predict(features(spark), build, ["x"], "label", "bigint").collect()
    short = inference.batch_predict(features(spark), lambda: lambda b: [1], ["x"], "label", "bigint")
    with pytest.raises(Exception, match="one value per row"):
        short.collect()


def test_predictions_to_parquet(spark, tmp_path):
    model = inference.linear_model(np.eye(4), "x")
    out = inference.batch_predict(features(spark, 50), model, ["x"], "label", "bigint")
    inference.write_predictions(out, str(tmp_path / "p"), ["x"])
    written = spark.read.parquet(str(tmp_path / "p"))
    assert written.columns == ["id", "label"] and written.count() == 50
    assert inference.predict_sample(features(spark, 50), 10, "id", build_model=model, inputs=["x"], out="label", out_type="bigint").count() == 10


def test_untouched_columns_stay_bit_for_bit(spark):
    rows = [(0, 9007199254740993, "1.10", None), (1, None, None, "2020-01-01 00:00:00.123456")]
    frame = spark.createDataFrame(rows, "id bigint, big bigint, d string, t string")
    frame = frame.select("id", "big", F.col("d").cast("decimal(20,2)").alias("d"), F.col("t").cast("timestamp").alias("t"))
    out = inference.batch_predict(frame, lambda: lambda batch: batch["id"] * 2, ["id"], "twice", "bigint")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    assert out.drop("twice").exceptAll(frame).isEmpty() and sorted(r["twice"] for r in out.collect()) == [0, 2]


def test_only_inputs_are_read(spark, tmp_path):
    features(spark, 50).withColumn("heavy", F.lit("x")).write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    out = inference.batch_predict(frame, inference.linear_model(np.eye(4), "x"), ["x"], "label", "bigint").select("label")
    assert "heavy" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50


def test_no_row_is_lost(spark):
    frame = spark.createDataFrame([(0, 1), (1, 7)], "pos bigint, c int")
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    got = sorted((r["pos"], r["name"]) for r in pairing.lookup_label(frame, names, "c", "k").collect())
    assert got == [(0, "one"), (1, None)]
    with pytest.raises(Exception, match="no label"):
        pairing.lookup_label(frame, names, "c", "k", strict=True).collect()
    indices = spark.createDataFrame([(0, 1), (1, 5)], "pos bigint, src bigint")
    with pytest.raises(Exception, match="no row"):
        pairing.gather(frame, indices).collect()
    for lanes in ([(0, 0)], [(0, 0), (0, 0), (1, 1)]):
        offsets = spark.createDataFrame(lanes, "lane bigint, offset bigint")
        with pytest.raises(Exception, match="exactly one offset"):
            ordering.concat_in_order(spark.range(2).select(F.col("id").alias("pos")), L.Strided(2, 2), offsets).collect()


def test_apply_per_lane(spark):
    def state(frames):
        seen = 0
        for frame in frames:
            yield frame.assign(id=range(seen, seen + len(frame)))
            seen += len(frame)

    rule = L.Strided(2500, 2)
    frame = spark.range(2500).select(F.col("id").alias("pos"), "id").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = dict(inference.apply_per_lane(frame, rule, state, "pos bigint, id bigint").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {p: p // 2 for p in range(2500)}
