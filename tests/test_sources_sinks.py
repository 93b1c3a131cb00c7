"""Files in, files out."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowdeck import sinks, sources
from rowdeck.operators import lanes as L, ordering, shuffles
from rowdeck.session import durable


def write(path, text):
    path.write_text(text)
    return str(path)


def in_name_order(folder):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/part-*")))


def test_number_lines(spark, tmp_path):
    path = write(tmp_path / "n.txt", " 0.5\n1e-05\t\r\n 3\n")
    assert [r[0] for r in sources.read_numbers(spark, path).collect()] == [0.5, 1e-05, 3.0]
    path = write(tmp_path / "i.txt", "9\n 8\n7 \n")
    frame = sources.read_numbers(spark, path, "int")
    assert frame.dtypes == [("value", "int")] and [r[0] for r in frame.collect()] == [9, 8, 7]
    assert sources.read_numbers(spark, path, "float").dtypes == [("value", "float")]


@pytest.mark.parametrize("text", ["1\nx\n", "1\n\n2\n"])
def test_bad_line_fails(spark, tmp_path, text):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.read_numbers(spark, write(tmp_path / "bad.txt", text)).collect()


def test_tokens(spark, tmp_path):
    path = write(tmp_path / "t.txt", "  1 2\t3\n\n4.5   6\n")
    assert [r[0] for r in sources.read_tokens(spark, path).collect()] == [1, 2, 3, 4.5, 6]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.read_tokens(spark, write(tmp_path / "b.txt", "1 two"), "int").collect()


def test_lines(spark, tmp_path):
    path = write(tmp_path / "l.txt", "  a b \n\tc \n\n")
    assert [r[0] for r in sources.read_lines(spark, path).collect()] == ["a b", "c", ""]


def test_dict_lines(spark, tmp_path):
    path = write(tmp_path / "d.txt", "{'item': 0.25}\n{'item': 1e-05}\n{\"item\": 3}\n")
    assert [r[0] for r in sources.read_dicts(spark, path).collect()] == [0.25, 1e-05, 3.0]
    with pytest.raises(Exception):
        sources.read_dicts(spark, write(tmp_path / "b.txt", "{'item': \n")).collect()


def test_memory_sources(spark):
    assert sources.from_items(spark, [0.5, 0.25]).columns == ["pos", "item"]
    assert [tuple(r) for r in sources.from_items(spark, [{"data": 3}, {"data": 1}]).collect()] == [(0, 3), (1, 1)]
    assert sources.from_items(spark, [1, 2], "int").dtypes == [("pos", "bigint"), ("item", "int")]
    frame = sources.from_numpy(spark, np.arange(3, dtype="int64"))
    assert [tuple(r) for r in frame.collect()] == [(0, 0), (1, 1), (2, 2)] and frame.columns == ["pos", "data"]
    frame = sources.from_pandas(spark, pd.DataFrame({"value": [0.5, 0.75]}, index=[7, 3]))
    assert [tuple(r) for r in frame.collect()] == [(0, 0.5), (1, 0.75)]


def test_generators(spark):
    assert [tuple(r) for r in sources.sequence(spark, 3).collect()] == [(0, 0), (1, 1), (2, 2)]
    low, high, mean = sources.uniforms(spark, 20000, 3).agg(F.min("value"), F.max("value"), F.mean("value")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01
    assert sources.uniforms(spark, 3, 3, "float").dtypes[1] == ("value", "float")
    half_open = sources.integers(spark, 5000, 3, 0, 10).agg(F.min("value"), F.max("value")).first()
    closed = sources.integers(spark, 5000, 3, 1, 10, inclusive=True).agg(F.min("value"), F.max("value")).first()
    assert tuple(half_open) == (0, 9) and tuple(closed) == (1, 10)
    with pytest.raises(ValueError):
        sources.integers(spark, 5, 3, 4, 4)


def test_binary_scan(spark, tmp_path):
    for name in ("a.png", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    frame = sources.read_binary(spark, str(tmp_path), "*.png")
    assert frame.columns == ["path", "modificationTime", "length", "content"]
    assert sorted(bytes(r["content"]) for r in frame.collect()) == [b"a.png", b"b.png"]


def test_parquet_positions_over_files(spark, tmp_path):
    folder = str(tmp_path / "p")
    spark.range(0, 1000, 1, 4).write.parquet(folder)
    rows = sources.number_parquet(spark, folder).collect()
    assert sorted(r["pos"] for r in rows) == list(range(1000))
    assert all(r["pos"] == r["id"] for r in rows)


def test_text_positions_over_files_and_blocks(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 7)}" for i in range(3000)]
    folder = tmp_path / "t"
    folder.mkdir()
    cuts = [0, 1700, 1700, 1800, 3000]
    for part in range(4):
        (folder / f"part-{part}.txt").write_text("".join(x + "\n" for x in lines[cuts[part] : cuts[part + 1]]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        frame = sources.number_text(spark, str(folder))
        assert frame.rdd.getNumPartitions() > 4
        rows = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted(rows)] == lines
    assert [r["pos"] for r in sorted(rows)] == list(range(3000))


def test_positions_of_any_frame(spark):
    frame = spark.range(0, 100, 1, 7).filter("id % 3 <> 0")
    rows = sources.number_rows(frame).collect()
    assert [r["id"] for r in sorted(rows)] == [i for i in range(100) if i % 3]
    assert sorted(r["pos"] for r in rows) == list(range(66))


def test_durable_copy(spark):
    frame = durable(spark.range(10))
    assert frame.count() == 10 and "ExistingRDD" in frame._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("files", (1, 3, 8))
def test_ordered_lines(spark, tmp_path, files):
    frame = spark.range(100).select((99 - F.col("id")).alias("pos"), F.col("id").alias("v"))
    sinks.write_lines(frame, str(tmp_path / "o"), "v", files=files)
    assert in_name_order(tmp_path / "o") == "".join(f"{99 - i}\n" for i in range(100))
    assert len(glob.glob(f"{tmp_path}/o/part-*")) == files


def test_integers_are_cut_toward_zero(spark, tmp_path):
    frame = spark.createDataFrame([(0, 2.9), (1, -2.9), (2, 3.0)], "pos bigint, v double")
    sinks.write_integers(frame, str(tmp_path / "o"), "v")
    assert in_name_order(tmp_path / "o") == "2\n-2\n3\n"


def test_tokens_and_dicts_round_trip(spark, tmp_path):
    frame = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") / 8).alias("v"))
    sinks.write_tokens(frame, str(tmp_path / "t"), "v")
    assert [float(x) for x in in_name_order(tmp_path / "t").split(" ") if x] == [i / 8 for i in range(50)]
    assert "\n" not in in_name_order(tmp_path / "t")
    assert sorted(r[0] for r in sources.read_tokens(spark, str(tmp_path / "t")).collect()) == [i / 8 for i in range(50)]
    sinks.write_dicts(frame, str(tmp_path / "d"), "v")
    assert in_name_order(tmp_path / "d").splitlines()[1] == '{"item":0.125}'
    assert sorted(r[0] for r in sources.read_dicts(spark, str(tmp_path / "d")).collect()) == [i / 8 for i in range(50)]


def test_empty_sink(spark, tmp_path):
    sinks.write_lines(spark.range(0).select(F.col("id").alias("pos"), "id"), str(tmp_path / "e"), "id")
    assert in_name_order(tmp_path / "e") == ""


def test_sinks_do_not_overwrite(spark, tmp_path):
    frame = spark.range(3).select(F.col("id").alias("pos"), "id")
    sinks.write_lines(frame, str(tmp_path / "o"), "id")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_lines(frame, str(tmp_path / "o"), "id")


def test_shuffled_lines_match_keyed_shuffle(spark, tmp_path):
    frame, order = shuffles.shuffle_order(spark.range(300), "id", 8)
    sinks.write_shuffled_lines(frame, str(tmp_path / "s"), "id", order)
    want = [r["id"] for r in shuffles.keyed_shuffle(spark.range(300), "id", 8).orderBy("pos").collect()]
    assert [int(x) for x in in_name_order(tmp_path / "s").split()] == want


def test_laid_out_shuffles_are_written_without_an_exchange(spark, tmp_path, tiny_cells):
    want = [r["id"] for r in shuffles.keyed_shuffle(spark.range(500), "id", 8).orderBy("pos").collect()]
    shuffled = shuffles.keyed_shuffle(spark.range(500), "id", 8)
    sinks.write_lines(shuffled, str(tmp_path / "s"), "id", pos="pos", laid_out=True)
    assert [int(x) for x in in_name_order(tmp_path / "s").split()] == want
    rule = L.Strided(500, 40)
    lanes = shuffles.lane_shuffle(spark.range(500), rule, "id", 8, pos="id", out="to")
    want = [r["id"] for r in lanes.orderBy("to").collect()]
    sinks.write_lines(lanes, str(tmp_path / "l"), "id", pos="to", laid_out=True)
    assert [int(x) for x in in_name_order(tmp_path / "l").split()] == want


def test_iterate_and_take(spark):
    frame = spark.range(20).select((19 - F.col("id")).alias("pos"), "id")
    assert [r["id"] for r in sinks.iterate(frame)] == list(range(19, -1, -1))
    assert sorted(r["pos"] for r in ordering.take_first(frame, 3).collect()) == [0, 1, 2]


def test_file_to_file_run(spark, tmp_path):
    """Numbers in, shuffled dict lines out, cleaned, compared: the four-step script."""
    from rowdeck.operators import verify

    values = [i / 64 for i in range(500)]
    path = write(tmp_path / "input.txt", "".join(f"{v}\n" for v in values))
    numbered = sources.parse_numbers(sources.number_text(spark, path))
    shuffled = shuffles.keyed_shuffle(numbered, "pos", 4, "to").select(F.col("to").alias("pos"), "value")
    sinks.write_dicts(shuffled, str(tmp_path / "output"), "value")
    lines = sources.number_text(spark, str(tmp_path / "output"))
    cleaned = sources.parse_dicts(lines).select("pos", F.col("item").alias("value"))
    row = verify.shuffle_audit(numbered, cleaned).first()
    assert row["verdict"] == "passed" and row["multiset_ok"] and row["pct_moved"] > 95
    assert verify.verify_elements(numbered, cleaned, "value").first()["all_present"]
    assert os.path.exists(tmp_path / "output" / "_SUCCESS")


def test_column_names_of_the_table_are_left_alone(spark, tmp_path):
    from rowdeck.operators import riffle

    names = ["rows", "offset", "slot", "src", "base", "lane", "rank", "value"]
    frame = spark.range(40).select(F.col("id").alias("pos"), *[F.col("id").alias(n) for n in names])
    folder = str(tmp_path / "p")
    frame.drop("pos").write.parquet(folder)
    numbered = sources.number_parquet(spark, folder)
    again = sources.number_rows(frame.drop("pos"))
    merged = riffle.riffle_merge(frame, frame, 1)
    rule = L.ceil_chunks(40, 4)
    loads = L.lane_loads(L.with_lane(frame.select("pos"), rule))
    runs = [
        numbered,
        again,
        merged,
        shuffles.keyed_shuffle(frame, "pos", 1, "to"),
        shuffles.lane_shuffle(frame, rule, "pos", 1),
        shuffles.cyclic_shuffle(frame, 4, "pos", 1),
        ordering.stable_sort(frame, "value"),
        ordering.concat_in_order(frame, rule, ordering.lane_offsets(loads, "rows")),
        L.half_rotate(frame, rule),
    ]
    for run in runs:
        rows = run.collect()
        assert set(names) <= set(run.columns) and len(run.columns) == len(set(run.columns))
        assert not [c for c in run.columns if c.startswith("_")]
        assert all(len({r[n] for n in names}) == 1 for r in rows)
        assert sorted({r["rows"] for r in rows}) == list(range(40))


def test_a_token_file_on_one_line_is_split(spark, tmp_path):
    (tmp_path / "tokens").write_text(" ".join(str(k) for k in range(40_000)) + "\n7\t8\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        tokens = sources.read_tokens(spark, str(tmp_path / "tokens"), "int")
        assert tokens.rdd.getNumPartitions() > 4
        sizes = [r["count"] for r in tokens.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 15_000
        assert tokens.agg(F.sum("value")).first()[0] == sum(range(40_000)) + 15
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_known_layouts_skip_the_exchange(spark, tmp_path):
    rule = L.Strided(50, 3)
    scattered = shuffles.lane_shuffle_in_place(spark.range(50), rule, "id", 1, pos="id", out="to")
    changed = shuffles.keyed_shuffle(spark.range(50), "id", 1).select("id", "pos")
    known = shuffles.keyed_shuffle(spark.range(50), "id", 1)
    for frame, pos, files in ((scattered, "to", None), (changed, "pos", None), (known, "id", None), (known, "pos", 3)):
        with pytest.raises(ValueError):
            sinks.write_lines(frame, str(tmp_path / "x"), "id", pos=pos, laid_out=True, files=files)


def test_wide_rows_give_several_files(spark):
    wide = spark.range(0, 32, 1, 2).select(F.col("id").alias("pos"), F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert sinks.in_order(wide).rdd.getNumPartitions() > 1
    assert sinks.in_order(wide.select("pos")).rdd.getNumPartitions() == 1


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from rowdeck.session import checkpoint_folder

    conf = SimpleNamespace(get=lambda name, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        checkpoint_folder(SimpleNamespace(conf=conf, sparkContext=context))
