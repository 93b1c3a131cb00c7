"""Batches to the driver, exact batches for models, one-pass splits, pixels."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowdeck import sinks, sources
from rowdeck.operators import inference, lanes as L, shuffles
from rowdeck.sinks import batches as B
from rowdeck.sources import images


def rows(spark, n, parts=5):
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("v"), F.concat(F.lit("t"), F.col("id")).alias("t")).repartition(parts)


@pytest.mark.parametrize("n, size, files", [(0, 4, None), (1, 4, None), (3, 4, 2), (4, 4, 3), (23, 4, 7), (23, 100, 7), (200, 7, 3), (200, 50, 200)])
def test_batches(spark, n, size, files):
    got = list(B.iter_batches(rows(spark, n), size, files=files))
    assert [len(b) for b in got] == [size] * (n // size) + [n % size] * (n % size > 0)
    assert [v for b in got for v in b["v"]] == [3 * k for k in range(n)] and all(list(b.columns) == ["v", "t"] for b in got)
    assert sum(len(b) for b in B.iter_batches(rows(spark, n), size, files=files, drop_last=True)) == n - n % size


def test_batch_kinds_and_resuming(spark, monkeypatch):
    monkeypatch.setattr(B, "MESSAGE_BYTES", 64)  # messages of a row or two
    table = rows(spark, 50)
    arrow = list(B.iter_batches(table, 8, kind="arrow", columns=["t"], prefetch=False))
    assert arrow[0].column_names == ["t"] and arrow[-1].num_rows == 2
    numpy = next(B.iter_batches(table, 8, kind="numpy", start=30))
    assert numpy["v"].tolist() == [3 * k for k in range(30, 38)]
    shuffled = shuffles.keyed_shuffle(table, "pos", 3, out="to").drop("pos").withColumnRenamed("to", "pos")
    assert sorted(v for b in B.iter_batches(shuffled, 9) for v in b["v"]) == [3 * k for k in range(50)]
    laid = shuffles.keyed_shuffle(table, "pos", 3, out="to")
    assert sum(len(b) for b in B.iter_batches(laid, 9, pos="to", laid_out=True)) == 50


@pytest.mark.parametrize("positions", [[0, 1, 3], [0, 1, 1], [1, 2, 3], [0, None, 1], [-1, 0, 1]])
def test_batches_refuse_gaps(spark, positions):
    frame = spark.createDataFrame([(p, 1) for p in positions], "pos bigint, v int")
    with pytest.raises(Exception, match="not dense|outside|partition"):
        list(B.iter_batches(frame, 2))


@pytest.mark.parametrize("arguments", [{"size": 0}, {"size": 2, "kind": "list"}])
def test_batch_arguments(spark, arguments):
    with pytest.raises(ValueError):
        B.iter_batches(rows(spark, 3), **arguments)


@pytest.fixture
def sizes_seen():
    def build():  # local, so that workers get it by value
        return lambda batch: [len(batch)] * len(batch)

    return build


def test_models_see_full_batches(spark, sizes_seen):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = inference.batch_predict(spark.range(0, 1000, 1, 3), sizes_seen, ["id"], "size", "bigint", batch_size=60)
        for part in out.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("size").alias("sizes")).collect():
            n = len(part.sizes)
            assert sorted(part.sizes) == sorted([60] * (n // 60 * 60) + [n % 60] * (n % 60))
        assert sorted(r.id for r in out.collect()) == list(range(1000))
        exact = inference.predict_in_batches(rows(spark, 1000), sizes_seen, ["v"], "size", "bigint", 60, tasks=4)
        assert {(r.pos, r.size) for r in exact.collect()} == {(k, 60 if k < 960 else 40) for k in range(1000)}
        # the sort below the model outlives an aggregate above it
        assert exact.groupBy("size").count().count() == 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_batches_of_models_refuse_gaps(spark, sizes_seen):
    frame = spark.createDataFrame([(0, 1), (1, 1), (3, 1)], "pos bigint, v int")
    with pytest.raises(Exception, match="not dense"):
        inference.predict_in_batches(frame, sizes_seen, ["v"], "size", "bigint", 2, rows=3).collect()
    empty = inference.predict_in_batches(frame.where("false"), sizes_seen, ["v"], "size", "bigint", 2)
    assert empty.count() == 0


@pytest.mark.parametrize("rule", [L.Strided(1000, 100), L.Batches(1000, 300), L.HeadTail(1000, 30), L.ceil_chunks(1000, 7)])
def test_one_pass_split(spark, tmp_path, rule):
    path = str(tmp_path / "split")
    manifest = {r.lane: (r.rows, r.files) for r in sinks.write_lanes(rows(spark, 1000), rule, path, files=6).collect()}
    assert sorted(manifest) == list(range(rule.count)) and sum(n for n, _ in manifest.values()) == 1000
    assert sum(f for _, f in manifest.values()) <= 6 + rule.count
    expected = {}
    for r in rows(spark, 1000).select("pos", rule.lane(F.col("pos")).alias("lane")).collect():
        expected.setdefault(r.lane, set()).add(r.pos)
    for lane in (0, 1, rule.count - 1):
        found = sinks.read_lane(spark, path, lane)
        assert found.columns == ["pos", "v", "t"] and {r.pos for r in found.collect()} == expected.get(lane, set())
        assert all(f"_lane={lane}/" in name for name in found.inputFiles()) and len(found.inputFiles()) == manifest[lane][1]
    with pytest.raises(ValueError):
        sinks.read_lane(spark, path, rule.count)


def test_split_with_empty_lanes(spark, tmp_path):
    path = str(tmp_path / "split")
    manifest = sinks.write_lanes(rows(spark, 3), L.ceil_chunks(3, 5), path)
    assert sorted(map(tuple, manifest.collect())) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0)]
    assert sinks.read_lane(spark, path, 4).count() == 0
    assert sinks.write_lanes(rows(spark, 0), L.Strided(0, 2), str(tmp_path / "none")).count() == 2


# --- images: files are written here by the formats' own rules -------------------------------


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(array, colour, depth=8, palette=None, filters=(0, 1, 2, 3, 4)):
    height, width = array.shape[:2]
    flat = array.reshape(height, -1)
    if depth < 8:
        bits = np.unpackbits(flat[:, :, None], axis=2)[:, :, 8 - depth :].reshape(height, -1)
        flat = np.packbits(bits, axis=1)
    step = max(1, array[0, 0].size * depth // 8)
    lines, above = [], np.zeros(flat.shape[1], int)
    for y, row in enumerate(flat.astype(int)):
        kind = filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), row[:-step]])[: len(row)]
        corner = np.concatenate([np.zeros(step, int), above[:-step]])[: len(row)]
        guess = left + above - corner
        p, q, r = abs(guess - left), abs(guess - above), abs(guess - corner)
        paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))
        lines.append(bytes([kind]) + bytes(((row - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8)))
        above = row
    data = zlib.compress(b"".join(lines))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette.tobytes()))
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def bmp(array):
    height, width = array.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    body = b"".join(array[y, :, ::-1].tobytes().ljust(stride, b"\0") for y in range(height - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


RNG = np.random.default_rng(1)
COLOUR = RNG.integers(0, 256, (11, 7, 3), np.uint8)
GRAY = RNG.integers(0, 256, (5, 9, 1), np.uint8)
ALPHA = RNG.integers(0, 256, (6, 4, 4), np.uint8)
PALETTE = RNG.integers(0, 256, (4, 3), np.uint8)
INDEX = RNG.integers(0, 4, (5, 7, 1), np.uint8)
BITS = RNG.integers(0, 2, (5, 13, 1), np.uint8)
FILES = {
    "a.png": (png(COLOUR, 2), COLOUR),
    "b.png": (png(GRAY, 0), np.repeat(GRAY, 3, 2)),
    "c.png": (png(ALPHA, 6), ALPHA[:, :, :3]),
    "d.png": (png(INDEX, 3, 2, PALETTE, (0, 2)), PALETTE[INDEX[:, :, 0]]),
    "e.png": (png(BITS, 0, 1, None, (0,)), np.repeat(BITS * 255, 3, 2)),
    "f.ppm": (b"P6 # made here\n7 11\n255\n" + COLOUR.tobytes(), COLOUR),
    "g.pgm": (b"P5\n9 5\n255\n" + GRAY.tobytes(), np.repeat(GRAY, 3, 2)),
    "h.bmp": (bmp(COLOUR), COLOUR),
}


def test_pixels(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(FILES)
    for name, (_, want) in FILES.items():
        assert np.array_equal(images.pixels(got[name].height, got[name].width, got[name].image), want), name
    gray = sources.read_images(spark, str(tmp_path), mode="L", pattern="*.pgm").first()
    assert np.array_equal(images.pixels(gray.height, gray.width, gray.image), GRAY)
    luma = sources.read_images(spark, str(tmp_path), mode="L", pattern="a.png").first()
    want = (COLOUR.astype(int) @ [299, 587, 114] + 500) // 1000
    assert np.array_equal(images.pixels(luma.height, luma.width, luma.image)[:, :, 0], want)


def test_broken_images(spark, tmp_path):
    good = FILES["a.png"][0]
    broken = {"cut.png": good[:60], "crc.png": good[:45] + b"\xff" + good[46:], "text.txt": b"hello", "cut.bmp": FILES["h.bmp"][0][:70], "cut.ppm": b"P6\n7 11\n255\nabc"}
    for name, data in {**broken, "good.png": good}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in sources.read_images(spark, str(tmp_path), broken="report").collect()}
    assert {name for name, r in got.items() if r.error is None} == {"good.png"} and all(got[name].image is None for name in broken)
    with pytest.raises(Exception, match="cut.png|crc.png|text.txt|cut.bmp|cut.ppm"):
        sources.read_images(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        sources.read_images(spark, str(tmp_path), mode="CMYK")


def test_images_feed_models(spark, tmp_path):
    pixels = images.pixels
    for k in range(20):
        (tmp_path / f"{k:02}.ppm").write_bytes(b"P6\n2 2\n255\n" + bytes([k] * 12))

    def build():
        return lambda batch: [int(pixels(h, w, x).mean()) for h, w, x in zip(batch["height"], batch["width"], batch["image"])]

    out = inference.batch_predict(sources.read_images(spark, str(tmp_path)), build, ["height", "width", "image"], "mean", "bigint", 6, tasks=1)
    assert sorted((r.path[-6:-4], r["mean"]) for r in out.drop("image").collect()) == [(f"{k:02}", k) for k in range(20)]
