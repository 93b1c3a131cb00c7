"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowdeck import sources
from rowdeck.functions import (
    argmax,
    digit,
    readable_size,
    round_significant,
    strip,
    uniform,
    uniform_int,
)
from rowdeck.operators import balance, cycles, inference, lanes as L, ordering, pairing, radix, riffle, shuffles, verify

SEED = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(function):
        QUERIES[name] = function
        return function

    return register


def table(spark: SparkSession, folder: str, source_name: str, /, **columns: str) -> DataFrame:
    """A table reduced to the named columns (``new=old``), so scans read only those."""
    source = spark.read.parquet(f"{folder}/{source_name}.parquet")
    return source.select(*[F.col(old).alias(new) for new, old in columns.items()]) if columns else source


def events(spark, folder, **more) -> DataFrame:
    return table(spark, folder, "events", pos="event_id", **more)


# --- sources and generators -------------------------------------------------------------


@query("sequence")
def _(spark, folder):
    return sources.sequence(spark, table(spark, folder, "orders").count())


@query("hash_uniform")
def _(spark, folder):
    return events(spark, folder).select("pos", uniform(SEED, "pos").alias("u"))


@query("hash_randint")
def _(spark, folder):
    return events(spark, folder).select(
        "pos",
        uniform_int(SEED, 0, 10_000, "pos").alias("below_high"),
        uniform_int(SEED, 1, 1_000, "pos", inclusive=True).alias("up_to_high"),
    )


@query("scan_numbers")
def _(spark, folder):
    lines = table(spark, folder, "orders", pos="o_orderkey", n="o_custkey")
    lines = lines.select("pos", F.concat(F.lit(" \t"), F.col("n").cast("string"), F.lit("\r")).alias("value"))
    return sources.parse_numbers(lines, "double")


@query("scan_tokens")
def _(spark, folder):
    lines = table(spark, folder, "orders", pos="o_orderkey", a="o_orderkey", b="o_custkey")
    lines = lines.select("pos", F.concat(F.lit("\t "), F.col("a"), F.lit(" \n "), F.col("b")).alias("value"))
    return sources.parse_tokens(lines, "int")


@query("scan_dicts")
def _(spark, folder):
    lines = events(spark, folder, v="value")
    lines = lines.select("pos", F.concat(F.lit("{'item': "), F.col("v").cast("string"), F.lit("}")).alias("line"))
    return sources.parse_dicts(lines, "double", line="line").select("pos", "item")


@query("number_parquet")
def _(spark, folder):
    return sources.number_parquet(spark, f"{folder}/events.parquet").select("event_id", "pos")


@query("take_n")
def _(spark, folder):
    return ordering.take_first(events(spark, folder, value="value"), 100)


# --- scalars ----------------------------------------------------------------------------


@query("flatten_record")
def _(spark, folder):
    return pairing.flatten(events(spark, folder, a="event_id", b="user_id"), ["a", "b"], "bigint")


@query("flatten_float")
def _(spark, folder):
    rows = table(spark, folder, "orders", pos="o_orderkey", a="o_totalprice", b="o_custkey")
    flat = pairing.flatten(rows, ["a", "b"], "float")
    return flat.select("pos", F.col("value").cast("double").alias("value"))


@query("cast_float")
def _(spark, folder):
    rows = table(spark, folder, "orders", pos="o_orderkey", price="o_totalprice", cust="o_custkey")
    rows = rows.select("pos", *[F.col("price").alias(c) for c in ("single", "whole")], F.col("cust").alias("text"))
    cast = pairing.apply_cast(rows, {"single": "float", "whole": "bigint", "text": "string"})
    return cast.withColumn("single", F.col("single").cast("double"))


@query("trim_text")
def _(spark, folder):
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("\r\n "))
    stripped = table(spark, folder, "documents", doc_id="doc_id", text="text").withColumn("text", strip(padded))
    return stripped.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("digit")
def _(spark, folder):
    signed = F.col("cust") - 500
    rows = table(spark, folder, "orders", pos="o_orderkey", cust="o_custkey")
    return rows.select("pos", *[digit(signed, place).alias(f"digit{place}") for place in range(3)])


@query("max_digits")
def _(spark, folder):
    found = ordering.max_digits(table(spark, folder, "orders", v="o_orderkey"), "v")
    return found.select(F.col("max_digits").cast("bigint").alias("max_digits"))


@query("round_sig")
def _(spark, folder):
    rows = table(spark, folder, "orders", pos="o_orderkey", price="o_totalprice")
    return rows.select(
        "pos",
        round_significant(F.col("price"), 2).alias("two"),
        round_significant(F.col("price") / 1_000_000, 3).alias("three"),
    )


@query("readable_size")
def _(spark, folder):
    rows = table(spark, folder, "documents", doc_id="doc_id", chars="n_chars")
    return rows.select("doc_id", readable_size(F.col("chars") * 1_000_003).alias("size"))


@query("zip_add")
def _(spark, folder):
    left = events(spark, folder, a="user_id")
    right = table(spark, folder, "orders", pos="o_orderkey", b="o_custkey")
    return pairing.zip_add(left, right, "a", "b").select("pos", "total")


@query("argmax")
def _(spark, folder):
    rows = table(spark, folder, "embeddings", vec_id="vec_id", embedding="embedding")
    return rows.select("vec_id", argmax(F.col("embedding")).cast("bigint").alias("index"))


@query("class_label")
def _(spark, folder):
    rows = table(spark, folder, "embeddings", vec_id="vec_id", label="label")
    names = table(spark, folder, "nation", key="n_nationkey", name="n_name")
    return pairing.lookup_label(rows, names, "label", "key").select("vec_id", "name")


@query("class_label_missing")
def _(spark, folder):
    rows = table(spark, folder, "embeddings", vec_id="vec_id", label="label")
    names = table(spark, folder, "region", key="r_regionkey", name="r_name")
    return pairing.lookup_label(rows, names, "label", "key")


# --- lanes ------------------------------------------------------------------------------


def _laned(make: Callable[[int], L.Lanes]):
    """Lane, rank in the lane, lane start and size for every event."""

    def run(spark, folder):
        rows = events(spark, folder)
        rule = make(rows.count())
        at = F.col("pos")
        laned = L.with_lane(rows, rule)
        return laned.select(
            "pos",
            "lane",
            rule.rank(at).alias("rank"),
            rule.start(F.col("lane")).alias("start"),
            rule.size(F.col("lane")).alias("size"),
            rule.member(F.col("lane"), rule.rank(at)).alias("member"),
        )

    return run


LANE_RULES: dict[str, Callable[[int], L.Lanes]] = {
    "lane_round_robin": lambda n: L.Strided(n, 8),
    "lane_diagonal": lambda n: L.Diagonal(n, 7),
    "chunk_ceil": lambda n: L.ceil_chunks(n, 7),
    "chunk_floor": lambda n: L.FloorChunks(n, 7),
    "batch_id": lambda n: L.Batches(n, 1000),
    "split_percent": lambda n: L.HeadTail(n, 30),
    "merge_blocks": lambda n: L.merge_blocks(n, 32),
    "lane_rebalance": lambda n: L.Balanced(n, 7),
}
for _name, _make in LANE_RULES.items():
    QUERIES[_name] = _laned(_make)


@query("lane_filter")
def _(spark, folder):
    rows = events(spark, folder)
    return L.only_lane(rows, L.Strided(rows.count(), 8), 3)


@query("split_k")
def _(spark, folder):
    rows = events(spark, folder)
    parts = L.split(rows, L.ceil_chunks(rows.count(), 4))
    numbered = [part.withColumn("part", F.lit(number)) for number, part in enumerate(parts)]
    whole = numbered[0]
    for part in numbered[1:]:
        whole = whole.unionAll(part)
    return whole


def _document_lanes(spark, folder) -> tuple[DataFrame, L.Lanes]:
    rows = table(spark, folder, "documents", pos="doc_id", chars="n_chars")
    return rows, L.ceil_chunks(rows.count(), 8)


@query("lane_loads")
def _(spark, folder):
    rows, rule = _document_lanes(spark, folder)
    return L.lane_loads(L.with_lane(rows, rule), "lane", F.col("chars"))


@query("lane_extremes")
def _(spark, folder):
    rows = events(spark, folder)
    loads = L.lane_loads(L.with_lane(rows, L.Diagonal(rows.count(), 7)))
    return L.lane_extremes(loads)


@query("argsort")
def _(spark, folder):
    rows, rule = _document_lanes(spark, folder)
    loads = L.lane_loads(L.with_lane(rows, rule), "lane", F.col("chars"))
    return ordering.argsort(loads, "bytes", "lane").select("lane", "bytes", "rank")


@query("lane_by_size")
def _(spark, folder):
    rows, rule = _document_lanes(spark, folder)
    loads = L.lane_loads(L.with_lane(rows, rule), "lane", F.col("chars"))
    offsets = ordering.lane_offsets(loads, "bytes")
    return ordering.concat_in_order(rows, rule, offsets, shuffle_key="pos", seed=SEED).select("pos", "new_pos")


@query("lane_offsets_sparse")
def _(spark, folder):
    """Many lanes, not all numbers present."""
    rows = table(spark, folder, "orders", lane="o_custkey", v="o_orderkey")
    lanes = rows.groupBy("lane").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total"))
    return ordering.lane_offsets(lanes, "total")


def _nation_lanes(spark, folder) -> tuple[DataFrame, L.Lanes, DataFrame]:
    rows = events(spark, folder)
    nations = table(spark, folder, "nation", lane="n_nationkey", region="n_regionkey")
    rule = L.ceil_chunks(rows.count(), 25)
    number = F.col("lane").cast("bigint")
    return rows, rule, nations.select(number.alias("lane"), "region", rule.size(number).alias("rows"))


@query("lane_by_distance")
def _(spark, folder):
    rows, rule, nations = _nation_lanes(spark, folder)
    offsets = ordering.lane_offsets(nations.withColumn("distance", F.abs(F.lit(2) - F.col("region"))), "distance")
    return ordering.concat_in_order(rows, rule, offsets)


@query("lane_by_cost")
def _(spark, folder):
    rows, rule, nations = _nation_lanes(spark, folder)
    cost = F.col("rows") / (F.col("region") + 1)
    return ordering.concat_in_order(rows, rule, ordering.lane_offsets(nations.withColumn("cost", cost), "cost"))


@query("half_rotate")
def _(spark, folder):
    rows = events(spark, folder)
    return L.half_rotate(rows, L.ceil_chunks(rows.count(), 7))


@query("digit_buckets")
def _(spark, folder):
    rows = table(spark, folder, "part", v="p_partkey")
    return L.lane_loads(ordering.digit_buckets(rows, "v", 1), "bucket")


# --- shuffles ---------------------------------------------------------------------------


@query("keyed_shuffle")
def _(spark, folder):
    return shuffles.keyed_shuffle(events(spark, folder, value="value"), "pos", SEED, out="new_pos")


@query("shuffle_generated")
def _(spark, folder):
    """Values and order drawn with one seed."""
    rows = events(spark, folder).select("pos", uniform(SEED, "pos").alias("u"))
    return shuffles.keyed_shuffle(rows, "pos", SEED, out="new_pos")


@query("rand_shuffle")
def _(spark, folder):
    return shuffles.rand_shuffle(events(spark, folder, value="value"), SEED)


@query("chunk_then_global_shuffle")
def _(spark, folder):
    return shuffles.chunk_then_global_shuffle(events(spark, folder), "pos", SEED + 1, out="new_pos")


@query("cyclic_shuffle")
def _(spark, folder):
    return shuffles.cyclic_shuffle(events(spark, folder), 8, "pos", SEED)


def _lane_shuffled(make: Callable[[int], L.Lanes]):
    def run(spark, folder):
        rows = events(spark, folder, value="value")
        return shuffles.lane_shuffle(rows, make(rows.count()), "pos", SEED)

    return run


LANE_SHUFFLES: dict[str, Callable[[int], L.Lanes]] = {
    "lane_shuffle_rr": lambda n: L.Strided(n, int(n**0.5)),
    "lane_shuffle_diagonal": lambda n: L.Diagonal(n, int(n**0.5)),
    "lane_shuffle_chunk": lambda n: L.ceil_chunks(n, 8),
    "split_shuffle": lambda n: L.HeadTail(n, 30),
}
for _name, _make in LANE_SHUFFLES.items():
    QUERIES[_name] = _lane_shuffled(_make)


@query("lane_shuffle_inplace")
def _(spark, folder):
    rows = events(spark, folder)
    return shuffles.lane_shuffle_in_place(rows, L.Diagonal(rows.count(), 7), "pos", SEED)


@query("lane_shuffle_digit")
def _(spark, folder):
    rows = table(spark, folder, "orders", pos="o_orderkey", v="o_custkey")
    bucketed = ordering.digit_buckets(rows, "v", 0)
    return shuffles.column_lane_shuffle(bucketed, "bucket", "pos", SEED).select("pos", "bucket", "new_pos")


@query("batch_shuffle")
def _(spark, folder):
    return shuffles.batch_shuffle(events(spark, folder), 1000, "pos", SEED)


@query("rotate_shuffle")
def _(spark, folder):
    rows = events(spark, folder)
    return shuffles.rotate_shuffle(rows, L.ceil_chunks(rows.count(), 7), SEED)


@query("pair_exchange")
def _(spark, folder):
    return shuffles.pair_exchange(events(spark, folder), 7, "pos", SEED)


@query("riffle_merge")
def _(spark, folder):
    left = events(spark, folder, v="user_id")
    right = table(spark, folder, "orders", pos="o_orderkey", v="o_custkey")
    return riffle.riffle_merge(left, right, SEED)


@query("merge_shuffle")
def _(spark, folder):
    return shuffles.merge_shuffle(events(spark, folder), 2, "pos", SEED, coarse=True)


@query("merge_shuffle_uniform")
def _(spark, folder):
    return shuffles.merge_shuffle(events(spark, folder), 32, "pos", SEED)


@query("permutation")
def _(spark, folder):
    return shuffles.permutation(events(spark, folder), "pos", SEED)


@query("gather")
def _(spark, folder):
    rows = events(spark, folder, value="value")
    indices = shuffles.permutation(rows, "pos", SEED)
    return pairing.gather(rows, indices)


@query("sample_k")
def _(spark, folder):
    return shuffles.sample_k(events(spark, folder, value="value"), 500, "pos", SEED)


# --- orders -----------------------------------------------------------------------------


@query("stable_sort")
def _(spark, folder):
    return ordering.stable_sort(events(spark, folder, v="user_id"), "v")


@query("radix_order")
def _(spark, folder):
    return ordering.radix_order(table(spark, folder, "orders", pos="o_orderkey", v="o_custkey"), "v")


# --- pairs of tables --------------------------------------------------------------------


@query("zip_join")
def _(spark, folder):
    left = events(spark, folder, value="value")
    right = table(spark, folder, "orders", pos="o_orderkey", price="o_totalprice")
    return pairing.zip_join(left, right)


@query("missing_elements")
def _(spark, folder):
    left = table(spark, folder, "documents", doc_id="doc_id")
    return pairing.missing_elements(left, table(spark, folder, "labels", doc_id="doc_id"), "doc_id")


@query("concat")
def _(spark, folder):
    left = table(spark, folder, "customer", pos="c_custkey", v="c_acctbal")
    right = table(spark, folder, "supplier", pos="s_suppkey", v="s_acctbal")
    return pairing.concat(left, right)


@query("sum_squares")
def _(spark, folder):
    rows = table(spark, folder, "lineitem", q="l_quantity")
    return rows.agg(F.round(F.sum(F.col("q") * F.col("q")), 2).alias("sum_squares"))


# --- loads, digits and cycles -----------------------------------------------------------


def _uneven(spark, folder) -> DataFrame:
    """Orders in lanes of very different sizes, some of 16 empty."""
    rows = table(spark, folder, "orders", pos="o_orderkey", cust="o_custkey")
    return rows.select("pos", F.when(F.col("cust") % 3 == 0, 0).otherwise(F.col("cust") % 13).cast("bigint").alias("lane"))


@query("rebalance_moves")
def _(spark, folder):
    return balance.rebalance(_uneven(spark, folder), "lane", 16)


@query("least_loaded")
def _(spark, folder):
    """Documents dealt by length; rows and characters per lane."""
    rows = table(spark, folder, "documents", pos="doc_id", cost="n_chars")
    dealt = balance.least_loaded(rows, "cost", 8, bits=20)
    return dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost").alias("cost"))


@query("radix_sort")
def _(spark, folder):
    """A wide range of values on both sides of zero, a third of them equal, some missing."""
    rows = table(spark, folder, "orders", pos="o_orderkey", cust="o_custkey")
    cust = F.col("cust")
    v = F.when(cust % 3 == 0, 42).when(cust % 7 == 0, F.lit(None)).otherwise((cust - 500) * 1_000_003)
    return radix.radix_sort(rows.select("pos", v.cast("bigint").alias("v")), "v")


@query("riffle_uniform")
def _(spark, folder):
    left = events(spark, folder, v="user_id")
    right = table(spark, folder, "orders", pos="o_orderkey", v="o_custkey")
    return riffle.riffle_merge(left, right, SEED, uniform=True)


@query("merge_uniform")
def _(spark, folder):
    return shuffles.merge_shuffle(events(spark, folder), 2, "pos", SEED, uniform=True)


@query("permutation_cycles")
def _(spark, folder):
    rows = events(spark, folder)
    return cycles.cycle_lengths(shuffles.cyclic_shuffle(rows, 64, "pos", SEED))


# --- verification -----------------------------------------------------------------------


def _parts(spark, folder) -> DataFrame:
    return sources.number_parquet(spark, f"{folder}/lineitem.parquet").select(
        "pos", F.col("l_partkey").alias("value")
    )


@query("verify_set")
def _(spark, folder):
    keys = table(spark, folder, "part", value="p_partkey")
    return verify.verify_set(keys, _parts(spark, folder), "value")


@query("verify_multiset")
def _(spark, folder):
    rows = _parts(spark, folder)
    return verify.verify_multiset(rows, shuffles.keyed_shuffle(rows, "pos", SEED, out="new_pos"), "value")


@query("verify_multiset_false")
def _(spark, folder):
    return verify.verify_multiset(table(spark, folder, "part", value="p_partkey"), _parts(spark, folder), "value")


@query("verify_set_false")
def _(spark, folder):
    left = table(spark, folder, "documents", value="doc_id")
    return verify.verify_set(left, table(spark, folder, "labels", value="doc_id"), "value")


@query("verify_fingerprint")
def _(spark, folder):
    rows = _parts(spark, folder)
    return verify.verify_fingerprint(rows, shuffles.keyed_shuffle(rows, "pos", SEED, out="new_pos"), "value")


@query("verify_fingerprint_false")
def _(spark, folder):
    return verify.verify_fingerprint(table(spark, folder, "part", value="p_partkey"), _parts(spark, folder), "value")


@query("fingerprint_audit")
def _(spark, folder):
    """Three outputs of one table: shuffled, untouched, and with a value changed."""
    rows = events(spark, folder, value="user_id")
    changed = rows.withColumn("value", F.when(F.col("pos") == 5, F.col("value") + 1).otherwise(F.col("value")))
    audits = [verify.fingerprint_audit(rows, after) for after in (_shuffled(rows), rows, changed)]
    numbered = [audit.withColumn("nth", F.lit(k)) for k, audit in enumerate(audits)]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2])


@query("verify_length")
def _(spark, folder):
    keys = table(spark, folder, "customer", value="c_custkey")
    return verify.verify_length(keys, table(spark, folder, "orders", value="o_custkey"), "value")


@query("verify_elements")
def _(spark, folder):
    left = table(spark, folder, "documents", doc_id="doc_id")
    return verify.verify_elements(left, table(spark, folder, "labels", doc_id="doc_id"), "doc_id")


def _shuffled(rows: DataFrame, seed: int = SEED) -> DataFrame:
    return shuffles.keyed_shuffle(rows, "pos", seed, out="to").select(F.col("to").alias("pos"), "value")


@query("shuffle_percentage")
def _(spark, folder):
    rows = events(spark, folder, value="user_id")
    return verify.shuffle_percentage(rows, _shuffled(rows), "pos", "value")


@query("inversions")
def _(spark, folder):
    return verify.inversions(table(spark, folder, "orders", pos="o_orderkey", v="o_totalprice"), "pos", "v")


@query("shuffle_audit")
def flagship(spark, folder):
    """Shuffle the events and audit the result: one row with every measure."""
    rows = events(spark, folder, value="value")
    return verify.shuffle_audit(rows, _shuffled(rows))


@query("lane_audit")
def _(spark, folder):
    rows = table(spark, folder, "orders", pos="o_orderkey", value="o_custkey")
    moved = shuffles.lane_shuffle(rows, L.Strided(rows.count(), 8), "pos", SEED)
    return verify.shuffle_audit(rows, moved.select(F.col("new_pos").alias("pos"), "value"))


@query("audit_bad_positions")
def _(spark, folder):
    """An output with NULL positions, positions past the end, and many rows on one position."""
    rows = table(spark, folder, "orders", pos="o_orderkey", value="o_custkey")
    at = F.col("pos")
    wrong = F.when(at % 10 == 3, F.lit(None)).when(at % 2 == 1, at + 1_000_000).when(at % 3 == 0, F.lit(6)).otherwise(at)
    report = verify.shuffle_audit(rows, rows.select(wrong.cast("bigint").alias("pos"), "value"))
    return report.select("n", "n_out", "set_ok", "multiset_ok", "bad_positions", "repeated", "verdict")


# --- inference --------------------------------------------------------------------------


def class_weights(classes: int = 10, width: int = 64) -> np.ndarray:
    """Weights of the example model, by rule: ((7c + 3j + cj) mod 11) - 5."""
    c, j = np.meshgrid(np.arange(classes), np.arange(width), indexing="ij")
    return ((7 * c + 3 * j + c * j) % 11 - 5).astype("float64")


def _predictor() -> dict:
    return {
        "build_model": inference.linear_model(class_weights(), "features"),
        "inputs": ["features"],
        "out": "predicted",
        "out_type": "bigint",
        "batch_size": 360,
    }


def _features(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings", vec_id="vec_id", embedding="embedding")
    return inference.map_features(rows, "embedding", "features", lambda x: (x.cast("double") - 0.5) / 0.25)


@query("map_features")
def _(spark, folder):
    mapped = _features(spark, folder).select("vec_id", F.posexplode("features").alias("nth", "feature"))
    return mapped.select("vec_id", F.col("nth").cast("bigint").alias("nth"), F.round("feature", 6).alias("feature"))


@query("batch_predict")
def _(spark, folder):
    predicted = inference.batch_predict(_features(spark, folder).drop("embedding"), **_predictor())
    names = table(spark, folder, "nation", key="n_nationkey", name="n_name")
    return pairing.lookup_label(predicted.drop("features"), names, "predicted", "key")


@query("predict_in_batches")
def _(spark, folder):
    """A model whose answer depends on the batch: the value above the batch's least, and its size."""

    def build():
        return lambda batch: batch["v"] - batch["v"].min() + 1000 * len(batch)

    rows = events(spark, folder, v="user_id")
    return inference.predict_in_batches(rows, build, ["v"], "answer", "bigint", 360)


@query("predict_sample")
def _(spark, folder):
    rows = _features(spark, folder).drop("embedding")
    return inference.predict_sample(rows, 10, "vec_id", **_predictor()).drop("features")


@query("apply_per_lane")
def _(spark, folder):
    rows = events(spark, folder, v="user_id")
    rule = L.Batches(rows.count(), 1000)

    def fold(frames):
        """A recurrence along the lane, which no window states: state * 31 + v, modulo a prime."""
        state = 0
        for frame in frames:
            states = []
            for v in frame["v"]:
                state = (state * 31 + v) % 1_000_003
                states.append(state)
            yield frame.assign(state=states)

    return inference.apply_per_lane(rows, rule, fold, "pos bigint, v bigint, state bigint")
