"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of single words, of their beginnings (so that an unseen ending of a
known stem still counts), of those that come up twice or four times, of word pairs and of pairs with one or two words between, hashed
into a fixed table. FTRL-proximal gives every coordinate its own rate and keeps most weights
at exactly zero; the rest travel as one small broadcast. The model is fitted on at most
``max_rows`` labelled rows; everything else sees all rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.llm.common import first_rows, lean, map_batches, mix, narrow, slices, table

WORD = re.compile(r"\w+")
HASH_BITS = 20
MAX_ROWS = 5000
STEMS = (3, 4, 5, 6, 7)
TIMES = (2, 4)  # a word or beginning that comes up so often in a text is a feature of its own
CACHE_WORDS = 1 << 17


class WordFeatures(dict):
    """Word -> (hash, feature ids of the word and its beginnings); emptied when it gets large."""

    def __missing__(self, word: str) -> tuple[int, list[int]]:
        if len(self) > CACHE_WORDS:
            self.clear()
        mask = (1 << HASH_BITS) - 1
        code = xxhash.xxh3_64_intdigest(word)
        ids = [code & mask] + [xxhash.xxh3_64_intdigest(word[:n], seed=n) & mask for n in STEMS if len(word) >= n]
        self[word] = code, ids
        return self[word]


def features(text: str | None, cache: WordFeatures) -> np.ndarray:
    """Feature ids of a text; pairs may repeat."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    pairs = [cache[word] for word in words]
    codes = np.fromiter((pair[0] for pair in pairs), np.uint64, len(pairs))
    found, counts = np.unique(np.fromiter((i for pair in pairs for i in pair[1]), np.int64), return_counts=True)
    mask = np.uint64((1 << HASH_BITS) - 1)
    parts = [found]
    for times in TIMES:
        often = found[counts >= times].astype(np.uint64)
        parts.append((mix(often + (np.uint64(times) << np.uint64(40))) & mask).astype(np.int64))
    for gap in (1, 2, 3):
        if len(codes) > gap:
            grams = mix(codes[:-gap] * np.uint64(2 * gap + 1) + (codes[gap:] >> np.uint64(gap)))
            parts.append((grams & mask).astype(np.int64))
    return np.concatenate(parts)


def fit_ftrl(
    rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 6
) -> tuple[np.ndarray, float]:
    """Weights and bias of FTRL-proximal over rows of distinct feature ids; order is shuffled by a fixed seed."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(5)

    def weight(ids: np.ndarray) -> np.ndarray:
        penalty = np.full(len(ids), l1)
        penalty[-1] = 0.0  # the bias, kept last, is not shrunk
        return np.where(np.abs(z[ids]) <= penalty, 0.0, -(z[ids] - np.sign(z[ids]) * penalty) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids = np.append(rows[k], size)
            w = weight(ids)
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, w.sum())))) - labels[k]
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
    every = weight(np.arange(size + 1))
    return every[:-1], float(every[-1])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(feature ids, weights, bias) of the non-zero weights, or None without labelled rows.

    Labels of doc_ids whose crc32 is divisible by 5 are never read. A doc_id with several
    labels counts as toxic if any says so; NULL labels are left out.
    """
    known = narrow(labels, doc_id=F.col("doc_id").cast("long"), toxic="toxic").where(~held_out("doc_id"))
    known = known.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = first_rows(known, "doc_id", max_rows)  # at most max_rows narrow rows, so it may be broadcast
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text").join(F.broadcast(sample), "doc_id")

    def run(batch):
        cache = WordFeatures()
        ids = [np.unique(features(text, cache)).astype(np.int32).tobytes() for text in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "ids": ids}

    found = map_batches(docs.select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, ids binary").toPandas()
    found = found.drop_duplicates("doc_id").sort_values("doc_id")
    if found.empty:
        return None
    rows = [np.frombuffer(x, np.int32) for x in found["ids"]]
    weights, bias = fit_ftrl(rows, (found["toxic"].to_numpy() > 0).astype(float))
    (used,) = np.nonzero(weights)
    return used, weights[used], bias


class Scorer:
    """Probability that a text is toxic."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, bias: float):
        self.cache, self.bias, self.weights = WordFeatures(), bias, np.zeros(1 << HASH_BITS)
        self.weights[used] = weights

    def __call__(self, text: str | None) -> float:
        ids = features(text, self.cache)
        ids = np.unique(ids[self.weights[ids] != 0])
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, self.weights[ids].sum() + self.bias))))


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """``(doc_id, score)`` of every row: the model's probability that the text is toxic."""
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batch):
        if not state:
            state["score"] = Scorer(*shared.value)
        yield {"doc_id": batch.column("doc_id"), "score": [state["score"](text) for text in batch.column("text").to_pylist()]}

    return map_batches(docs, run, "doc_id long, score double")


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """The rows with a score under one half, all columns as they came, NULL texts included."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer(text) < 0.5 for text in batch.column(place).to_pylist()], pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document row.

    NULL and empty texts have no features and get the score of the bias alone; without
    labelled rows every score is 0. Repeated rows are scored alike; a NULL doc_id is scored
    and counts as not held out. Other columns are ignored; an empty table gives no rows.
    """
    return score(documents, train(documents, labels, max_rows)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def query(spark, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
