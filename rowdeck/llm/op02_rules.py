"""Quality rules with an isolation forest on rule statistics.

Each text is reduced to rule statistics in one pass: by how much it goes beyond the customary
range of each rule. A forest of random splits is grown on a bounded sample of rows; rows that
few splits set apart (short paths) are unlike most documents. The path-length score at which
a row is rejected is calibrated on all labelled rows, from counts per score bin.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rowdeck.llm.common import durable, first_rows, gram_hashes, map_batches, narrow, table, word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
TREES, LEAVES, BINS = 100, 256, 1000
MAX_SAMPLE = 4096
# Customary range of each rule's value; fixed values.
RANGES = {
    "word_length": (3.0, 10.0), "symbols": (0.0, 0.1), "dup_lines": (0.0, 0.3), "repeats": (0.0, 0.3),
    "capitals": (0.0, 0.3), "digits": (0.0, 0.15), "marks": (0.0, 0.2), "distinct": (1.1, 99.0),
}
FEATURES = tuple(RANGES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words under windows that occur twice or more."""
    grams = gram_hashes(codes, window)
    if not len(grams):
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    (starts,) = np.nonzero(counts[inverse] > 1)
    edges = np.zeros(len(codes) + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of the contract and the forest's features of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(word_hashes(words))
    counts = [n, word_chars, symbols, dup_lines, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    capitals = sum(word[:1].isalpha() and word.isupper() and len(word) > 1 for word in words) / n
    digits = sum(map(text.count, "0123456789")) / word_chars
    marks = sum(map(text.count, "!?|#*$%&<>")) / n
    distinct = len(set(words)) / n**0.85  # Heaps' law: about level over lengths
    values = (word_chars / n, symbols / n, dup_lines / len(lines), repeats / n, capitals, digits, marks, distinct)
    return counts, [min(0.0, value - low) + max(0.0, value - high) for value, (low, high) in zip(values, RANGES.values())]


def rule_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts and the features of every row."""
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")

    def run(batch):
        found = [statistics(text) for text in batch.column("text").to_pylist()]
        columns = {"doc_id": batch.column("doc_id")}
        columns |= {name: [x[0][k] for x in found] for k, name in enumerate(COUNTS)}
        columns |= {name: [x[1][k] for x in found] for k, name in enumerate(FEATURES)}
        yield columns

    return map_batches(docs, run, "doc_id long, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES]))


class IsolationForest:
    """Random axis-parallel splits; the score is 2^(-mean path length / expected path length)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 17):
        rng = np.random.default_rng(seed)
        size = min(leaves, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, size))))
        self.expected = max(_path(size), 1e-9)
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            k = len(nodes)
            nodes.append([0, np.inf, k, k, depth + _path(len(part))])
            spread = part.max(0) > part.min(0) if len(part) else np.zeros(0, bool)
            if depth < self.depth and len(part) > 1 and spread.any():
                feature = int(rng.choice(np.nonzero(spread)[0]))
                cut = rng.uniform(part[:, feature].min(), part[:, feature].max())
                left = part[:, feature] < cut
                nodes[k][:4] = [feature, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1)]
            return k

        grow(rows, 0)
        whole = np.array(nodes)
        return whole[:, 0].astype(np.int64), whole[:, 1], whole[:, 2].astype(np.int64), whole[:, 3].astype(np.int64), whole[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of every row, between 0 and 1."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, feature[at]] < cut[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.expected)


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def calibrated(bins: list[tuple[int, int, int]]) -> float:
    """The score bound that best parts the labels, from (bin, quality, rows): highest sum of the shares of
    good rows under it and bad rows at or over it; of equal bounds the highest."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, quality, rows in bins:
        (good if quality else bad)[at] += rows
    if not good.sum() or not bad.sum():
        return 2.0
    under = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    over = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    value = under + over
    return (len(value) - 1 - int(np.argmax(value[::-1]))) / BINS


def quality_rules(documents: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept)``,
    one row per document row.

    ``base_failed``: under 20 words, or more than 30 % of the words in repeated 8-word windows.
    ``kept`` is false for those, else true where the anomaly score stays under the calibrated
    bound. NULL, empty and wordless texts have zero counts and fail the base rules. The forest
    grows on at most ``max_sample`` rows that pass the base rules; without labels of both kinds no
    row is rejected by score. Repeated rows give repeated results, a NULL doc_id is carried
    through, other columns are ignored, an empty table gives no rows.
    """
    rows = durable(rule_statistics(documents))
    rated = narrow(labels, doc_id=F.col("doc_id").cast("long"), quality=F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    rated = rated.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    base = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    usable = rows.where(f"not ({base})")
    sample = first_rows(usable, "doc_id", max_sample).select(*FEATURES).toPandas()
    if sample.empty:
        return rows.select("doc_id", *COUNTS, F.expr(base).alias("base_failed"), F.lit(0.0).alias("anomaly"), F.expr(f"not ({base})").alias("kept"))
    values = sample.to_numpy()
    values = values[np.lexsort(values.T)]
    shared = documents.sparkSession.sparkContext.broadcast(IsolationForest(values))

    def run(batch):
        matrix = np.stack([batch.column(name).to_numpy() for name in FEATURES], axis=1)
        yield {"doc_id": batch.column("doc_id"), **{name: batch.column(name) for name in COUNTS}, "anomaly": np.round(shared.value.score(matrix), 6)}

    scored = map_batches(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")
    known = scored.where(f"not ({base})").join(rated, "doc_id")
    bins = known.groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), F.col("quality").cast("int").alias("quality")).count().collect()
    bound = calibrated([(row["bin"], int(row["quality"] > 0), row["count"]) for row in bins])
    failed = F.expr(base)
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") < bound)).alias("kept"))


def query(spark, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
