"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with one weight vector over hashed text features
for all grades and thresholds kept in order. Features are the presence of words, their beginnings and
word pairs, and how often token shapes occur (``AA!``, ``aa$``), by powers of two. Weights are fitted by
proximal adaptive gradients on at most ``max_rows`` rated rows, so most are zero.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.llm.common import first_rows, map_batches, mix, narrow, table

MAX_ROWS = 6000
GRADES = 3
HASH_BITS = 20
MASK = (1 << HASH_BITS) - 1
STEMS = (3, 4, 5, 6, 7)
TIMES = (2, 4)  # a word or beginning that comes up so often in a text is a feature of its own
PIECE = 1 << 20  # code points of a long text that are worked on at once
GAP = re.compile(r"\s")
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below 2^16: part of a word, white space, and the class a shape shows."""
    word, space, shape = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        word[c], space[c], shape[c] = _kinds(chr(c))
    return word, space, shape


def _kinds(char: str) -> tuple[bool, bool, int]:
    seen = "A" if char.isupper() else "a" if char.isalpha() else "0" if char.isdigit() else char
    return char.isalnum() or char == "_", char.isspace(), ord(seen)


class Codes:
    """Code points of a stretch of text with their kinds, and hashes of any runs of them.

    A run's hash is a Karp-Rabin sum of scrambled code points, brought to one power and scrambled with its length.
    """

    WORD, SPACE, SHAPE = _tables()
    MIXED = mix(np.arange(1 << 16, dtype=np.uint64))
    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, points: np.ndarray):
        self.points, size = points, len(points)
        if len(Codes.powers[0]) <= size:
            Codes.powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * size, base, np.uint64)])) for base in (BASE, INVERSE)]
        (self.far,) = np.nonzero(points > 65535)
        self.near = np.minimum(points, 65535) if len(self.far) else points
        mixed = Codes.MIXED[self.near]
        mixed[self.far] = mix(points[self.far].astype(np.uint64))
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(mixed * Codes.powers[0][:size], out=self.sums[1:])

    @classmethod
    def of(cls, text: str) -> "Codes":
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def kind(self, which: int) -> np.ndarray:
        table = (Codes.WORD, Codes.SPACE, Codes.SHAPE)[which]
        found = table[self.near]
        if len(self.far):
            names, place = np.unique(self.points[self.far], return_inverse=True)
            found[self.far] = np.array([_kinds(chr(c))[which] for c in names.tolist()], table.dtype)[place]
        return found

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of set flags."""
        (edges,) = np.nonzero(flags[1:] != flags[:-1])
        edges = np.concatenate([[0] if len(flags) and flags[0] else [], edges + 1, [len(flags)] if len(flags) and flags[-1] else []]).astype(np.int64)
        return edges[::2], edges[1::2]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self.sums[ends] - self.sums[starts]) * Codes.powers[1][starts]
        return mix(found + (ends - starts).astype(np.uint64) * SCRAMBLE)


def pieces(text: str) -> Iterator[str]:
    """A long text bit by bit, cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class RatingFeatures:
    """Feature ids of texts: words, their beginnings, those that come up often, pairs of words, shapes
    of tokens, and marks of the text as a whole. All by arrays over the code points of a text.

    Given the weights of a model, ids without weight are left out before anything is sorted;
    ``matters`` also keeps ids of words whose repetition has weight.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights, self.matters = weights, None
        if weights is not None:
            every = np.arange(1 << HASH_BITS, dtype=np.uint64)
            self.matters = weights != 0
            for times in TIMES:
                self.matters |= weights[_id(every + (np.uint64(times) << np.uint64(40)))] != 0

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct ids, without those of no weight where weights are known."""
        text = text or ""
        codes, ids, shapes, tokens = [], [], [], []
        for piece in pieces(text):
            low = Codes.of(piece.lower())
            starts, ends = low.runs(low.kind(0))
            enough = [starts[ends - starts >= n] for n in STEMS]
            hashes = low.hashes(np.concatenate([starts, *enough]), np.concatenate([ends, *(x + n for x, n in zip(enough, STEMS))]))
            codes.append(hashes[: len(starts)])
            ids.append((codes[-1] & np.uint64(MASK)).astype(np.int32))
            ids.append((hashes[len(starts) :] >> np.uint64(HASH_BITS)).astype(np.int32) & np.int32(MASK))
            own = Codes.of(piece)
            blank = own.kind(1)
            tokens.append(own.hashes(*own.runs(~blank)))
            seen = own.kind(2)
            seen[blank] = 32
            keep = np.ones(len(seen), bool)
            keep[2:] = (seen[2:] != seen[1:-1]) | (seen[1:-1] != seen[:-2])  # of a run two stay
            shape = Codes(seen[keep])
            shapes.append(shape.hashes(*shape.runs(shape.points != 32)))
        parts = [self._whole(text, *(np.concatenate(x) if x else np.empty(0, np.uint64) for x in (tokens, shapes)))]
        if ids:
            every = np.concatenate(ids)
            found, counts = np.unique(every if self.matters is None else every[self.matters[every]], return_counts=True)
            parts.append(found.astype(np.int64))
            parts += [_id(found[counts >= times].astype(np.uint64) + (np.uint64(times) << np.uint64(40))) for times in TIMES]
            words = np.concatenate(codes)
            for gap in (1, 2, 3):
                if len(words) > gap:
                    parts.append(_id(words[:-gap] * np.uint64(2 * gap + 1) + (words[gap:] >> np.uint64(gap))))
        every = np.concatenate(parts)
        return np.unique(every if self.weights is None else every[self.weights[every] != 0])

    def _whole(self, text: str, tokens: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        size = len(tokens)
        marks = [("length", size.bit_length())]
        if not size:
            return np.array([_mark(mark) for mark in marks], np.int64)
        marks.append(("distinct", int(8 * len(np.unique(tokens)) / size), size.bit_length()))
        lines = [line for line in text.split("\n") if line.strip()]
        marks.append(("lines", int(8 * len(set(lines)) / max(1, len(lines)))))
        found, counts = np.unique(shapes, return_counts=True)
        rarity = np.floor(np.log2(size / counts)).astype(np.uint64)
        return np.concatenate([np.array([_mark(mark) for mark in marks], np.int64), _id(found + rarity * SCRAMBLE)])


def _id(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) & np.uint64(MASK)).astype(np.int64)


@lru_cache(maxsize=1 << 12)
def _mark(mark: tuple) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(map(str, mark))) & MASK


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


class CumulativeLink:
    """Weights by feature id and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        (self.used,) = np.nonzero(weights)
        self.values, self.thresholds = weights[self.used], thresholds

    def dense(self) -> np.ndarray:
        weights = np.zeros(1 << HASH_BITS)
        weights[self.used] = self.values
        return weights

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1.0 - _sigmoid(t - score) for t in self.thresholds]


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, alpha: float = 0.3, l1: float = 6.0, l2: float = 1.0, epochs: int = 6) -> CumulativeLink:
    """Proximal adaptive-gradient fit; thresholds are the first and positive gaps above it."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    share = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 0.01, 0.99)
    thresholds = np.log(share / (1 - share))
    thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(n_grades - 1))
    rng, squares = np.random.default_rng(23), np.full(n_grades - 1, 1.0)

    def weight(ids: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[ids]) <= l1, 0.0, -(z[ids] - np.sign(z[ids]) * l1) / ((1.0 + np.sqrt(n[ids])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, grade = rows[k], int(grades[k])
            w = weight(ids)
            score = float(w.sum())
            above = _sigmoid(thresholds[grade] - score) if grade < n_grades - 1 else 1.0
            below = _sigmoid(thresholds[grade - 1] - score) if grade else 0.0
            inside = max(above - below, 1e-6)
            g = 1.0 - above - below  # derivative of -log P(grade) by the score
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
            for t, slope in ((grade, -above * (1 - above) / inside), (grade - 1, below * (1 - below) / inside)):
                if 0 <= t < n_grades - 1:
                    squares[t] += slope * slope
                    thresholds[t] -= 0.1 * slope / math.sqrt(squares[t])
            thresholds = np.maximum.accumulate(thresholds)
    return CumulativeLink(weight(np.arange(1 << HASH_BITS)), thresholds)


def train(documents: DataFrame, ratings: DataFrame, n_grades: int = GRADES, max_rows: int = MAX_ROWS) -> CumulativeLink | None:
    """A model from ratings ``(doc_id, grade)``; of several grades of a doc_id the lowest counts, NULLs are
    left out. None where no rated row has a text row."""
    rated = narrow(ratings, doc_id=F.col("doc_id").cast("long"), grade=F.col("grade").cast("int")).where("doc_id is not null and grade is not null")
    rated = rated.groupBy("doc_id").agg(F.least(F.greatest(F.min("grade"), F.lit(0)), F.lit(n_grades - 1)).alias("grade"))
    sample = first_rows(rated, "doc_id", max_rows)  # at most max_rows narrow rows, so it may be broadcast
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text").join(F.broadcast(sample), "doc_id")

    def run(batch):
        find = RatingFeatures()
        ids = [find(text).astype(np.int32).tobytes() for text in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "ids": ids}

    found = map_batches(docs.select("doc_id", "grade", "text"), run, "doc_id long, grade int, ids binary").toPandas()
    found = found.drop_duplicates("doc_id").sort_values("doc_id")
    if found.empty:
        return None
    return fit([np.frombuffer(x, np.int32) for x in found["ids"]], found["grade"].to_numpy(), n_grades)


def graded(documents: DataFrame, ratings: DataFrame, n_grades: int = GRADES, least: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, expected_grade, tail, selected)``, one row per document row.

    ``tail`` is the probability of grade ``least`` or better; rows of one half or more are selected. NULL and
    empty texts have only their length as a feature. Without usable ratings every row has a NULL
    grade and tail and is selected. Repeated rows are graded alike, a NULL doc_id is carried
    through, other columns are ignored, an empty table gives no rows.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    model = train(documents, ratings, n_grades, max_rows)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("expected_grade"), nothing.alias("tail"), F.lit(True).alias("selected"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batch):
        if not state:
            state["w"] = shared.value.dense()
            state["find"] = RatingFeatures(state["w"])
        w, find = state["w"], state["find"]
        tails = [shared.value.tails(float(w[find(text)].sum())) for text in batch.column("text").to_pylist()]
        columns = np.array(tails).reshape(len(tails), -1)
        tail = columns[:, least - 1]
        yield {"doc_id": batch.column("doc_id"), "expected_grade": columns.sum(1), "tail": tail, "selected": pa.array(tail >= 0.5)}

    return map_batches(docs, run, "doc_id long, expected_grade double, tail double, selected boolean")


def grade_of_labels() -> Column:
    """Grade 0 for bad quality, 1 for good but toxic, 2 for good."""
    return F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") > 0, 2)


def query(spark, folder: str) -> DataFrame:
    ratings = table(spark, folder, "labels").select("doc_id", grade_of_labels().alias("grade"))
    return graded(table(spark, folder, "documents"), ratings)
